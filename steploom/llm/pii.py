"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidates are wide: what strict patterns find, whether it passes their checks or not, and what looser
patterns find besides, down to any dotted numbers, long runs of digits and long tokens. Five labelers
vote on each, +1, -1 or 0 (no opinion): the strict pattern, a check of the value (Luhn, octets, digits,
labels), a gazetteer (issuers, top-level domains, prefixes), the words before, and the edges. Votes are
counted by pattern, which bounds them at 5 kinds times 3^5 votes times a few shapes whatever the size
of the corpus; expectation-maximisation over the counts estimates how often each labeler votes for true
and for false candidates, and its posteriors train the final classifier, a naive Bayes over votes and
shapes. Strict matches that pass their checks always stay; the classifier decides on the others, unless
they touch one that stays; it takes none that fails its check.

Secrets (keys, tokens, passwords) are a kind of their own, found by the labelers alone and told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret"]
# The strict patterns. Possessive where nothing could be given back, so that no text
# makes the matcher recurse or go back.
STRICT = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]*+ ?(?:@|[\[({](?:at|@)[\])}]) ?[a-z0-9-]++(?: ?(?:\.|[\[({](?:dot|\.)[\])}]) ?[a-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]++(?: ?(?:\[\.\]|\.) ?[0-9]++){2,}+",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_ -]?[0-9]{4}){2,3}(?:[./_ -]?[0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\(?[0-9]{2,4}\)?[ ./-]){1,3}[0-9]{3,4}[ .-]?[0-9]{2,4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_/+.@-])(?=[A-Za-z_+/-]{0,40}[0-9])[A-Za-z0-9_+/-]{16,256}+(?![A-Za-z0-9_/+.@-])",
}
#: A cheap test that every match implies: most texts stop here.
GATE = {
    "email": r"@|[\[({](?i:at)[\])}]",
    "ip": r"[0-9] ?(?:\.|\[\.\]) ?[0-9]",
    "card": r"[0-9](?:[\x20./_-]?[0-9]){11}",
    "phone": r"\+[0-9]|[0-9][ .-]?[0-9]{2}",
    "secret": r"[A-Za-z0-9_+/-]{16}",
}
STRICT_GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){7}", "phone": r"\+[0-9]"}
# Words that speak for a kind, or against all but secrets, in the characters before it.
BEFORE, AGAINST = 32, r"(?i)(token|password|passwd|secret|sha|md5|hash|uuid|key|version|isbn|serial)\W{0,6}$"
WORDS = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|address|correo|courriel)\b",
    "ip": r"(?i)\b(ip|host|server|addr|address|client|from|adresse)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(tel|phone|call|mobile|fax|cell|telefon|teléfono|téléphone)\b",
    "secret": r"(?i)(token|password|passwd|pwd|secret|credential|bearer|api.?key|access.?key|private.?key)\W{0,6}$",
}
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|io|info|biz|eu|de|fr|es|uk|us|ch|at|nl|it)$",
    "ip": r"^(?!0|255|22[4-9]|23[0-9]|24[0-9]|25[0-5])",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9])",
    "secret": r"^(AKIA[0-9A-Z]{16}|gh[pousr]_\w+|sk-\w+|xox[abp]-.+|eyJ.+|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$)",
}
LABELERS, ROUNDS, ACCEPT = 5, 25, 0.9
#: The labeler that checks the value, and how often at least it passes true candidates.
CHECK, PASSES = 1, 0.95
#: Strict matches that fail and are shorter are no candidates.
LEAST = 7


def _positions(found: Column, gaps: Column) -> Column:
    """Ends of the matches in code points, from the gaps between them; sums by blocks of 64, so many matches stay cheap."""
    step = F.transform(found, lambda m, i: F.char_length(m) + F.char_length(gaps[i]))
    block = lambda s, b, n: F.aggregate(F.slice(s, b * 64 + 1, n), F.lit(0), lambda a, x: a + x)
    return F.flatten(F.transform(F.array(step), lambda s: F.flatten(F.transform(
        F.array(F.aggregate(F.sequence(F.lit(0), F.floor(F.size(s) / 64).cast("int")), F.array(F.lit(0)),
                            lambda a, b: F.array_append(a, F.element_at(a, -1) + block(s, b, F.lit(64))))),
        lambda sums: F.transform(s, lambda _, i: sums[F.floor(i / 64).cast("int")] + block(s, F.floor(i / 64).cast("int"), i % 64 + 1))))))


def _spans(text: Column, kind: str, pattern: str, gate: str) -> Column:
    """``array<struct<k, start, end, value, before, after>>`` of the matches of a pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    made = F.flatten(F.transform(F.array(F.struct(found.alias("m"), F.split(text, pattern, -1).alias("g"))), lambda x: F.flatten(F.transform(
        F.array(F.struct(x["m"].alias("m"), _positions(x["m"], x["g"]).alias("e"))), lambda y: F.transform(y["m"], lambda m, i: F.struct(
            F.lit(ALL_KINDS.index(kind)).alias("k"), (y["e"][i] - F.char_length(m)).alias("start"), y["e"][i].alias("end"), m.alias("value"),
            F.substring(text, F.greatest(y["e"][i] - F.char_length(m) - BEFORE + 1, F.lit(1)), F.least(y["e"][i] - F.char_length(m), F.lit(BEFORE))).alias("before"),
            F.substring(text, y["e"][i] + 1, F.lit(1)).alias("after")))))))
    none = F.array().cast("array<struct<k:int,start:int,end:int,value:string,before:string,after:string>>")
    return F.when(text.rlike(gate), made).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    last = F.split(F.reverse(number), "")
    each = F.transform(last, lambda c, i: F.when(i % 2 == 0, c).otherwise(F.translate(c, "0123456789", "0246813579")))
    return F.aggregate(each, F.lit(0), lambda a, c: a + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The check that a strict match must pass."""
    if kind == "ip":
        parts = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
        return F.forall(parts, lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return F.char_length(digits(value)).between(12, 19) & luhn(digits(value))
    if kind == "phone":
        return F.char_length(digits(value)).between(9, 15)
    return F.lit(True)


def _plain(kind: str, value: Column) -> Column:
    """A value as its labelers read it: an address without its disguise, digits alone, or as it is."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(value, r"(?i) ?(@|[\[({](at|@)[\])}]) ?", "@"), r"(?i) ?(\.|[\[({](dot|\.)[\])}]) ?", ".")
    return value if kind == "secret" else digits(value)


def _checked(kind: str, value: Column) -> Column:
    """The check as a labeler: on every candidate, however it was found."""
    if kind == "email":
        return _plain(kind, value).rlike(r"(?i)^[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$")
    if kind == "ip":
        return valid(kind, value) & (F.size(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))) == 4)
    if kind == "secret":
        return value.rlike(r"[0-9].*[0-9].*[0-9]") & value.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]")
    return valid(kind, value)


def _voted(kind: str, spans: Column, strict: bool) -> Column:
    """Spans with the labelers' votes and a shape."""
    def vote(s: Column) -> Column:
        opinion = lambda c: F.when(c, 1).otherwise(-1)
        against = F.lit(False) if kind == "secret" else s["before"].rlike(AGAINST)
        context = F.when(against, -1).when(s["before"].rlike(WORDS[kind]), 1).otherwise(0)
        free = F.char_length(s["before"]) == 0
        if kind == "secret":
            edge = s["before"].rlike(r"[=:]\s?[\"']?$") | (s["before"].rlike("[\"']$") & s["after"].rlike("[\"']"))
        else:
            edge = (free | ~s["before"].rlike(r"[\p{L}\p{N}_=\"'-]$")) & ~s["after"].rlike(r"[\p{L}\p{N}_=\"'-]")
        votes = F.array(F.lit(1 if strict else 0), opinion(_checked(kind, s["value"])), opinion(_plain(kind, s["value"]).rlike(GAZETTEER[kind])), context, opinion(edge))
        return F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), votes.alias("v"),
                        F.least(F.floor(F.char_length(s["value"]) / 8), F.lit(4)).cast("int").alias("shape"))
    return F.transform(spans, vote)


def _order(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))


def _matched(kind: str, ok: bool) -> Column:
    """The strict matches of a kind that pass their check, or those that fail it."""
    return F.filter(f"s_{kind}", lambda s: valid(kind, s["value"]) if ok else ~valid(kind, s["value"]) & (F.char_length(s["value"]) >= LEAST))


def _of_kind(i: int) -> Column:
    return F.filter("base", lambda s: s["k"] == i)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, more)``: strict matches that pass their checks, in order, and all other candidates."""
    one = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    one = one.select("doc_id", *[_spans(F.col("t"), k, STRICT[k], STRICT_GATE[k]).alias(f"s_{k}") for k in KINDS], *[_spans(F.col("t"), k, LOOSE[k], GATE[k]).alias(f"l_{k}") for k in ALL_KINDS])
    passed, failed = ({k: _matched(k, ok) for k in KINDS} for ok in (True, False))
    base = F.flatten(F.array(*[_voted(k, passed[k], True) for k in KINDS]))
    more = F.flatten(F.array(*[_voted(k, failed[k], True) for k in KINDS], *[_voted(k, F.col(f"l_{k}"), False) for k in ALL_KINDS]))
    return one.select("doc_id", F.array_sort(base, _order).alias("base"), more.alias("more"))


def open_candidates(found: DataFrame) -> DataFrame:
    """``(row, k, start, end, v, shape)``: the candidates of ``found`` (row, base, more) on which the classifier decides.

    Those that touch a span that stays go: in order of start, one is touched if a span before it ends
    beyond its start or one after it starts before its end. A span found twice counts once, as the
    strict pattern's.
    """
    sides = [found.select("row", F.explode(c).alias("c")).select("row", "c.*", F.lit(stays).alias("stays")) for c, stays in (("base", True), ("more", False))]
    w = Window.partitionBy("row").orderBy("start", F.col("stays").desc())
    rows = sides[0].unionByName(sides[1]).withColumn("ended", F.max(F.when(F.col("stays"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    later = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("stays"))
    rows = rows.withColumn("next", F.min(F.when(F.col("stays"), F.col("start"))).over(later.rowsBetween(Window.unboundedPreceding, 0)))
    free = rows.where("NOT stays AND (ended IS NULL OR ended <= start) AND (next IS NULL OR next >= end)")
    return free.groupBy("row", "k", "start", "end").agg(F.max(F.struct("v", "shape")).alias("m")).select("row", "k", "start", "end", "m.*")


def apart(spans: DataFrame) -> DataFrame:
    """Of ``spans`` (row, k, start, end) that touch each other, directly or by others, the longest; of equal ones the first."""
    w = Window.partitionBy("row").orderBy("start", "end", "k")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    isles = spans.withColumn("new", F.coalesce((F.col("start") >= upto).cast("int"), F.lit(1))).withColumn("isle", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("k", "start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"), -F.col("k")))
    return isles.groupBy("row", "isle").agg(best.alias("s")).select("row", "s")


def reliabilities(votes: DataFrame) -> DataFrame:
    """A row for each kind of ``votes`` (k, v, shape): ``pats`` (votes, shape, count, posterior), ``pi``, ``tp`` and ``fp`` of each labeler.

    Two classes, labelers independent given the class, abstentions missing; Beta priors keep the
    estimates inside (0, 1), and true candidates pass the check with at least ``PASSES``, which ties
    the classes to their names also where a kind has no true candidate.
    """
    pats = votes.groupBy("k", "v", "shape").agg(F.count("*").cast("double").alias("n"))
    kinds = pats.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("v", "shape", "n"))).alias("pats"))
    q = """transform(pats, p -> named_struct('v', p.v, 'shape', p.shape, 'n', p.n, 'q', 1 / (1 + exp(-(ln(s.pi / (1 - s.pi)) + aggregate(sequence(0, {last}), 0D,
             (a, j) -> a + CASE p.v[j] WHEN 1 THEN ln(s.tp[j] / s.fp[j]) WHEN -1 THEN ln((1 - s.tp[j]) / (1 - s.fp[j])) ELSE 0D END))))))""".format(last=LABELERS - 1)
    rate = "transform(sequence(0, {last}), j -> (aggregate(z, {a}, (a, p) -> a + CASE WHEN p.v[j] = 1 THEN p.n * {w} ELSE 0D END)) / (aggregate(z, {b}, (a, p) -> a + CASE WHEN p.v[j] <> 0 THEN p.n * {w} ELSE 0D END)))"
    step = f"""element_at(transform(array({q}), z -> named_struct(
        'pi', (aggregate(z, 1D, (a, p) -> a + p.n * p.q)) / (aggregate(z, 2D, (a, p) -> a + p.n)),
        'tp', transform({rate.format(last=LABELERS - 1, a='8D', b='10D', w='p.q')}, (x, j) -> if(j = {CHECK}, greatest(x, {PASSES}D), x)),
        'fp', {rate.format(last=LABELERS - 1, a='2D', b='10D', w='(1 - p.q)')})), 1)"""
    start = f"named_struct('pi', 0.5D, 'tp', transform(array_repeat(0.8D, {LABELERS}), (x, j) -> if(j = {CHECK}, {PASSES}D, x)), 'fp', array_repeat(0.2D, {LABELERS}))"
    out = kinds.withColumn("s", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {step})"))
    return out.select("k", F.expr(q).alias("pats"), "s.pi", "s.tp", "s.fp")


def classifier(trust: DataFrame) -> DataFrame:
    """``(k, prior, weights)``: naive Bayes over votes ('0:1' ...) and the shape ('s:2'), from the posteriors."""
    feats = "concat(transform(p.v, (x, j) -> concat(j, ':', x)), array(concat('s:', p.shape)))"
    sums = trust.withColumn("p", F.explode("pats")).withColumn("f", F.explode(F.expr(feats))).groupBy("k", "f").agg(
        F.sum(F.expr("p.n * p.q")).alias("yes"), F.sum(F.expr("p.n * (1 - p.q)")).alias("no"))
    whole = trust.select("k", F.expr("aggregate(pats, 0D, (a, p) -> a + p.n * p.q)").alias("y"), F.expr("aggregate(pats, 0D, (a, p) -> a + p.n * (1 - p.q))").alias("m"))
    return sums.join(whole, "k").groupBy("k").agg(
        F.first(F.log((F.col("y") + 1) / (F.col("m") + 1))).alias("prior"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("f", F.log((F.col("yes") + 0.5) / (F.col("y") + 2)) - F.log((F.col("no") + 0.5) / (F.col("m") + 2)))))).alias("weights"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans, secrets)``: arrays of ``(k, start, end)`` by start, then kind, ends exclusive, in code points.

    ``base`` holds the checked matches of the strict patterns; ``spans`` holds them and what the
    classifier accepts besides (of those that touch each other the longest, then the first); ``secrets``
    holds the secrets it accepts. Null and empty texts have none; rows that repeat are answered alike; an
    empty table trains nothing and gives an empty result.
    """
    found = written(candidates(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pii")
    some = found.where("size(base) > 0 OR size(more) > 0").select("row", "base", "more")
    free = written(open_candidates(some), "open")
    votes = found.select(F.explode("base").alias("c")).select("c.k", "c.v", "c.shape").unionByName(free.select("k", "v", "shape"))
    # A row for each of at most five kinds.
    model = written(classifier(written(reliabilities(votes), "trust")), "model")
    names = F.concat(F.transform("v", lambda x, j: F.concat(j.cast("string"), F.lit(":"), x.cast("string"))), F.array(F.concat(F.lit("s:"), F.col("shape").cast("string"))))
    logit = F.aggregate(names, F.col("prior"), lambda a, f: a + F.coalesce(F.try_element_at("weights", f), F.lit(0.0)))
    # What fails its check is never taken, whatever the other votes.
    sure = (F.col("v")[CHECK] == 1) & (1 / (1 + F.exp(-logit)) >= ACCEPT)
    taken = apart(free.join(F.broadcast(model), "k").where(sure))
    taken = written(taken.groupBy(F.col("row").alias("r")).agg(F.collect_list("s").alias("s")), "taken")
    both = found.join(taken, F.col("row") == F.col("r"), "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<k:int,start:int,end:int>>")))
    bare = F.transform("base", lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end")))
    return both.select("doc_id", bare.alias("base"), F.array_sort(F.concat(bare, F.filter("s", lambda s: s["k"] < len(KINDS))), _order).alias("spans"),
                       F.array_sort(F.filter("s", lambda s: s["k"] == len(KINDS)), _order).alias("secrets"))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(_of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
                      _joined("secrets").alias("secrets"), (F.size("spans") + F.size("secrets")).cast("long").alias("n_found"))
