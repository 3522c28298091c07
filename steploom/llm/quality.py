"""Quality rules with risk-controlled thresholds, in DataFrame and SQL functions only.

Four graded rules measure a document; higher is worse. They tighten together along a fixed ladder of
levels: a document is rejected at a level if any rule is at or over its cutoff there. Labelled good
documents are a holdout: for every stratum (language), levels are tested from lenient to strict. A
level passes if the exact binomial tail shows that its joint verdict rejects at most ``risk`` of the
good documents that pass the base rules: P(X <= rejected | n, risk) <= the stratum's share of
``delta``, the Clopper-Pearson bound. Within a stratum levels are tested in fixed sequence and testing
stops at the first that fails, so no further correction is due; over strata the shares add up to
``delta`` (a weighted Bonferroni correction): with probability 1 - delta no stratum's verdict rejects
more than ``risk`` of its good documents. The strictest level that passed is used.

A stratum can be certified at all only if its share is at least (1 - risk)^n, which depends on the
number n of its good labels alone: shares are given out in ascending order of that need while
``delta`` lasts, and what is left is dealt equally among those that got theirs. With the defaults
alone a stratum needs 299 good labels. Strata beyond that are unjudged: only the base rules reject
there, and ``calibrate`` gives them as rows without a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, table, written

#: The graded rules and their cutoffs at each level, from lenient to strict, fixed before any label is seen.
GRIDS = {
    "symbols": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.3, 0.3],
    "repeats": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.3, 0.3],
    "shouting": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.3, 0.3],
}
RISK, DELTA = 0.01, 0.05


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))


def _repeat_words(w: Column) -> Column:
    """Words that stand in a 3-word window which the text holds twice or more.

    Window hashes are sorted with their places; equal neighbours mark their places; the marked
    windows [p, p + 2] are then counted as a union: three words for the last, the step to the
    next, or three, for the others. All of it is O(n log n) in the length of the text.
    """
    return F.transform(F.array(w), _repeats_in)[0]


def _repeats_in(w: Column) -> Column:
    n = F.size(w)
    tri = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("p")))
    return F.when(n < 4, F.lit(0)).otherwise(F.aggregate(
        F.array(F.sort_array(tri)), F.lit(0), lambda _, s: _union(_marked(s))))


def _marked(s: Column) -> Column:
    k = F.size(s)
    same = F.filter(F.sequence(F.lit(0), k - 1), lambda i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == s[i]["h"])) | (
        (i < k - 1) & (s[F.least(i + 1, k - 1)]["h"] == s[i]["h"])))
    return F.sort_array(F.transform(same, lambda i: s[i]["p"]))


def _union(p: Column) -> Column:
    return F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                       lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])


def _counts(text: Column) -> Column:
    """A struct of the counts of one text; texts, words and lines are bound once, as lambda variables."""
    bound = F.array(F.struct(text.alias("t"), words(text).alias("w"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l")))
    return F.transform(bound, lambda b: F.struct(
        F.size(b["w"]).cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(b["t"], BLANKS, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(b["t"], r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.when(F.size(b["l"]) < 2, 0).otherwise(F.size(b["l"]) - F.size(F.array_distinct(b["l"]))).cast("long").alias("n_dup_lines"),
        _repeat_words(b["w"]).cast("long").alias("n_repeat_words"),
        F.size(b["l"]).cast("long").alias("n_lines"),
        F.char_length(F.regexp_replace(b["t"], r"[^\p{Lu}]+", "")).cast("long").alias("n_upper")))[0]


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with the counts of the rules; null text has none of anything."""
    one = docs.select(*keep, _counts(F.coalesce(F.col(text_col), F.lit(""))).alias("_q"))
    return one.select(*keep, *[F.col("_q")[c].alias(c) for c in COUNTS])


BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "shouting": "n_upper / greatest(word_chars, 1)",
}


def _bad(cutoffs: dict[str, Column]) -> Column:
    """Whether any rule is at or over its cutoff (null: it has none)."""
    bad = F.lit(False)
    for k, e in RULES.items():
        bad = bad | F.coalesce(F.expr(e) >= cutoffs[k], F.lit(False))
    return bad


def calibrate(scored: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``(stratum, n, share, symbols, dup_lines, repeats, shouting)``, a row for each stratum with good labels.

    ``n`` counts its good documents that pass the base rules, ``share`` is its part of ``delta`` (null:
    too few labels, unjudged), and the cutoffs are those of the strictest level that passed (null:
    none). ``labels`` holds ``(doc_id, quality)``; good is quality 1. Labels that repeat or contradict
    each other count once, as good if any says so; rows that repeat an id count once. Null strata are
    one stratum, ''. Without good labels there is no row.
    """
    good = labels.where("doc_id IS NOT NULL AND quality = 1").select("doc_id").distinct()
    held = scored.where(F.col("doc_id").isNotNull()).where(f"NOT {BASE_FAILED}").dropDuplicates(["doc_id"]).join(good, "doc_id")
    held = held.withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    # One row a stratum with all counts: what the joint verdict of each level rejects.
    levels = range(len(GRIDS["symbols"]))
    rejected = [F.sum(_bad({k: F.lit(grid[i]) for k, grid in GRIDS.items()}).cast("long")) for i in levels]
    counts = held.groupBy("stratum").agg(F.count("*").alias("n"), F.array(*rejected).alias("rejected"))
    # The strata's shares: needs in ascending order while delta lasts, the rest dealt equally.
    order = Window.partitionBy(F.lit(1)).orderBy("need", "stratum")
    counts = counts.withColumn("need", F.exp(F.col("n") * F.log1p(F.lit(-float(risk)))))
    counts = counts.withColumn("upto", F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    able = counts.withColumn("able", F.col("upto") <= float(delta))
    all_ = Window.partitionBy(F.lit(1))
    left = (F.lit(float(delta)) - F.sum(F.when(F.col("able"), F.col("need")).otherwise(0.0)).over(all_)) / F.sum(F.col("able").cast("int")).over(all_)
    shared = able.withColumn("share", F.when(F.col("able"), F.col("need") + left))
    tested = shared.select("stratum", "n", "share", F.posexplode("rejected").alias("level", "x"))
    # P(X <= x) of Binomial(n, risk): the logarithms of the terms by their ratios, then a log-sum.
    n, r = F.col("n"), F.lit(float(risk))
    step = F.log(r) - F.log1p(-r)
    tail = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(F.col("x"), F.lit(1).cast("long"))),
        F.struct((n * F.log1p(-r)).alias("t"), (n * F.log1p(-r)).alias("s")),
        lambda a, i: F.when(i > F.col("x"), a).otherwise(F.struct(
            (a["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + step).alias("t"),
            _logadd(a["s"], a["t"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + step).alias("s"))),
        lambda a: F.exp(a["s"]))
    # With x >= n * risk the tail is over a third, never under delta: no sum needed. A share that is just the need passes at x = 0.
    passed = F.when(F.col("share").isNull() | (F.col("x") >= n * r), F.lit(False)).otherwise(tail <= F.col("share") * (1 + 1e-9))
    run = Window.partitionBy("stratum").orderBy("level")
    walked = tested.withColumn("ok", F.min(passed.cast("int")).over(run))
    best = walked.groupBy("stratum", "n", "share").agg(F.max(F.when(F.col("ok") == 1, F.col("level"))).alias("level"))
    return best.select("stratum", "n", "share", *[F.get(F.array(*[F.lit(c) for c in grid]), F.coalesce("level", F.lit(len(grid)))).alias(k) for k, grid in GRIDS.items()])


def _logadd(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def judged(scored: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``scored`` with ``base_failed`` and ``kept``; a stratum without cutoffs keeps all that pass the base."""
    c = cutoffs.select(F.col("stratum").alias("_q_stratum"), *[F.col(k).alias(f"_q_{k}") for k in GRIDS])
    both = scored.withColumn("_q_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(c, "_q_stratum", "left")
    bad = _bad({k: F.col(f"_q_{k}") for k in GRIDS})
    return both.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & ~bad).drop("_q_stratum", *[f"_q_{k}" for k in GRIDS])


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``(doc_id, stratum, counts, base_failed, kept)`` for every row of ``docs`` (doc_id, text, stratum).

    An empty text has no words and fails the base; an empty label table leaves the base alone to
    judge; rows that repeat are judged alike. The texts are read once and never moved.
    """
    scored = written(measured(docs, ["doc_id", stratum]), "quality")
    return judged(scored, written(calibrate(scored, labels, stratum, risk, delta), "cutoffs"), stratum)


def good_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns (names that begin with ``_q_`` are reserved).

    Rows are written once with their counts, so that each text is measured once and none is
    shuffled: the counts alone meet the labels, and the few cutoffs come back to the rows.
    Null and empty texts fail the base rules; rows that repeat are judged alike; empty tables give
    an empty result.
    """
    one = docs.withColumn("_q_counts", _counts(F.coalesce(F.col("text"), F.lit(""))))
    rows = written(one, "measured")
    slim = rows.select("doc_id", stratum, *[F.col("_q_counts")[c].alias(c) for c in COUNTS])
    cutoffs = written(calibrate(slim, labels, stratum, risk, delta), "cutoffs")
    apart = rows.select(F.struct(*docs.columns).alias("_q_row"), F.col(stratum).alias(stratum), *[F.col("_q_counts")[c].alias(c) for c in COUNTS])
    return judged(apart, cutoffs, stratum).where("kept").select("_q_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The counts of a text, and the fixed sequence of binomial tests, as above.
OP6_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], chr(10)))) AS g FROM t WHERE len(w) >= 3),
m AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM m WHERE c > 1) GROUP BY doc_id),
s AS (SELECT t.doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper FROM t LEFT JOIN r USING (doc_id)),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS a, n_dup_lines / greatest(n_lines, 1) AS b,
    n_repeat_words / greatest(n_words, 1) AS c, n_upper / greatest(word_chars, 1) AS d FROM s),
z AS (SELECT unnest(range(9)) AS level, unnest([0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06]::DOUBLE[]) AS za, unnest([0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.3, 0.3]::DOUBLE[]) AS zb),
h AS (SELECT q.* FROM q WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
x AS (SELECT lang, level, count(*) AS n, sum(CASE WHEN a >= za OR b >= zb OR c >= zb OR d >= zb THEN 1 ELSE 0 END) AS x FROM h, z GROUP BY ALL),
e AS (SELECT lang, n, exp(n * ln(0.99::DOUBLE)) AS need FROM x WHERE level = 0),
f AS (SELECT lang, need, sum(need) OVER (ORDER BY need, lang) <= 0.05 AS able FROM e),
v AS (SELECT lang, need + (0.05 - (SELECT sum(need) FROM f WHERE able)) / (SELECT count(*) FROM f WHERE able) AS share FROM f WHERE able),
p AS (SELECT x.lang, level, x < n * 0.01 AND list_sum(list_transform(range(0, x::BIGINT + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01::DOUBLE) + (n - i) * ln(0.99::DOUBLE))))
    <= share * (1 + 1e-9) AS ok FROM x JOIN v USING (lang)),
k AS (SELECT lang, max(level) AS level FROM (SELECT lang, level, bool_and(ok) OVER (PARTITION BY lang ORDER BY level) AS ok FROM p) WHERE ok GROUP BY lang)
SELECT q.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND NOT coalesce(a >= za OR b >= zb OR c >= zb OR d >= zb, FALSE) AS kept
FROM q LEFT JOIN k USING (lang) LEFT JOIN z USING (level)
"""
