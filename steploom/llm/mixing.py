"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. Sizes are summed by source and by the hash's first bits;
the running sum shows in which bucket a source's budget ends, and only that bucket is split by
the next bits, until it holds one hash. The result is one threshold a source: a document is taken
if its hash is at most the threshold, so taking is a filter and nothing is sorted. Larger budgets
have larger thresholds: the mixes are nested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, table, written

BITS, LEVEL_BITS = 60, 10
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5: the same in every run and on every machine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), budgets: Sequence[float] = (1.0,),
            max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``(source, budget, source_size, target)`` from ``(source, source_size)``.

    Sources by code point, null last, weigh ``weights`` in turn. A budget is a share of all sizes;
    a target stops at ``max_repeat`` times its source's size and the excess goes to the others by
    weight. With sources in order of (cap / weight), those before the water level are capped, and
    the level is what is left over the weights that are left: one pass over the few sources.
    """
    n = len(weights)
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % n
    ws = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    base = sizes.select("source", "source_size", ws.alias("w")).withColumn(
        "budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
    each = Window.partitionBy("budget")
    ranked = each.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(each) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    out = (base.withColumn("cap", F.col("source_size") * float(max_repeat))
           .withColumn("total", F.sum("source_size").over(each) * F.col("budget"))
           .withColumn("level", level)
           .withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
           .withColumn("water", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "level"))).over(each)["level"]))
    return out.select("source", "budget", "source_size",
                      F.least("cap", F.coalesce("water", F.lit(float("inf"))) * F.col("w")).alias("target"))


def thresholds(slim: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``whole`` (passes over all of the source) and ``threshold`` (of the last pass).

    ``slim`` holds ``(source, size, h)``. The cut is made beside the hash at which the running sum
    comes nearest to the rest of the target.
    """
    open_ = goals.withColumn("whole", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).cast("long"))
    open_ = open_.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")) \
        .withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0.0))
    done, shift, known = None, BITS, written(open_, "mix")
    while True:
        shift -= LEVEL_BITS
        src = slim if shift == BITS - LEVEL_BITS else slim.withColumn("prefix", F.shiftright("h", shift + LEVEL_BITS))
        src = src.withColumn("k", F.col("source").isNull()).withColumn("s", F.coalesce("source", F.lit("")))
        at = known.withColumn("k", F.col("source").isNull()).withColumn("s", F.coalesce("source", F.lit("")))
        if shift == BITS - LEVEL_BITS:
            hist = src.groupBy("k", "s", F.shiftright("h", shift).alias("bucket")).agg(
                F.sum("size").alias("size"), F.min("h").alias("h0"), F.max("h").alias("h1"))
            cells = at.join(hist, ["k", "s"])
        else:
            hist = src.join(at.select("k", "s", "prefix").distinct(), ["k", "s", "prefix"]).groupBy(
                "k", "s", "prefix", F.shiftright("h", shift).alias("bucket")).agg(
                F.sum("size").alias("size"), F.min("h").alias("h0"), F.max("h").alias("h1"))
            cells = at.join(hist, ["k", "s", "prefix"])
        run = Window.partitionBy("k", "s", "budget").orderBy("bucket")
        cells = cells.withColumn("upto", F.col("below") + F.sum("size").over(run))
        # The bucket in which the budget ends: the first whose running sum passes the rest.
        first = cells.where(F.col("upto") > F.col("rest")).groupBy("k", "s", "budget").agg(
            F.min_by(F.struct("source", "source_size", "target", "whole", "rest", "bucket", "size", "upto", "h0", "h1"), "bucket").alias("x")).select("budget", "x.*")
        found = written(first.select(
            "source", "budget", "source_size", "target", "whole", "rest", F.col("bucket").alias("prefix"),
            (F.col("upto") - F.col("size")).cast("double").alias("below"), F.col("upto").cast("double").alias("upto"),
            (F.col("h0") == F.col("h1")).alias("single"), "h0"), "mix")
        nearer = F.when(F.col("upto") - F.col("rest") < F.col("rest") - F.col("below"), F.col("h0")).otherwise(F.col("h0") - 1)
        ended = found.where("single").select("source", "budget", nearer.alias("threshold"))
        done = ended if done is None else done.unionByName(ended)
        if shift == 0 or not found.where("not single").limit(1).count():
            break
        known = found.where("not single").drop("upto", "single", "h0")
    t = done.select(F.col("source").alias("t_source"), F.col("budget").alias("t_budget"), "threshold")
    return open_.join(t, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("budget") == F.col("t_budget")), "left").select(
        "source", "budget", "source_size", "target", "whole", F.coalesce("threshold", F.lit(-1)).alias("threshold"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), budgets: Sequence[float] = (1.0,),
        max_repeat: float = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, budget, source_size, target, copies, taken)``, a row for each document and budget.

    ``copies`` is how often the mix takes the document (0 to ``max_repeat``), ``taken`` the words
    that makes. Null texts have size 0; null sources are one source; repeated rows of one id share
    a hash and so are taken together; an empty table gives an empty mix.
    """
    slim = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                               word_count(F.col(text_col)).alias("size"), doc_hash(F.col(id_col)).alias("h")), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = written(thresholds(slim, written(targets(sizes, weights, budgets, max_repeat), "mix")), "mix")
    cuts = cuts.withColumnRenamed("source", "cut_source")
    # Cuts are a row a source: Spark broadcasts them if their file is small, and joins by key if not.
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")) == F.coalesce(F.concat(F.lit("="), "cut_source"), F.lit("~"))
    copies = _copies(F.col("whole"), F.col("h"), F.col("threshold"), max_repeat)
    return slim.join(cuts, key).select("doc_id", "source", "size", "h", "budget", "source_size", "target",
                                       copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _copies(whole: Column, h: Column, threshold: Column, max_repeat: float) -> Column:
    """Passes over all of the source and the last, never more than ``max_repeat`` (documents without words cost no budget)."""
    return F.least(whole + (h <= threshold).cast("long"), F.lit(int(max_repeat)).cast("long"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), budgets: Sequence[float] = (1.0,), max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``docs`` (doc_id, text, source and others) as the mix takes them: each row as often as its ``copies``, none for 0.

    With several budgets the mixes stand together. Null texts have size 0, null sources are one
    source, rows that repeat an id are taken together, and an empty table gives an empty mix.
    """
    slim = written(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"),
                               word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h")), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = written(thresholds(slim, written(targets(sizes, weights, budgets, max_repeat), "mix")), "mix").select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")).alias("_cut_key"), F.col("whole").alias("_cut_whole"), F.col("threshold").alias("_cut_at"))
    discard(slim)
    both = docs.withColumn("_cut_key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))).join(cuts, "_cut_key")
    copies = _copies(F.col("_cut_whole"), doc_hash(F.col("doc_id")), F.col("_cut_at"), max_repeat).cast("int")
    return both.withColumn("_cut_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
r AS (SELECT *, 3.0 * source_size / w AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(3.0 * source_size) OVER b, 0))
              / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM r
      WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size,
             least(3.0 * source_size, w * (SELECT arg_min(level, ratio) FROM l WHERE level * w <= 3.0 * source_size)) AS target FROM l),
u AS (SELECT *, floor(target / source_size)::BIGINT AS whole, target - floor(target / source_size) * source_size AS rest FROM t),
c AS (SELECT d.*, u.source_size, u.target, u.whole, u.rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING)::DOUBLE AS upto,
             sum(size) OVER (PARTITION BY d.source, h)::DOUBLE AS own
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, taken, copies FROM (
  SELECT doc_id, size, source_size, target, least(whole + k, 3) AS copies, least(whole + k, 3) * size AS taken FROM (
    SELECT *, CASE WHEN upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END AS k FROM c))
"""
