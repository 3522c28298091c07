"""Step functions as change tables: deduplication, validity intervals, as-of and interval joins.

A change table has key columns, ``ts`` and value columns, one row an instant and key, and no row
that repeats the value before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_time(keys: Sequence[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*(order or ("ts",)))


def _bucketed(df: DataFrame, bucket: int) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col("ts") / bucket))


def beside(parts: DataFrame, few: DataFrame, on: Sequence[str]) -> DataFrame:
    """``parts`` with the columns of ``few``, which has one row for each value of ``on``; these may be null."""
    r = few.select(*[F.col(k).alias(f"_on_{k}") for k in on], *[c for c in few.columns if c not in on])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on], F.lit(True))
    return parts.join(r, same, "left").drop(*[f"_on_{k}" for k in on])


def _beside(parts: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``beside`` for each key and bucket."""
    return beside(parts, few, [*keys, "_b"])


def changed(df: DataFrame, keys: Sequence[str], fields: Sequence[str], initial: Column | None = None, bucket: int | None = None) -> DataFrame:
    """Rows whose fields differ from the key's row before; the first differs from ``initial`` or always stays.

    With ``bucket``, for tables without keys or with few, each bucket of time is compared by itself;
    its first row is compared with the last of the bucket before, of which there is one a key.
    """
    now = F.struct(*fields)
    if bucket is None:
        both = df.withColumn("_before", F.lag(now).over(by_time(keys)))
    else:
        parts = _bucketed(df, bucket)
        ends = parts.groupBy(*keys, "_b").agg(F.max_by(now, "ts").alias("_end"))
        starts = ends.select(*keys, "_b", F.lag("_end").over(by_time(keys, "_b")).alias("_start"))
        parts = parts.withColumn("_before", F.lag(now).over(by_time([*keys, "_b"])))
        both = _beside(parts, starts, keys).withColumn("_before", F.coalesce("_before", "_start")).drop("_start", "_b")
    first = now.eqNullSafe(F.struct(initial.alias(fields[0]))) if initial is not None else F.lit(False)
    return both.where(~F.when(F.col("_before").isNull(), first).otherwise(now.eqNullSafe(F.col("_before")))).drop("_before")


def intervals(df: DataFrame, keys: Sequence[str], bucket: int | None = None) -> DataFrame:
    """The change table with ``valid_from`` and ``valid_to`` (null: still holds); ``bucket`` as in ``changed``."""
    if bucket is None:
        return df.withColumn("valid_from", F.col("ts")).withColumn("valid_to", F.lead("ts").over(by_time(keys)))
    parts = _bucketed(df, bucket)
    firsts = parts.groupBy(*keys, "_b").agg(F.min("ts").alias("_first"))
    after = firsts.select(*keys, "_b", F.lead("_first").over(by_time(keys, "_b")).alias("_next"))
    both = _beside(parts.withColumn("valid_to", F.lead("ts").over(by_time([*keys, "_b"]))), after, keys)
    return both.withColumn("valid_to", F.coalesce("valid_to", "_next")).withColumn("valid_from", F.col("ts")).select(*df.columns, "valid_from", "valid_to")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: dict[str, str], right_keys: Sequence[str] | None = None,
          bucket: int | None = None) -> DataFrame:
    """``left`` with the last row of ``right`` at or before its ``ts``: fields are ``{right name: new name}``.

    One union, one shuffle on the keys and one ordered pass; rows of ``right`` at the same instant
    come first, so a value that changes just now is seen. With ``bucket`` each bucket of time is
    passed by itself and begins with what the buckets before it left.
    """
    right_keys = list(right_keys or keys)
    held = F.struct(*[F.col(a).alias(b) for a, b in fields.items()])
    r = right.select(*[F.col(a).alias(b) for a, b in zip(right_keys, keys)], F.col("ts"), F.lit(0).alias("_side"), held.alias("_held"), F.lit(None).cast(_row_type(left)).alias("_row"))
    l = left.select(*keys, "ts", F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_held"].dataType).alias("_held"), F.struct(*left.columns).alias("_row"))
    both, last = r.unionByName(l), F.last("_held", ignorenulls=True)
    if bucket is None:
        seen = both.withColumn("_last", last.over(by_time(keys, "ts", "_side").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        parts = _bucketed(both, bucket)
        ends = parts.groupBy(*keys, "_b").agg(F.max_by("_held", F.when(F.col("_side") == 0, F.col("ts"))).alias("_end"))
        before = by_time(keys, "_b").rowsBetween(Window.unboundedPreceding, -1)
        starts = ends.select(*keys, "_b", F.last("_end", ignorenulls=True).over(before).alias("_start"))
        own = by_time([*keys, "_b"], "ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
        seen = _beside(parts.withColumn("_last", last.over(own)), starts, keys).withColumn("_last", F.coalesce("_last", "_start"))
    return seen.where("_side = 1").select("_row.*", *[F.col(f"_last.{b}").alias(b) for b in fields.values()])


def overlapping(spans: DataFrame, key: str, versions: DataFrame, version_key: str, fields: dict[str, str]) -> DataFrame:
    """``spans`` (key, ``ts``, ``_to``) cut where the version of their key changes: fields are ``{version's name: new name}``.

    One join on the key, whose hot keys Spark can split; a span without a version yet, or whose key
    has none, has null fields. Rows begin at the later of span and version.
    """
    told = [F.col(a).alias(b) for a, b in fields.items()]
    v = versions.select(F.col(version_key).alias("_k"), F.col("ts").alias("_vf"), F.lead("ts").over(by_time([version_key])).alias("_vt"), *told)
    none = [F.lit(None).cast(v.schema[b].dataType).alias(b) for b in fields.values()]
    v = v.unionByName(versions.groupBy(F.col(version_key).alias("_k")).agg(F.min("ts").alias("_vt")).select("_k", F.lit(None).cast("long").alias("_vf"), "_vt", *none))
    held = (F.col(key) == F.col("_k")) & (F.col("_vf").isNull() | F.col("_to").isNull() | (F.col("_vf") < F.col("_to"))) & (F.col("_vt").isNull() | (F.col("_vt") > F.col("ts")))
    out = spans.join(v, held, "left").withColumn("ts", F.greatest("ts", "_vf"))
    return out.select(*[c for c in spans.columns if c != "_to"], *fields.values())


def _row_type(df: DataFrame):
    return df.schema


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], bucket: int) -> DataFrame:
    """Points and the spans that hold them: ``valid_from <= ts < valid_to`` for equal keys.

    Spans are cut into time buckets, so the join is an equi-join on key and bucket and a hot key is
    spread over its buckets. Spans without an end, of which a key has one, are joined by key.
    """
    p = points.withColumn("_b", F.floor(F.col("ts") / bucket))
    ended = spans.where("valid_to IS NOT NULL AND valid_to > valid_from").withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("valid_from") / bucket), F.floor((F.col("valid_to") - 1) / bucket))))
    on = [*keys, "_b"]
    closed = p.join(ended, on).where("valid_from <= ts AND ts < valid_to").drop("_b")
    still = spans.where("valid_to IS NULL")
    opened = points.join(still, list(keys)) if keys else points.join(F.broadcast(still), F.lit(True))
    return closed.unionByName(opened.where("valid_from <= ts").select(*closed.columns))


def prefix(df: DataFrame, order: Sequence[str], totals: dict[str, tuple[str, Column]], bucket: int, keys: Sequence[str] = ()) -> DataFrame:
    """Running aggregates over the whole table, or over few keys, without gathering it in a task or few.

    ``totals``: name to (kind, column), kind one of sum, count, min, max, last. Each bucket of
    ``ts`` runs by itself; the buckets' own results, a row each, are run in order, and a row takes
    what its bucket starts from.
    """
    run = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    parts = _bucketed(df, bucket)
    own = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name, (kind, c) in totals.items():
        parts = parts.withColumn(name, run[kind](c).over(own))
    total = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.struct(*order)))}
    ends = _bucketed(df, bucket).groupBy(*keys, "_b").agg(*[total[kind](c).alias(name) for name, (kind, c) in totals.items()])
    before = by_time(keys, "_b").rowsBetween(Window.unboundedPreceding, -1)
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "last": run["last"]}
    starts = ends.select(*keys, "_b", *[again[kind](name).over(before).alias(f"_s_{name}") for name, (kind, _) in totals.items()])
    both = _beside(parts, starts, keys)
    joined = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "count": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest, "last": F.coalesce}
    return both.select(*df.columns, *[joined[kind](F.col(name), F.col(f"_s_{name}")).alias(name) for name, (kind, _) in totals.items()])


def sums_as_of(df: DataFrame, sums: Sequence[str], bucket: int, keys: Sequence[str], back: int, asked: str) -> DataFrame:
    """Rows whose ``asked``, a struct, isn't null, with its fields and the running sums of whole-numbered columns as of ``back`` before ``ts``.

    As ``prefix`` for few keys, but all rows of an instant count in it: rows that move a sum need no
    order among those that ask for it, and one row may do both.
    """
    # Dealt once: the buckets' ends name the same columns as the pass itself, so both read one exchange.
    parts = _bucketed(df.repartition(*keys, F.floor(F.col("ts") / bucket)), bucket)
    ends = parts.groupBy(*keys, "_b").agg(*[F.sum(c).alias(c) for c in sums], F.count(asked).alias("_asked"))
    before = by_time(keys, "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, "_b", "_asked", *[F.sum(c).over(before).alias(f"_s_{c}") for c in sums]).where("_asked > 0").drop("_asked")
    own = by_time(["_b", *keys]).rangeBetween(Window.unboundedPreceding, -back)
    run = parts.select(*keys, "_b", "ts", asked, *[F.sum(c).over(own).alias(c) for c in sums]).where(F.col(asked).isNotNull())
    both = _beside(run, F.broadcast(starts), keys)
    return both.select(*keys, "ts", f"{asked}.*", *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"_s_{c}", F.lit(0))).alias(c) for c in sums])
