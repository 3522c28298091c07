"""State machines: a value whose new state is a function of the old one and the event."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .stream import Stream, Value
from .timeline import by_time, prefix


def tagged(*streams: Stream, fields: tuple[str, ...] = ()) -> DataFrame:
    """The events of several listeners in one frame, numbered in order of declaration."""
    frames = []
    for i, s in enumerate(streams):
        have = set(s.df.columns)
        frames.append(s.df.select(*s.keys, "ts", F.lit(i).alias("listener"), "seq", *[F.col(f) if f in have else F.lit(None).alias(f) for f in fields]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def counter(keys: tuple[str, ...], events: DataFrame, step: Column, initial: float = 0, bucket: int = 86_400_000_000) -> Value:
    """A listener whose events only add to the state: a running sum, also without keys in many tasks."""
    order = ["ts", "listener", "seq"]
    if keys:
        w = by_time(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
        rows = events.withColumn("value", F.sum(step).over(w) + initial)
    else:
        rows = prefix(events.withColumn("_d", step), order, {"value": ("sum", F.col("_d"))}, bucket).withColumn("value", F.col("value") + initial)
    last = rows.groupBy(*keys, "ts").agg(F.max_by("value", F.struct("listener", "seq")).alias("value"))
    return Value(last, keys, "value", bucket).distinct_until_changed(F.lit(initial))


def resetting(keys: tuple[str, ...], events: DataFrame, step: Column, reset: Column, initial: float = 0) -> Value:
    """A listener whose events add to the state or set it back to ``initial``: a running sum within each stretch, in the JVM."""
    order = ["ts", "listener", "seq"]
    w = by_time(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    back = F.coalesce(reset, F.lit(False))
    cut = events.withColumn("_reset", back).withColumn("_part", F.sum(back.cast("int")).over(w))
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumn("value", F.sum(F.when(F.col("_reset"), F.lit(0)).otherwise(step)).over(own) + initial)
    last = rows.groupBy(*keys, "ts").agg(F.max_by("value", F.struct("listener", "seq")).alias("value"))
    return Value(last, keys).distinct_until_changed(F.lit(initial))


def fold(keys: tuple[str, ...], events: DataFrame, step: Callable[[object, dict], object], initial: object, kind: str) -> Value:
    """Any listener: ``state = step(state, event)`` in order of time, declaration and place, per key.

    Rows are dealt by key and sorted by Spark, then streamed as Arrow batches, so a key's history is
    never held in memory; only the states of a batch are. Events are plain Python values: a null is
    None, whole numbers are exact, null keys are one key. Several events of one instant give one
    change. Without keys it is sequential by nature and runs in one task.
    """
    keys = tuple(keys)
    names = events.columns
    types = dict(events.dtypes)
    out_schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "ts long", f"value {kind}"])
    spec = to_arrow_schema(events.sparkSession.createDataFrame([], out_schema).schema)
    ids = [names.index(k) for k in keys]
    at = names.index("ts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held = None, initial, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(spec)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, spec)], schema=spec)

        for b in batches:
            rows = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                own = tuple(r[i] for i in ids)
                if held is not None and (own != key or r[at] != held[len(keys)]):
                    rows.append(held)
                    held = None
                if own != key:
                    key, state = own, initial
                state = step(state, dict(zip(names, r)))
                held = (*own, r[at], state)
            if rows:
                yield batch(rows)
        if held is not None:
            yield batch([held])

    dealt = events.repartition(*keys) if keys else events.repartition(1)
    rows = dealt.sortWithinPartitions(*keys, "ts", "listener", "seq").mapInArrow(run, out_schema)
    first = F.lit(initial).cast(kind) if initial is None or isinstance(initial, (int, float, str, bool)) else None
    return Value(rows, keys, "value").distinct_until_changed(first)


def ema(s: Stream, field: str, n: int) -> Value:
    """An exponential moving average: the mean of the first ``n`` values, then ``x / k + (1 - 1/k) ema`` with k = (n + 1) / 2."""
    a = 2.0 / (n + 1)

    def step(state, e):
        if e[field] is None:  # an unknown value changes nothing
            return state
        count, total, value = (state["n"], state["total"], state["value"]) if state else (0, 0.0, None)
        x, count = float(e[field]), count + 1
        return {"n": count, "total": total + x, "value": (total + x) / count if count <= n else a * x + (1 - a) * value}

    events = tagged(s, fields=(field,))
    folded = fold(s.keys, events, step, None, "struct<n:long,total:double,value:double>")
    return Value(folded.df.select(*s.keys, "ts", F.col("value.value").alias("value")), s.keys).distinct_until_changed()
