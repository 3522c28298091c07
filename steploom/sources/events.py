"""Sources and sinks: CSV with comments and imports, Parquet, clocks, and actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stream import Stream


def csv_stream(spark: SparkSession, path: str, schema: str, lower: bool = True) -> Stream:
    """A stream from a text file: header line, ``#`` starts a comment, blank lines do not count.

    ``schema`` types the fields by name; it must hold ``timestamp``. A first line
    ``# import "other"`` reads that file instead. ``seq`` is the row's place in the file.
    """
    first = spark.read.text(path).limit(1).collect()
    if first and (got := first[0][0].strip()).startswith("# import"):
        return csv_stream(spark, f"{path.rsplit('/', 1)[0]}/{got.split('"')[1]}", schema, lower)
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.trim(F.regexp_replace("value", "#.*", "")).alias("line")).where("line <> ''")
    return _typed(lines, schema, lower)


def csv_text(spark: SparkSession, text: str, schema: str, lower: bool = True) -> Stream:
    """The same from a small string, such as a test's."""
    rows = [(i, x.split("#")[0].strip()) for i, x in enumerate(text.splitlines())]
    return _typed(spark.createDataFrame([r for r in rows if r[1]], "seq long, line string"), schema, lower)


def _typed(lines: DataFrame, schema: str, lower: bool) -> Stream:
    first = lines.orderBy("seq").limit(1).collect()
    if not first:  # no header: a stream of the schema without events
        fields = ", ".join("ts " + p.split()[1] if p.split()[0] == "timestamp" else p.strip() for p in schema.split(","))
        return Stream(lines.sparkSession.createDataFrame([], f"{fields}, seq long"))
    head = first[0]
    names = [x.strip().lower() if lower else x.strip() for x in head["line"].split(",")]
    types = dict(p.split() for p in schema.split(","))
    parts = F.split("line", ",")
    cols = [F.trim(parts[i]).cast(types.get(n, "string")).alias("ts" if n == "timestamp" else n) for i, n in enumerate(names)]
    return Stream(lines.where(F.col("seq") != head["seq"]).select(*cols, "seq"))


def ticks(spark: SparkSession, first: int, last: int, step: int = 1) -> Stream:
    """A clock: one event each ``step`` seconds; made where it is used, not on the driver."""
    return Stream(spark.range(first, last + 1, step).select(F.col("id").alias("ts"), F.lit(0).cast("long").alias("seq")))


def at_times(clock: Stream, period: int, offset: int = 0) -> Stream:
    """Pulses of a clock each ``period`` seconds, such as each day at a time."""
    return clock.where(F.col("ts") % period == offset)


def daily_at(clock: Stream, hour: int, minute: int = 0, second: int = 0, unit: int = 1) -> Stream:
    """Pulses of a clock each day at a time; ``unit`` is the number of ``ts`` in a second."""
    return at_times(clock, 86_400 * unit, (hour * 3600 + minute * 60 + second) * unit)


def show(x, n: int = 20) -> None:
    """``print``: a batch's first rows in order of time."""
    x.df.orderBy("ts").show(n, truncate=False)


def on_update(df: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``action`` on each micro-batch of a streaming frame."""
    return df.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).start()


def sequenced(df: DataFrame, ts: str, seq: str) -> Stream:
    """A table as a stream: ``ts`` in microseconds for timestamps, else as it is."""
    kind = dict(df.dtypes)[ts]
    t = F.unix_micros(F.col(ts).cast("timestamp")) if kind.startswith("timestamp") else F.unix_micros(F.col(ts).cast("timestamp")) if kind == "date" else F.col(ts).cast("long")
    rest = [c for c in df.columns if c not in (ts, "ts", "seq")]
    return Stream(df.select(t.alias("ts"), F.col(seq).cast("long").alias("seq"), *rest))


__all__ = ["csv_stream", "csv_text", "ticks", "at_times", "daily_at", "show", "on_update", "sequenced"]
