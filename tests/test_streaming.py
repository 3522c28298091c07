"""Streaming gives what batch gives."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from steploom.operators.stream import Stream
from steploom.streaming.live import latest, listener, shown, sliding, sliding_sum

ROWS = [(2, 1, 25), (4, 3, 45), (5, 1, 25), (6, 2, 50), (7, 3, 30), (9, 1, 23)]


def _source(spark, tmp_path, rows):
    for i, r in enumerate(rows):
        path = tmp_path / f"in-{i:03}.json"
        pd.DataFrame([r], columns=["t", "room", "temp"]).to_json(path, orient="records", lines=True)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in order of their times
    raw = spark.readStream.schema("t long, room long, temp long").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    return raw.withColumn("ts", F.timestamp_seconds("t"))


def _run(df, name, tmp_path, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def _batch(spark):
    return Stream(spark.createDataFrame(ROWS, "ts long, room long, temp long").withColumn("seq", F.lit(0).cast("long")), ("room",))


@pytest.mark.parametrize("kind", ["sum", "count", "min", "max"])
def test_sliding_is_the_batch_window(spark, tmp_path, kind):
    (tmp_path / "in").mkdir()
    src = _source(spark, tmp_path / "in", [*ROWS, (60, 9, 0)])
    got = _run(sliding(src, "room", "ts", "temp", 3000, kind), f"sliding_{kind}", tmp_path / "cp", "append")
    got = sorted((r["ts_ms"] // 1000, int(r["key"]), r["value"]) for r in got.collect() if r["key"] != "9")
    want = sorted((r["ts"], r["room"], r["value"]) for r in _batch(spark).window(3).agg(kind, "temp").df.collect())
    assert got == want


def test_sliding_sum_has_totals(spark):
    assert sliding_sum(_static(spark), "room", "ts", "temp", 3000).columns == ["key", "ts_ms", "total", "n"]


def _static(spark):
    return spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.lit(1).alias("room"), F.col("value").alias("temp"))


def test_shown_is_the_batch_changelog(spark, tmp_path):
    (tmp_path / "in").mkdir()
    src = _source(spark, tmp_path / "in", [*ROWS, (60, 9, 0)])
    got = _run(shown(src, "room", "ts", "temp", lambda x: x > 30), "shown", tmp_path / "cp", "append")
    got = sorted((r["ts_ms"] // 1000, int(r["key"]), r["op"], r["value"]) for r in got.collect())
    want = sorted((r["ts"], r["room"], r["op"], r["value"]) for r in _batch(spark).last("temp").where(F.col("value") > 30).collect())
    assert got == [(4, 3, "SET", 45.0), (6, 2, "SET", 50.0), (7, 3, "DEL", None)] == want


def test_latest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = _run(latest(_source(spark, tmp_path / "in", ROWS), "room", "ts", "temp"), "latest", tmp_path / "cp", "complete")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 23), (2, 50), (3, 30)]


def test_stateless_operators_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    src = _source(spark, tmp_path / "in", ROWS)
    s = Stream(src.select(F.col("t").alias("ts"), F.lit(0).alias("seq"), "room", "temp")).where("temp > 30").select(double=F.col("temp") * 2)
    got = _run(s.df, "stateless", tmp_path / "cp", "append")
    assert sorted(r["double"] for r in got.collect()) == [90, 100]


def test_listener_gives_each_change_in_order_of_time(spark, tmp_path):
    (tmp_path / "in").mkdir()
    late = [ROWS[1], ROWS[0], ROWS[3], ROWS[2], *ROWS[4:], (60, 9, 0)]  # out of order between batches, within the lateness
    src = _source(spark, tmp_path / "in", late)
    step = lambda s, e: s + e["temp"]
    got = _run(listener(src, "room", "ts", step, 0, "total long", lambda s: {"total": s}, ["t"], "5 seconds"), "listened", tmp_path / "cp", "append")
    got = sorted((r["ts_ms"] // 1000, int(r["key"]), r["total"]) for r in got.collect() if r["key"] != "9")
    want = sorted((r["ts"], r["room"], r["value"]) for r in _batch(spark).agg("sum", "temp").df.collect())
    assert got == want


def test_listener_forgets(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(2, 1, 25), (20, 2, 1), (21, 2, 1), (30, 1, 7), (60, 9, 0), (90, 9, 0)]
    src = _source(spark, tmp_path / "in", rows)
    step = lambda s, e: s + e["temp"]
    got = _run(listener(src, "room", "ts", step, 0, "total long", lambda s: {"total": s}, ["t"], retention_ms=10_000), "forgot", tmp_path / "cp", "append")
    assert sorted((r["ts_ms"] // 1000, r["total"]) for r in got.collect() if r["key"] == "1") == [(2, 25), (30, 7)]
