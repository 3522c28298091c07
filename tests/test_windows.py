"""Aggregates of event windows whose cost does not depend on how many events a window holds."""

import random
import re

import pytest
from pyspark.sql import functions as F

import steploom.plans.applications  # noqa: F401  (registers its queries)
import steploom.plans.catalogue as catalogue
from steploom.operators.stream import Stream
from steploom.plans.applications import tolls


def rows_of(n=120, seed=3):
    """Times before and after 0, several at an instant; null keys and values; a gap longer than a window."""
    r = random.Random(seed)
    return [(r.randint(-40, 40) if i % 9 else 400, i, r.choice(["a", "b", None]), r.choice([None, *range(-5, 9)])) for i in range(n)]


def brute(rows, length, kind, keyed):
    out = set()
    for k in {x[2] for x in rows} if keyed else {None}:
        mine = [x for x in rows if not keyed or x[2] == k]
        was, first = {"any": False, "all": True}.get(kind), kind not in ("any", "all")
        for t in sorted({x[0] for x in mine} | {x[0] + length for x in mine}):
            v = [x[3] for x in mine if t - length < x[0] <= t and x[3] is not None]
            now = {"sum": lambda: sum(v), "count": lambda: len(v), "min": lambda: min(v, default=None), "max": lambda: max(v, default=None),
                   "avg": lambda: int(sum(v) / len(v)) if v else None, "any": lambda: any(x > 3 for x in v), "all": lambda: all(x > 3 for x in v)}[kind]()
            if first or now != was:
                out.add((k, t, now))
            was, first = now, False
    return out


@pytest.mark.parametrize("kind", ["sum", "count", "min", "max", "avg", "any", "all"])
@pytest.mark.parametrize("keyed,few", [(False, False), (True, False), (True, True)])
def test_window_aggregates(spark, kind, keyed, few):
    rows = rows_of()
    s = Stream(spark.createDataFrame(rows, "ts long, seq long, k string, x long"))
    x = F.col("x") > 3 if kind in ("any", "all") else F.col("x")
    got = (s.groupby("k") if keyed else s).window(7, few=few).agg(kind, x).df
    assert "sliding" not in frames(got)
    got = [(r["k"] if keyed else None, r["ts"], r["value"]) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 7, kind, keyed)


def test_window_decimals_and_doubles(spark):
    rows = [(1, 1, "0.1"), (2, 2, "0.2"), (6, 3, "-0.3"), (7, 4, "1e0"), (30, 5, None)]
    df = spark.createDataFrame(rows, "ts long, seq long, x string")
    for kind, to in (("sum", "decimal(10,2)"), ("sum", "double"), ("avg", "double")):
        w = Stream(df.withColumn("x", F.col("x").cast(to))).window(5)
        got = w.agg(kind, "x").df.orderBy("ts")
        if kind == "sum":
            assert [round(float(r["value"]), 9) for r in got.collect()] == [0.1, 0.3, -0.1, 0.7, 1.0, 0.0]
            assert dict(got.dtypes)["value"] == ("decimal(20,2)" if to != "double" else to)
        else:
            assert got.collect()[-1]["value"] is None


def frames(df) -> str:
    """``sliding`` if a window of the plan reaches back by a span: its cost is that of all rows it holds, for each row."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" in plan
    return "sliding" if re.search(r"RangeFrame, -\d", plan) else "running"


def test_global_window_sum_is_running(spark):
    assert frames(catalogue.QUERIES["global_window_sum"](spark, "/root/testdata/sf0.001")) == "running"


@pytest.mark.parametrize("name", ["congestion_tolls", "congestion_tolls_fixed"])
def test_tolls_at_equal_times(spark, tmp_path, name):
    """Many vehicles at the same instants, at buckets' and blocks' edges: in few segments, without a sliding frame."""
    duckdb, step = pytest.importorskip("duckdb"), 5 * 3600
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds((i // 20) * {step} // 4) - to_microseconds(i // 20 % 2) AS ts, i % 20 AS user_id,
        ['a', 'b', 'c'][CAST(1 + hash(i) % 3 AS BIGINT)] AS event_type, (hash(i + 1000) % 10000) / 100.0 AS value FROM range(800) r(i)) TO '{tmp_path}/events.parquet'""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(f"SELECT vehicle_id, ts, total FROM ({catalogue.ORACLE[name]})").fetchall()
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    assert frames(got) == "running"
    assert sorted(map(tuple, got.select("vehicle_id", "ts", "total").collect())) == sorted(want) and len(want) > 100


def brute_tolls(rows, length, limit, back, whole):
    """``tolls`` by its definition: each entry asks all reports anew."""
    rows = [r for r in rows if r[3] is not None]
    at = {}  # a vehicle's segment at each of its instants
    for t, q, v, s, _ in sorted(rows, key=lambda r: r[:2]):
        at.setdefault(v, {})[t] = s
    where = lambda v, t: next((s for u, s in reversed(sorted(at[v].items())) if u <= t), None)
    out = set()
    for v, told in at.items():
        was, total, paid = None, 0, None
        for t, s in sorted(told.items()):
            if s != was:
                x = [r[4] for r in rows if r[3] == s and t - back - length < r[0] <= t - back and r[4] is not None]
                mean = (int(sum(x) / len(x)) if whole else sum(x) / len(x)) if x else None
                total += sum(where(u, t - back) == s for u in at) if mean is not None and mean < limit else 0
                if total != paid:
                    out.add((v, t, total))
                was, paid = s, total
    return out


@pytest.mark.parametrize("back", [0, 1])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_tolls_by_definition(spark, kind, back):
    """Reports of one vehicle at one instant, null vehicles, segments and speeds, times before 0; whole speeds take one pass of all rows."""
    r = random.Random(5)
    rows = [(r.randint(-40, 40) if i % 9 else 400, i, r.choice([1, 2, 3, 4, None]), r.choice(["a", "b", "c", None]), r.choice([None, *range(-5, 9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "ts long, seq long, vehicle_id long, segment_id string, speed long")
    got = tolls(Stream(df.withColumn("speed", F.col("speed").cast(kind)), bucket=96), 7, 2, just_before=bool(back))
    assert frames(got) == "running"
    kept = got.collect()
    assert len(kept) == len(set(map(tuple, kept))) and set(map(tuple, kept)) == brute_tolls(rows, 7, 2, back, kind == "long") and len(kept) > 30
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    if kind == "long":
        assert "Union" not in plan and "DESC" not in plan and plan.count("ReusedExchange") == 1
