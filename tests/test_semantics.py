"""Nulls, exact numbers, sources, hot-key plans and operators without a query of their own."""

import pytest
from pyspark.sql import functions as F

from steploom.functions.enums import Enum
from steploom.functions.registry import choose
from steploom.functions.scalars import comprehension, distance, now
from steploom.operators.entities import Entity, child_sum, memberships
from steploom.operators.listeners import fold, resetting, tagged
from steploom.operators.stream import Stream, Value
from steploom.sources.events import at_times, csv_stream, csv_text, daily_at, show, ticks
from steploom.operators.timeline import as_of, changed, intervals

T = "timestamp, room_id, temperature\n2, 1, 25\n4, 3, 45 # hot\n\n5, 1, 25\n6, 2, 50\n7, 3, 30\n9, 1, 23\n"


@pytest.fixture(scope="module")
def temps(spark):
    return csv_text(spark, T, "timestamp long, room_id long, temperature long")


def log(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def events(spark, rows, fields="user long, x long"):
    return Stream(spark.createDataFrame(rows, f"ts long, seq long, {fields}"))


def test_fold_keeps_nulls_and_large_numbers(spark):
    big = 2**53 + 1
    s = events(spark, [(1, 1, 7, big), (2, 2, 7, None), (3, 3, 7, 1), (1, 4, None, 5), (2, 5, None, 7)]).groupby("user")
    seen = fold(("user",), tagged(s, fields=("x",)), lambda a, e: a + (0 if e["x"] is None else e["x"]), 0, "long")
    assert log(seen.df, "user", "ts", "value") == sorted([(7, 1, big), (7, 3, big + 1), (None, 1, 5), (None, 2, 12)], key=str)
    none = fold(("user",), tagged(s, fields=("x",)), lambda a, e: e["x"] is None, None, "boolean")
    assert (7, 2, True) in log(none.df, "user", "ts", "value")
    assert fold(("user",), tagged(Stream(s.df.limit(0), ("user",)), fields=("x",)), lambda a, e: 1, 0, "long").df.count() == 0


def test_resetting_is_the_fold(spark):
    s = events(spark, [(t, t, t % 2, t * 3 % 7) for t in range(30)]).groupby("user")
    e = tagged(s, fields=("x",))
    a = resetting(("user",), e, F.col("x"), F.col("x") == 0)
    b = fold(("user",), e, lambda v, r: 0 if r["x"] == 0 else v + r["x"], 0, "long")
    assert log(a.df, "user", "ts", "value") == log(b.df, "user", "ts", "value")


@pytest.mark.parametrize("bucket", [1, 3, 100])
def test_global_operators_do_not_depend_on_buckets(spark, temps, bucket):
    s = Stream(temps.df, (), bucket)
    assert log(s.agg("avg", "temperature").df, "ts", "value") == [(2, 25), (4, 35), (5, 31), (6, 36), (7, 35), (9, 33)]
    assert log(s.agg("any", F.col("temperature") > 45).df, "ts", "value") == [(6, True)]
    assert log(s.agg("all", F.col("temperature") < 45).df, "ts", "value") == [(4, False)]
    assert log(s.last("temperature").df, "ts", "value") == [(2, 25), (4, 45), (5, 25), (6, 50), (7, 30), (9, 23)]
    assert log(s.prev("temperature").df, "ts", "value") == [(4, 25), (5, 45), (6, 25), (7, 50), (9, 30)]
    assert log(s.window(3).agg("sum", "temperature").df, "ts", "value") == sorted([(2, 25), (4, 70), (6, 120), (7, 105), (8, 80), (9, 53), (10, 23), (12, 0)], key=str)
    assert [r["value"] for r in s.window(3).at_events("count", "temperature").orderBy("ts").collect()] == [1, 2, 2, 3, 3, 2]
    spans = intervals(s.last("temperature").df, (), bucket)
    assert log(spans, "valid_from", "valid_to") == [(2, 4), (4, 5), (5, 6), (6, 7), (7, 9), (9, None)]
    seen = as_of(temps.df.select("ts"), s.last("temperature").df.where("ts <= 6"), [], {"value": "v"}, bucket=bucket)
    assert log(seen, "ts", "v") == [(2, 25), (4, 45), (5, 25), (6, 50), (7, 50), (9, 50)]
    assert log(changed(temps.df.select("ts", (F.col("temperature") > 30).alias("v")), (), ["v"], F.lit(False), bucket), "ts", "v") == [(4, True), (5, False), (6, True), (7, False)]
    spread = s.agg("stddev", "temperature").snapshot().first()["value"]
    assert spread == pytest.approx(temps.df.agg(F.stddev_samp("temperature")).first()[0])
    assert log(s.last_event("room_id", "temperature").df.where("ts = 7"), "value.room_id", "value.temperature") == [(3, 30)]
    own = temps.groupby("room_id").last("temperature")
    every = Value(own.df, own.keys, "value", bucket).compare(s.last("temperature"), F.col("other"))
    assert log(every.df.where("ts IN (4, 9)"), "ts", "room_id", "value") == [(4, 1, 45), (4, 3, 45), (9, 1, 23), (9, 2, 23), (9, 3, 23)]


def test_no_single_partition_over_rows(spark, temps):
    plan = Stream(temps.df, (), 3).agg("sum", "temperature").df._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("Exchange SinglePartition")[1:]:  # what is below it has been aggregated by bucket
        assert "HashAggregate" in part.split("Exchange", 1)[0] or "SortAggregate" in part.split("Exchange", 1)[0]


def test_updates_and_records(temps):
    assert log(temps.last("temperature").select(F.col("value") > 30).updates().df, "ts", "value") == [(2, False), (4, True), (5, False), (6, True), (7, False), (9, False)]
    rec = Value.record_of(t=temps.last("temperature"), r=temps.last("room_id")).df
    assert log(rec, "ts", "value.t", "value.r")[0] == (2, 25, 1)


def test_uda_avg_of_a_value_window(temps):
    w = temps.last("temperature").window(3)
    n, s = w.count(), w.sum()
    got = s.compare(n, F.when(F.col("other") == 0, 0).otherwise(F.floor(F.col("value") / F.col("other"))))
    assert log(got.df, "ts", "value") == sorted([(2, 25), (4, 35), (5, 31), (6, 36), (7, 37), (8, 35), (9, 34), (10, 26), (12, 23)], key=str)
    assert log(temps.window(3).uda(F.col("temperature"), -F.col("temperature")).df, "ts", "value") == log(temps.window(3).agg("sum", "temperature").df, "ts", "value")


def test_indexes_and_order(temps):
    w = temps.window(3)
    assert log(w.index(0, "temperature").df, "ts", "value") == sorted([(2, 25), (5, 45), (7, 25), (8, 50), (9, 30), (10, 23), (12, None)], key=str)
    assert log(w.index(-1, "temperature").df, "ts", "value") == sorted([(2, 25), (4, 45), (5, 25), (6, 50), (7, 30), (9, 23), (12, None)], key=str)
    top = w.sort_by(F.col("temperature"), fields=("temperature",)).df
    assert {r["ts"]: [x["temperature"] for x in r["value"]] for r in top.collect()}[7] == [25, 30, 50]
    live = temps.groupby("room_id").last("temperature").index(temps.last("room_id"))
    assert log(live.df, "ts", "value") == [(2, 25), (4, 45), (5, 25), (6, 50), (7, 30), (9, 23)]


def test_dict_count(temps):
    assert log(temps.groupby("room_id").last("temperature").count().df, "ts", "value") == [(2, 1), (4, 2), (6, 3)]


def test_dynamic_and_while_windows(temps):
    got = temps.dynamic(F.when(F.col("room_id") == 3, 3).otherwise(1), "sum", "temperature", bucket=2, name="s")
    assert log(got, "ts", "s") == [(2, 25), (4, 70), (5, 25), (6, 50), (7, 105), (9, 23)]
    assert log(temps.while_(F.col("temperature") > 26).df, "ts", "episode") == [(4, 1), (6, 2), (7, 2)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("within", [0, 3])
def test_joins_within(spark, how, within):
    a = events(spark, [(t, t, t % 2, t) for t in range(0, 20, 3)])
    b = events(spark, [(t, t, t % 3, t) for t in range(1, 30, 4)])
    got = log(a.join(b, ["user"], within, how), "x", "r_x")
    l, r = a.df.alias("l"), b.df.alias("r")
    want = l.join(r, (F.col("l.user") == F.col("r.user")) & (F.abs(F.col("l.ts") - F.col("r.ts")) <= within), how).select(F.col("l.x").alias("x"), F.col("r.x").alias("r_x"))
    assert got == log(want, "x", "r_x")


def test_when_sees_its_own_instant(temps):
    got = temps.when(temps.last("temperature"), F.col("value") * 2)
    assert log(got.df, "ts", "value")[:2] == [(2, 50), (4, 90)]


def test_fixed_access_sees_the_instant_before(temps):
    assert log(temps.seeing(temps.last("temperature"), before=True, was="value").df, "ts", "was") == sorted([(2, None), (4, 25), (5, 45), (6, 25), (7, 50), (9, 30)], key=str)


def test_entities(spark, temps):
    n = csv_text(spark, "timestamp,room_id,product_id\n3,1,1\n4,1,2\n6,2,2\n7,1,3\n8,2,1\n9,3,2\n", "timestamp long, room_id long, product_id long")
    product, room = Entity.create_from("Product", n, "product_id"), Entity.create_from("Room", temps, "room_id")
    assert log(memberships(room, product).where("product_id = 2"), "room_id", "valid_from", "valid_to") == sorted([(1, 4, 6), (2, 6, 9), (3, 9, None)], key=str)
    assert log(child_sum(room, product, F.col("product_id")).df.where("room_id = 1"), "ts", "value") == [(3, 1), (4, 3), (6, 1), (7, 4), (8, 3)]
    assert log(room.on_new().df, "room_id", "ts") == [(1, 2), (2, 6), (3, 4)]
    assert log(room.pulse("temperature").df, "ts", "temperature")[0] == (2, 25)
    assert {r["room_id"]: r["children"] for r in room.children(product, 7).collect()} == {1: [1, 3], 2: [2]}
    warm = room.member("warm", temps.groupby("room_id").last("temperature").select(F.col("value") > 26))
    assert (7, 3, True) in log(warm.table, "ts", "room_id", "warm")
    both = Entity.create_from("Room", [temps, n.select(room_id=F.col("room_id"), product_id=F.col("product_id"))], "room_id")
    assert {r["room_id"]: (r["temperature"], r["product_id"]) for r in both.all().collect()} == {1: (23, 3), 2: (50, 1), 3: (30, 2)}
    late = Entity.create_from("Product", csv_text(spark, "timestamp,room_id,product_id\n1,9,1\n1,1,2\n", "timestamp long, room_id long, product_id long"), "product_id").belongs_to(room, {"temperature": "t"})
    assert log(late.table, "product_id", "ts", "t") == sorted([(1, 1, None), (2, 1, None), (2, 2, 25), (2, 9, 23)], key=str)


def test_sources(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text(T)
    (tmp_path / "b.csv").write_text('# import "a.csv"\n')
    (tmp_path / "empty.csv").write_text("# nothing\n")
    kinds = "timestamp long, room_id long, temperature long"
    assert log(csv_stream(spark, str(tmp_path / "a.csv"), kinds).df, "ts", "temperature") == log(csv_stream(spark, str(tmp_path / "b.csv"), kinds).df, "ts", "temperature")
    empty = csv_stream(spark, str(tmp_path / "empty.csv"), kinds)
    assert empty.df.count() == 0 and empty.last("temperature").df.count() == 0
    assert [r["ts"] for r in at_times(ticks(spark, 0, 20), 6, 1).df.orderBy("ts").collect()] == [1, 7, 13, 19]
    assert daily_at(ticks(spark, 0, 200_000, 3600), 1).df.count() == 3
    show(csv_stream(spark, str(tmp_path / "a.csv"), kinds))
    assert "45" in capsys.readouterr().out


def test_functions(spark, temps):
    f = choose(F.col("room_id"), {1: lambda x: x * 2, 2: lambda x: -x})
    assert log(temps.df.select("ts", f(F.col("temperature")).alias("y")), "ts", "y") == sorted([(2, 50), (4, None), (5, 50), (6, -50), (7, None), (9, 46)], key=str)
    assert log(comprehension(temps, F.col("temperature") > 30, at=now()).df, "at") == [(4,), (6,)]
    assert spark.range(1).select(distance(0, 0, 0, 90)).first()[0] == pytest.approx(10007.543, abs=0.01)
    shape = Enum(Dot=None, Circle="double")
    same = spark.range(1).select(shape.Circle(1.0).eqNullSafe(shape.Circle(1.0)), shape.Circle(1.0).eqNullSafe(shape.Dot()), shape.Dot().eqNullSafe(shape.Dot())).first()
    assert tuple(same) == (True, False, True)


def test_window_contents_and_log(temps):
    assert [r["ts"] for r in temps.window(3).contents(7).collect()] == [5, 6, 7]
    assert [r["temperature"] for r in temps.window(3).contents(7, [F.col("temperature")]).collect()] == [25, 30, 50]
