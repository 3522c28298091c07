"""The reference workloads' golden changelogs: every change, at its instant, and no other."""

import pytest
from pyspark.sql import functions as F

from steploom.functions.enums import Enum, anything, bind, fields, literal, match, variant
from steploom.functions.registry import define
from steploom.functions.scalars import at, if_then_else, logical_and, logical_or, plus_text, seconds
from steploom.operators.entities import Entity, child_counts
from steploom.operators.listeners import counter, ema, fold, tagged
from steploom.operators.stream import Stream
from steploom.plans.applications import tolls, volumes
from steploom.sources.events import csv_text, ticks

T = "timestamp, room_id, temperature\n2, 1, 25\n4, 3, 45 # hot\n\n5, 1, 25\n6, 2, 50\n7, 3, 30\n9, 1, 23\n"
H = "timestamp,room_id,humidity\n" + "".join(f"{t},{t % 3 + 1},{h}\n" for t, h in enumerate([70, 80, 90, 71, 81, 91, 72, 82, 92]))
N = "timestamp,room_id,product_id\n3,1,1\n4,1,2\n6,2,2\n7,1,3\n8,2,1\n9,3,2\n"
R = "timestamp,vehicle_id,speed,segment_id\n1,10,70,1\n2,20,80,1\n3,10,90,2\n4,30,71,1\n5,20,81,2\n6,30,91,2\n7,10,72,3\n8,20,82,3\n"


@pytest.fixture(scope="module")
def temps(spark):
    return csv_text(spark, T, "timestamp long, room_id long, temperature long")


@pytest.fixture(scope="module")
def hums(spark):
    return csv_text(spark, H, "timestamp long, room_id long, humidity long")


@pytest.fixture(scope="module")
def entries(spark):
    return csv_text(spark, N, "timestamp long, room_id long, product_id long")


def log(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_where_and_select(temps):
    assert log(temps.where("temperature > 30").df, "ts") == [(4,), (6,)]
    assert log(temps.select(double=F.col("temperature") * 2).df, "ts", "double")[0] == (2, 50)


def test_where_sees_another_value_of_its_own_instant(temps, hums):
    seen = temps.seeing(hums.last("humidity"), hum="value").where("hum > 85")
    assert log(seen.df, "ts") == [(2,), (5,), (9,)]


def test_merge(temps, hums):
    m = temps.merge(hums, "room_id")
    assert m.df.count() == 15
    hot = m.where(logical_or(F.col("temperature") > 30, F.col("humidity") > 85))
    assert log(hot.df, "ts", "room_id") == [(2, 3), (4, 3), (5, 3), (6, 2), (8, 3)]


def test_listener_of_two_streams(temps, hums):
    both = tagged(temps, hums, fields=("temperature", "humidity"))
    want = [(0, 70), (1, 150), (2, 265), (3, 336), (4, 462), (5, 578), (6, 700), (7, 812), (8, 904), (9, 927)]
    assert log(counter((), both, F.coalesce("temperature", "humidity"), bucket=3).df, "ts", "value") == want
    step = lambda x, e: x + int(e["temperature"] if e["listener"] == 0 else e["humidity"])
    assert log(fold((), both, step, 0, "long").df, "ts", "value") == want


def test_groupby_last_and_global_body(temps):
    own = temps.groupby("room_id").last("temperature")
    assert log(own.df, "ts", "room_id", "value") == [(2, 1, 25), (4, 3, 45), (6, 2, 50), (7, 3, 30), (9, 1, 23)]
    every = own.compare(temps.last("temperature"), F.col("other"))
    assert log(every.df.where("ts IN (4, 9)"), "ts", "room_id", "value") == [(4, 1, 45), (4, 3, 45), (9, 1, 23), (9, 2, 23), (9, 3, 23)]


def test_running_and_windowed_sum(temps):
    s = Stream(temps.df, (), 4)
    assert log(s.agg("sum", "temperature").df, "ts", "value") == [(2, 25), (4, 70), (5, 95), (6, 145), (7, 175), (9, 198)]
    assert log(temps.window(3).agg("sum", "temperature").df, "ts", "value") == [(2, 25), (4, 70), (6, 120), (7, 105), (8, 80), (9, 53), (10, 23), (12, 0)]


def test_window_min_and_sum_by_room(temps):
    w = temps.window(3).groupby("room_id")
    assert [x for x in log(w.agg("min", "temperature").df.na.fill(-1), "ts", "room_id", "value")] == [
        (2, 1, 25), (4, 3, 45), (6, 2, 50), (7, 3, 30), (8, 1, -1), (9, 1, 23), (9, 2, -1), (10, 3, -1), (12, 1, -1)]
    assert log(w.agg("sum", "temperature").df, "ts", "room_id", "value") == [
        (2, 1, 25), (4, 3, 45), (6, 2, 50), (7, 3, 30), (8, 1, 0), (9, 1, 23), (9, 2, 0), (10, 3, 0), (12, 1, 0)]


def test_window_log(temps):
    assert log(temps.window(3).expired().df, "ts") == [(5,), (7,), (8,), (9,), (10,), (12,)]


def test_window_and_where_commute(temps):
    a = temps.where("temperature > 25").window(3).agg("sum", "temperature").df
    b = temps.window(3).where("temperature > 25").agg("sum", "temperature").df
    assert log(a, "ts", "value") == log(b, "ts", "value")


def test_value_windows(temps):
    last = temps.last("temperature")
    assert log(last.window(3).sum().df, "ts", "value") == [(2, 25), (4, 70), (5, 95), (6, 145), (7, 150), (8, 105), (9, 103), (10, 53), (12, 23)]
    by_room = temps.groupby("room_id").last("temperature").window(2).agg("max")
    assert log(by_room.df, "ts", "room_id", "value") == [(2, 1, 25), (4, 3, 45), (6, 2, 50), (9, 3, 30), (11, 1, 23)]


def test_any_and_all(temps):
    last = temps.last("temperature")
    assert log(last.window(2).agg("any", F.col("value") > F.col("other"), last).df, "ts", "value") == [(5, True), (6, False), (7, True), (11, False)]
    assert log(last.window(2).agg("all", F.col("value") >= F.col("other"), last).df, "ts", "value") == [(4, False), (5, True), (6, False), (8, True)]
    assert log(temps.agg("any", F.col("temperature") > 45).df, "ts", "value") == [(6, True)]


def test_dictionary_where(temps):
    d = temps.groupby("room_id").last("temperature")
    assert log(d.where(F.col("value") > 30), "ts", "room_id", "op") == [(4, 3, "SET"), (6, 2, "SET"), (7, 3, "DEL")]
    assert log(d.select(F.col("value") * 2).df, "ts", "room_id", "value") == [(2, 1, 50), (4, 3, 90), (6, 2, 100), (7, 3, 60), (9, 1, 46)]


def test_changes_law(temps):
    v = temps.groupby("room_id").last("temperature")
    assert log(v.changes().last("value").df, "room_id", "ts", "value") == log(v.df, "room_id", "ts", "value")


def test_entity_products(temps, entries):
    product = Entity.create_from("Product", entries, "product_id")
    room = Entity.create_from("Room", temps, "room_id")
    counted = room.has_many(product, "products").table
    got = log(counted.select("ts", "room_id", "products").distinct(), "ts", "room_id", "products")
    for want in [(2, 1, 0), (4, 3, 0), (4, 1, 2), (6, 1, 1), (6, 2, 1), (7, 1, 2), (8, 1, 1), (8, 2, 2), (9, 2, 1), (9, 3, 1)]:
        assert want in got
    assert log(child_counts(room, product).df.where("room_id = 1"), "ts", "value") == [(3, 1), (4, 2), (6, 1), (7, 2), (8, 1)]


def test_muggy(spark, entries):
    more = csv_text(spark, T + "20,3,10\n30,3,40\n", "timestamp long, room_id long, temperature long")
    room = Entity.create_from("Room", more, "room_id")
    product = Entity.create_from("Product", entries, "product_id").belongs_to(room, {"temperature": "room_temp"})
    hot = product.attribute("room_temp").reaches(F.col("value") > 25, 600, 1000)
    assert log(hot, "ts", "product_id") == [(608, 1), (616, 2)]


def test_ema(temps):
    got = [x for _, x in log(ema(temps, "temperature", 3).df, "ts", "value")]
    want = [25, 35, 95 / 3, 25 + 95 / 6, 15 + (25 + 95 / 6) / 2, 23 / 2 + (15 + (25 + 95 / 6) / 2) / 2]
    assert got == pytest.approx(want)


def test_state_machine(temps):
    events = tagged(temps.groupby("room_id"), fields=("temperature",))
    step = lambda s, e: {"A": "B", "B": "C", "C": "A"}.get(s, "A")
    got = fold(("room_id",), events, step, None, "string").where(F.col("value") == "A")
    assert log(got, "ts", "room_id", "op") == [(2, 1, "SET"), (4, 3, "SET"), (5, 1, "DEL"), (6, 2, "SET"), (7, 3, "DEL")]


def test_linear_road(spark):
    r = csv_text(spark, R, "timestamp long, vehicle_id long, speed long, segment_id long")
    got = log(volumes(r).df, "ts", "segment_id", "value")
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (3, 2, 1), (4, 1, 2), (5, 1, 1), (5, 2, 2), (6, 1, 0), (6, 2, 3), (7, 2, 2), (7, 3, 1), (8, 2, 1), (8, 3, 2)]
    assert log(tolls(r, 300, 80), "ts", "vehicle_id", "total") == [(1, 10, 1), (2, 20, 2), (4, 30, 2), (7, 10, 2), (8, 20, 4)]


def test_null_logic(spark):
    df = spark.sql("SELECT CAST(NULL AS BOOLEAN) AS n, true AS t, array(1, 2, 3) AS w")
    n, t = F.col("n"), F.col("t")
    row = df.select(logical_and(n, t), logical_or(n, t), logical_and(n, n), if_then_else(n, 1, 2), plus_text("a", n), at(F.col("w"), -1), at(F.col("w"), 9)).first()
    assert tuple(row) == (False, True, None, None, "a(null)", 3, None)
    assert seconds(5, "min") == 300


def test_enums_and_patterns(spark):
    shape = Enum(Circle="double", Square="struct<a:int,b:int>", Dot=None)
    df = spark.sql("SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4")
    v = F.when(F.col("k") == 1, shape.Circle(2.0)).when(F.col("k") == 2, shape.Square(F.struct(F.lit(3).alias("a"), F.lit(4).alias("b")))).when(F.col("k") == 3, shape.Square(F.struct(F.lit(0).alias("a"), F.lit(9).alias("b")))).otherwise(shape.Dot())
    got = df.withColumn("v", v).select("k", match(F.col("v"), (variant("Circle", bind("r")), lambda r: r * 2), (variant("Square", fields(a=literal(0), b=bind("b"))), lambda b: b * 100.0),
                                                  (variant("Square", fields(a=bind("a"), b=bind("b"))), lambda a, b: a < b, lambda a, b: (a + b) * 1.0), (anything, F.lit(-1.0))).alias("x"))
    assert log(got, "k", "x") == [(1, 4.0), (2, 7.0), (3, 900.0), (4, -1.0)]


def test_currying_and_ticks(spark):
    add = define(lambda a, b: a + b)
    assert add(1)(2) == add(1, 2) == 3
    assert ticks(spark, 0, 9).where("ts % 3 = 0").df.count() == 4
