"""Worked applications: congestion tolls, moving-average crossings, daily movers, a fleet's centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import divide
from ..operators.entities import Entity, child_counts
from ..operators.listeners import ema
from ..operators.stream import Stream, Value
from ..operators.timeline import by_time, sums_as_of
from .catalogue import DAY, E_SQL, HOUR, events, per_user, query


def volumes(reports: Stream) -> Value:
    """Vehicles per segment, live: a vehicle is where it last reported."""
    vehicle = Entity.create_from("Vehicle", reports, "vehicle_id")
    return child_counts(Entity("Segment", "segment_id", reports, reports.df), vehicle, few=True)


def tolls(reports: Stream, length: int, limit: float, just_before: bool = False) -> DataFrame:
    """``(vehicle_id, ts, total)``: each entry of a congested segment costs the vehicles in it.

    A segment is congested while the mean speed of its last ``length`` is under ``limit``.
    With ``just_before`` the segment is as it was before the vehicle's own report.
    """
    back, w = int(just_before), Window.partitionBy("vehicle_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    whole = dict(reports.df.dtypes)["speed"] in ("int", "bigint", "smallint", "tinyint")
    # Few keys: run by bucket of time, a small one, as rows of one bucket and key are slow to sort.
    seen = sums_as_of(segment_moves(reports, length, whole), ["_c", "_s", "_n"] if whole else ["_c"], max(1, reports.bucket // 16), ["segment_id"], back, "_who")
    if whole:
        seen = seen.withColumn("mean", divide(F.col("_s"), F.col("_n")))
    else:  # a sum of fractions would drift where they are taken away again
        at = seen.withColumn("ts", F.col("ts") - back)
        seen = reports.groupby("segment_id").window(length, few=True).seen(at, "avg", "speed", "mean").withColumn("ts", F.col("ts") + back)
    paid = seen.withColumn("toll", F.when(F.col("mean") < limit, F.col("_c")).otherwise(0))
    # A total differs from the one before it where a toll is paid; a vehicle's first one stays.
    return paid.where("toll <> 0 OR first").select("vehicle_id", "ts", F.sum("toll").over(w).alias("total"))


def segment_moves(reports: Stream, length: int, speeds: bool) -> DataFrame:
    """What moves the number of a segment's vehicles (``_c``) and, with ``speeds``, sum (``_s``) and number (``_n``) of its last ``length``.

    A report is a row, with ``_who`` where it enters the segment; another is where its vehicle was
    before, a third its expiry.
    """
    df = reports.df.where("segment_id IS NOT NULL")
    own, zero = by_time(["vehicle_id"], "ts", "seq"), F.lit(0).cast("long")
    # An instant's last report counts; it moves its vehicle from where the last one of an instant before had left it.
    df = df.withColumn("_last", F.lead(F.lit(1)).over(own).isNull() | ~F.lead("ts").over(own).eqNullSafe(F.col("ts")))
    df = df.withColumn("_was", F.last(F.when(F.col("_last"), F.col("segment_id")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_enters", F.col("_last") & ~F.col("segment_id").eqNullSafe(F.col("_was")))
    who = F.struct("vehicle_id", F.col("_was").isNull().alias("first"))
    nobody = F.when(F.lit(False), who)
    s = F.coalesce(F.col("speed").cast("long"), zero) if speeds else zero
    n = F.col("speed").isNotNull().cast("long") if speeds else zero

    def move(segment: str, ts: Column, c: Column, s: Column, n: Column, who: Column) -> Column:
        return F.struct(F.col(segment).alias("segment_id"), ts.alias("ts"), c.cast("long").alias("_c"), s.alias("_s"), n.alias("_n"), who.alias("_who"))

    rows = [move("segment_id", F.col("ts"), F.col("_enters"), s, n, F.when(F.col("_enters"), who)),
            F.when(F.col("_enters") & F.col("_was").isNotNull(), move("_was", F.col("ts"), F.lit(-1), zero, zero, nobody))]
    if speeds:
        rows.append(move("segment_id", F.col("ts") + length, zero, -s, -n, nobody))
    return df.select(F.explode(F.array(*rows)).alias("_m")).where("_m IS NOT NULL").select("_m.*")


def reports(spark: SparkSession, d: str) -> Stream:
    """Events read as vehicle reports: users drive, types are segments, values are speeds."""
    return events(spark, d).select(vehicle_id=F.col("user_id"), segment_id=F.col("event_type"), speed=F.col("cents"))


@query("segment_volumes", E_SQL + """, k AS (SELECT user_id, ts, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM e),
m AS (SELECT s AS segment_id, ts, 1 AS x FROM k WHERE s IS DISTINCT FROM was UNION ALL SELECT was, ts, -1 FROM k WHERE was IS NOT NULL AND s IS DISTINCT FROM was),
a AS (SELECT segment_id, ts, sum(x) AS x FROM m GROUP BY ALL), r AS (SELECT segment_id, ts, CAST(sum(x) OVER (PARTITION BY segment_id ORDER BY ts) AS BIGINT) AS value FROM a),
c AS (SELECT *, lag(value) OVER (PARTITION BY segment_id ORDER BY ts) AS was FROM r) SELECT segment_id, ts, value FROM c WHERE value IS DISTINCT FROM was""")
def _(spark, d):
    return volumes(reports(spark, d)).df.select("segment_id", "ts", F.col("value").cast("long"))


def tolls_sql(back: int) -> str:
    """As ``tolls``: segments are seen ``back`` before a vehicle enters."""
    length = 5 * HOUR
    return E_SQL + f""", u AS (SELECT event_type AS s, ts, cents AS x FROM e UNION ALL SELECT event_type, ts + {length}, NULL FROM e),
a AS (SELECT s, ts, sum(x) OVER k AS t, count(x) OVER k AS n FROM u WINDOW k AS (PARTITION BY s ORDER BY ts RANGE BETWEEN {length - 1} PRECEDING AND CURRENT ROW)),
mean AS (SELECT DISTINCT s, ts, CASE WHEN n > 0 THEN t // n END AS mean FROM a),
k AS (SELECT user_id, ts, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM e),
m AS (SELECT s, ts, 1 AS x FROM k WHERE s IS DISTINCT FROM was UNION ALL SELECT was, ts, -1 FROM k WHERE was IS NOT NULL AND s IS DISTINCT FROM was),
g AS (SELECT s, ts, sum(x) AS x FROM m GROUP BY ALL), vol AS (SELECT s, ts, sum(x) OVER (PARTITION BY s ORDER BY ts) AS cars FROM g),
i AS (SELECT user_id, ts AS due, ts - {back} AS ts, s FROM k WHERE s IS DISTINCT FROM was),
j AS (SELECT i.*, mean.mean FROM i ASOF LEFT JOIN mean ON i.s = mean.s AND i.ts >= mean.ts), q AS (SELECT j.*, vol.cars FROM j ASOF LEFT JOIN vol ON j.s = vol.s AND j.ts >= vol.ts),
y AS (SELECT user_id, due, sum(CASE WHEN mean < 5000 THEN coalesce(cars, 0) ELSE 0 END) OVER (PARTITION BY user_id ORDER BY due) AS total FROM q),
z AS (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY due) AS was FROM y) SELECT user_id AS vehicle_id, due AS ts, CAST(total AS BIGINT) AS total FROM z WHERE total IS DISTINCT FROM was"""


@query("congestion_tolls", tolls_sql(0))
def _(spark, d):
    return tolls(reports(spark, d), 5 * HOUR, 5000).withColumn("total", F.col("total").cast("long"))


@query("congestion_tolls_fixed", tolls_sql(1))
def _(spark, d):
    return tolls(reports(spark, d), 5 * HOUR, 5000, just_before=True).withColumn("total", F.col("total").cast("long"))


@query("macd", f"""WITH RECURSIVE e AS ({E_SQL.split(' AS (', 1)[1][:-1]}), l AS (SELECT user_id, ts, CAST(cents AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS n FROM e),
r AS (SELECT user_id, ts, n, x AS total, x AS a, x AS b FROM l WHERE n = 1 UNION ALL SELECT l.user_id, l.ts, l.n, r.total + l.x,
  CASE WHEN l.n <= 12 THEN (r.total + l.x) / l.n ELSE 2.0::DOUBLE / 13 * l.x + (1 - 2.0::DOUBLE / 13) * r.a END, CASE WHEN l.n <= 26 THEN (r.total + l.x) / l.n ELSE 2.0::DOUBLE / 27 * l.x + (1 - 2.0::DOUBLE / 27) * r.b END
  FROM r JOIN l ON l.user_id = r.user_id AND l.n = r.n + 1),
c AS (SELECT user_id, ts, a > b AS value, lag(a > b) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM r) SELECT user_id, ts, value FROM c WHERE value IS DISTINCT FROM was""")
def _(spark, d):
    """Crossings of a fast and a slow average: a signal whenever their order changes."""
    s = per_user(spark, d)
    return ema(s, "cents", 12).compare(ema(s, "cents", 26), F.col("value") > F.col("other")).df


@query("daily_movers", E_SQL + f""", o AS (SELECT user_id, ts // {DAY} AS day, arg_min(cents, (ts, seq)) AS first, arg_max(cents, (ts, seq)) AS last FROM e GROUP BY ALL),
r AS (SELECT *, last - first AS gain, row_number() OVER (PARTITION BY day ORDER BY last - first DESC, user_id) AS rank FROM o) SELECT day, user_id, gain, rank FROM r WHERE rank <= 3""")
def _(spark, d):
    key = F.struct("ts", "seq")
    o = events(spark, d).df.groupBy("user_id", F.floor(F.col("ts") / DAY).cast("long").alias("day")).agg((F.max_by("cents", key) - F.min_by("cents", key)).alias("gain"))
    w = Window.partitionBy("day").orderBy(F.col("gain").desc(), "user_id")
    return o.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("day", "user_id", "gain", "rank")


def centre_of_mass(df: DataFrame, keys: list[str], lat: str, lon: str) -> DataFrame:
    """The mean of unit vectors, back as degrees, per key."""
    a, o = F.radians(lat), F.radians(lon)
    m = df.groupBy(*keys).agg(F.avg(F.cos(a) * F.cos(o)).alias("x"), F.avg(F.cos(a) * F.sin(o)).alias("y"), F.avg(F.sin(a)).alias("z"))
    return m.select(*keys, F.degrees(F.atan2("z", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))).alias("lat"), F.degrees(F.atan2("y", "x")).alias("lon"))


@query("fleet_centre", E_SQL + """, p AS (SELECT user_id, arg_max(cents, (ts, seq)) AS c FROM e GROUP BY user_id), q AS (SELECT user_id % 5 AS fleet, radians(c % 90) AS a, radians(c % 180) AS o FROM p),
m AS (SELECT fleet, avg(cos(a) * cos(o)) AS x, avg(cos(a) * sin(o)) AS y, avg(sin(a)) AS z FROM q GROUP BY fleet)
SELECT fleet, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS lat, round(degrees(atan2(y, x)), 4) AS lon FROM m""")
def _(spark, d):
    p = per_user(spark, d).last("cents").snapshot().select((F.col("user_id") % 5).alias("fleet"), (F.col("value") % 90).alias("la"), (F.col("value") % 180).alias("lo"))
    return centre_of_mass(p, ["fleet"], "la", "lo").select("fleet", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))
