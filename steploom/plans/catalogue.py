"""The registered queries over the driver's tables, each beside the SQL that gives the same rows.

Money-like values are summed as whole cents, so sums do not depend on the order of addition.
Times are microseconds since 1970.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..functions.enums import Enum, anything, bind, literal, match, variant
from ..functions.registry import choose, recursive
from ..functions.scalars import comprehension, distance, divide, if_then_else, logical_and, logical_or, plus_text, record, remainder, tuple_of, updated
from ..operators.entities import Entity, child_sum, memberships
from ..operators.listeners import counter, ema, fold, resetting, tagged
from ..operators.stream import Stream, Value
from ..sources.events import sequenced, ticks

HOUR, DAY = 3_600_000_000, 86_400_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The events as all SQL here sees them.
E_SQL = "WITH e AS (SELECT epoch_us(ts) AS ts, event_id AS seq, event_id, user_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> Stream:
    df = read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return sequenced(df, "ts", "event_id")


def per_user(spark: SparkSession, d: str) -> Stream:
    return events(spark, d).groupby("user_id")


def kind(s: Stream, k: str) -> Stream:
    return s.where(F.col("event_type") == k)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last value is above 50, with how often it changed: a filtered dictionary's snapshot."""
    return per_user(spark, d).last("value").snapshot().where("value > 50")


# -- projection and filter ----------------------------------------------------------------------
QUERIES["flagship"] = flagship
ORACLE["flagship"] = f"{E_SQL} SELECT user_id, arg_max(value, (ts, seq)) AS value FROM e WHERE value IS NOT NULL GROUP BY user_id HAVING arg_max(value, (ts, seq)) > 50"


@query("stream_where", f"{E_SQL} SELECT event_id, user_id, value FROM e WHERE value > 30")
def _(spark, d):
    return events(spark, d).where("value > 30").df.select("event_id", "user_id", "value")


@query("stream_select", f"{E_SQL} SELECT ts, seq, user_id, cents * 2 AS doubled, event_type || ':' || user_id AS tag FROM e")
def _(spark, d):
    return events(spark, d).select(user_id=F.col("user_id"), doubled=F.col("cents") * 2, tag=plus_text(plus_text(F.col("event_type"), ":"), F.col("user_id"))).df


@query("scalar_semantics", f"""{E_SQL}, n AS (SELECT event_id, cents, CASE WHEN cents % 3 = 0 THEN NULL ELSE cents % 2 = 0 END AS a, CASE WHEN cents % 5 = 0 THEN NULL ELSE cents % 7 < 4 END AS b FROM e)
SELECT event_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, FALSE) AND coalesce(b, FALSE) END AS both,
  CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, FALSE) OR coalesce(b, FALSE) END AS either,
  CASE WHEN a IS NULL THEN NULL WHEN a THEN 1 ELSE 2 END AS branch, CAST(trunc((500 - cents) / 7) AS BIGINT) AS quotient, (500 - cents) % 7 AS rest,
  coalesce(CAST(a AS VARCHAR), '(null)') || '!' AS shown FROM n""")
def _(spark, d):
    n = events(spark, d).df.withColumn("a", F.when(F.col("cents") % 3 == 0, None).otherwise(F.col("cents") % 2 == 0)).withColumn("b", F.when(F.col("cents") % 5 == 0, None).otherwise(F.col("cents") % 7 < 4))
    a, b, x = F.col("a"), F.col("b"), F.lit(500) - F.col("cents")
    return n.select("event_id", logical_and(a, b).alias("both"), logical_or(a, b).alias("either"), if_then_else(a, 1, 2).alias("branch"),
                    divide(x, F.lit(7)).alias("quotient"), remainder(x, F.lit(7)).alias("rest"), plus_text(a, "!").alias("shown"))


@query("records_and_tuples", f"{E_SQL} SELECT event_id, cents + 1 AS a, event_type AS b, user_id AS t1, cents AS t2 FROM e")
def _(spark, d):
    rec = updated(record(a=F.col("cents"), b=F.col("event_type")), a=F.col("cents") + 1)
    df = events(spark, d).select(event_id=F.col("event_id"), r=rec, t=tuple_of(F.col("user_id"), F.col("cents"))).df
    return df.select("event_id", "r.a", "r.b", F.col("t._1").alias("t1"), F.col("t._2").alias("t2"))


# -- joins --------------------------------------------------------------------------------------
@query("where_correlated_asof", f"""{E_SQL} SELECT c.event_id, c.user_id, c.value, v.value AS seen FROM (SELECT * FROM e WHERE event_type = 'click') c
ASOF JOIN (SELECT * FROM e WHERE event_type = 'view' AND value IS NOT NULL) v ON c.user_id = v.user_id AND c.ts >= v.ts WHERE c.value > v.value""")
def _(spark, d):
    s = per_user(spark, d)
    return kind(s, "click").seeing(kind(s, "view").last("value"), seen="value").where("value > seen").df.select("event_id", "user_id", "value", "seen")


def daily(s: Stream, name: str) -> Stream:
    day = F.floor(F.col("ts") / DAY).cast("long")
    return Stream(s.df.groupBy("user_id", day.alias("ts")).agg(F.sum("cents").alias(name)))


@query("merge_streams", f"""{E_SQL}, c AS (SELECT user_id, ts // {DAY} AS ts, sum(cents)::BIGINT AS clicks FROM e WHERE event_type = 'click' GROUP BY ALL),
v AS (SELECT user_id, ts // {DAY} AS ts, sum(cents)::BIGINT AS views FROM e WHERE event_type = 'view' GROUP BY ALL) SELECT ts, user_id, clicks, views FROM c FULL JOIN v USING (ts, user_id)""")
def _(spark, d):
    s = events(spark, d)
    return daily(kind(s, "click"), "clicks").merge(daily(kind(s, "view"), "views"), "user_id").df.select("ts", "user_id", "clicks", "views")


@query("stream_join_within", f"""{E_SQL} SELECT a.event_id, b.event_id AS r_event_id FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.ts - b.ts) <= {HOUR} WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def _(spark, d):
    s = events(spark, d)
    return kind(s, "click").join(kind(s, "purchase"), ["user_id"], within=HOUR).select("event_id", "r_event_id")


@query("outer_join", f"""{E_SQL}, c AS (SELECT user_id, ts // {DAY} AS ts, sum(cents)::BIGINT AS clicks FROM e WHERE event_type = 'click' GROUP BY ALL),
v AS (SELECT user_id, ts // {DAY} AS ts, sum(cents)::BIGINT AS views FROM e WHERE event_type = 'view' GROUP BY ALL)
SELECT c.user_id, c.ts, clicks, views AS r_views FROM c LEFT JOIN v ON c.user_id = v.user_id AND c.ts = v.ts""")
def _(spark, d):
    s = events(spark, d)
    return daily(kind(s, "click"), "clicks").join(daily(kind(s, "view"), "views"), ["user_id", "ts"], how="left").select("user_id", "ts", "clicks", "r_views")


@query("lagged_value", f"""{E_SQL}, l AS (SELECT user_id, ts, cents FROM e) SELECT e.event_id, l.cents AS day_ago FROM e ASOF LEFT JOIN l ON e.user_id = l.user_id AND e.ts - {DAY} >= l.ts""")
def _(spark, d):
    s = per_user(spark, d)
    ago = Value(s.df.select("user_id", "ts", F.col("cents").alias("value")), ("user_id",)).lagged(DAY)
    return s.seeing(ago, day_ago="value").df.select("event_id", "day_ago")


# -- aggregates ---------------------------------------------------------------------------------
def changes_sql(expr: str, keys: str = "user_id", source: str = "e", first: str = "TRUE") -> str:
    """The rows of ``expr`` over (keys, ts) that differ from the key's row before."""
    part = f"PARTITION BY {keys} " if keys else ""
    sel = f"{keys}, " if keys else ""
    return f""", w AS (SELECT DISTINCT {sel}ts, {expr} AS value FROM {source}),
c AS (SELECT *, lag(value) OVER ({part}ORDER BY ts) AS was, row_number() OVER ({part}ORDER BY ts) AS n FROM w)
SELECT {sel}ts, value FROM c WHERE CASE WHEN n = 1 THEN {first} ELSE value IS DISTINCT FROM was END"""


SO_FAR = "OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)"
for _kind, _sql in {"sum": "sum(cents) {w}", "count": "count(cents) {w}", "min": "min(cents) {w}", "max": "max(cents) {w}"}.items():
    QUERIES[f"running_{_kind}"] = lambda spark, d, k=_kind: per_user(spark, d).agg(k, "cents").df.select("user_id", "ts", F.col("value").cast("long"))
    ORACLE[f"running_{_kind}"] = E_SQL + changes_sql(f"CAST({_sql.format(w=SO_FAR)} AS BIGINT)")
    LAST_HOUR = f"OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW)"
    QUERIES[f"window_{_kind}_1h"] = lambda spark, d, k=_kind: per_user(spark, d).window(HOUR).at_events(k, "cents").select("event_id", F.col("value").cast("long"))
    ORACLE[f"window_{_kind}_1h"] = f"{E_SQL} SELECT event_id, CAST({_sql.format(w=LAST_HOUR)} AS BIGINT) AS value FROM e"


@query("running_avg", E_SQL + changes_sql(f"CAST(trunc((sum(cents) {SO_FAR} - sum(cents) {SO_FAR} % count(cents) {SO_FAR}) / count(cents) {SO_FAR}) AS BIGINT)"))
def _(spark, d):
    return per_user(spark, d).agg("avg", "cents").df


@query("global_running_sum", E_SQL + changes_sql("CAST(sum(cents) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT)", keys=""))
def _(spark, d):
    return events(spark, d).agg("sum", "cents").df.select("ts", F.col("value").cast("long"))


@query("global_running_max", E_SQL + changes_sql("max(cents) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING)", keys=""))
def _(spark, d):
    return events(spark, d).agg("max", "cents").df


@query("last_value", E_SQL + ", l AS (SELECT user_id, ts, arg_max(cents, seq) AS x FROM e WHERE cents IS NOT NULL GROUP BY ALL)" + changes_sql("x", source="l"))
def _(spark, d):
    return per_user(spark, d).last("cents").df


@query("prev_value", E_SQL + ", p AS (SELECT user_id, ts, lag(cents) OVER (PARTITION BY user_id ORDER BY ts, seq) AS x FROM e WHERE cents IS NOT NULL), q AS (SELECT * FROM p WHERE x IS NOT NULL)" + changes_sql("x", source="q"))
def _(spark, d):
    return per_user(spark, d).prev("cents").df


@query("last_event", f"{E_SQL} SELECT user_id, arg_max(event_type, (ts, seq)) AS event_type, arg_max(cents, (ts, seq)) AS cents FROM e GROUP BY user_id")
def _(spark, d):
    return per_user(spark, d).last_event("event_type", "cents").snapshot().select("user_id", "value.event_type", "value.cents")


@query("any_sticky", E_SQL + changes_sql(f"coalesce(bool_or(value > 90) {SO_FAR}, FALSE)", first="value IS DISTINCT FROM FALSE"))
def _(spark, d):
    return per_user(spark, d).agg("any", F.col("value") > 90).df


@query("all_sticky", E_SQL + changes_sql(f"coalesce(bool_and(value < 90) {SO_FAR}, TRUE)", first="value IS DISTINCT FROM TRUE"))
def _(spark, d):
    return per_user(spark, d).agg("all", F.col("value") < 90).df


@query("min_by_max_by", f"{E_SQL} SELECT user_id, arg_min(event_id, (cents, event_id)) AS lowest, arg_max(event_id, (cents, event_id)) AS highest, round(stddev_samp(cents), 3) AS spread FROM e GROUP BY user_id")
def _(spark, d):
    s, key = per_user(spark, d), F.struct("cents", "event_id")
    ends = s.extreme("min", key, "event_id", "lowest").join(s.extreme("max", key, "event_id", "highest"), "user_id")
    return ends.join(s.agg("stddev", "cents").snapshot(), "user_id").select("user_id", "lowest", "highest", F.round("value", 3).alias("spread"))


# -- windows ------------------------------------------------------------------------------------
def expiring_sql(agg: str, x: str, first: str = "TRUE", length: int = HOUR) -> str:
    w = f"OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"
    return E_SQL + f", u AS (SELECT user_id, ts, {x} AS x FROM e UNION ALL SELECT user_id, ts + {length}, NULL FROM e)" + changes_sql(agg.format(w=w), source="u", first=first)


@query("window_expirations", expiring_sql("CAST(coalesce(sum(x) {w}, 0) AS BIGINT)", "cents"))
def _(spark, d):
    return per_user(spark, d).window(HOUR).agg("sum", "cents").df.select("user_id", "ts", F.col("value").cast("long"))


@query("window_min_expirations", expiring_sql("min(x) {w}", "cents"))
def _(spark, d):
    return per_user(spark, d).window(HOUR).agg("min", "cents").df


@query("any_in_window", expiring_sql("coalesce(bool_or(x) {w}, FALSE)", "value > 60", "value IS DISTINCT FROM FALSE"))
def _(spark, d):
    return per_user(spark, d).window(HOUR).agg("any", F.col("value") > 60).df


@query("all_in_window", expiring_sql("coalesce(bool_and(x) {w}, TRUE)", "value < 60", "value IS DISTINCT FROM TRUE"))
def _(spark, d):
    return per_user(spark, d).window(HOUR).agg("all", F.col("value") < 60).df


@query("window_log", f"{E_SQL} SELECT event_id, ts, 'added' AS op FROM e UNION ALL SELECT event_id, ts + {HOUR}, 'expired' FROM e")
def _(spark, d):
    return events(spark, d).window(HOUR).log().select("event_id", "ts", "op")


V_SQL = E_SQL + ", l AS (SELECT user_id, ts, arg_max(cents, seq) AS x FROM e GROUP BY ALL), d AS (SELECT *, lag(x) OVER k AS was, row_number() OVER k AS n FROM l WINDOW k AS (PARTITION BY user_id ORDER BY ts)), \
s AS (SELECT user_id, ts AS lo, x, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS hi FROM d WHERE n = 1 OR x IS DISTINCT FROM was)"


@query("value_window_sum", V_SQL + f", m AS (SELECT user_id, lo AS ts, x FROM s UNION ALL SELECT user_id, hi + {HOUR}, -x FROM s WHERE hi IS NOT NULL)" + changes_sql(f"CAST(sum(x) {SO_FAR} AS BIGINT)", source="m"))
def _(spark, d):
    return per_user(spark, d).last("cents").window(HOUR).sum().df.select("user_id", "ts", F.col("value").cast("long"))


@query("value_window_max", V_SQL + f", p AS (SELECT DISTINCT user_id, lo AS ts FROM s UNION SELECT user_id, hi + {HOUR} FROM s WHERE hi IS NOT NULL), \
j AS (SELECT p.user_id, p.ts, max(x) AS x FROM p JOIN s ON p.user_id = s.user_id AND lo <= p.ts AND (hi IS NULL OR p.ts < hi + {HOUR}) GROUP BY ALL)" + changes_sql("x", source="j"))
def _(spark, d):
    return per_user(spark, d).last("cents").window(HOUR).agg("max").df


@query("rows_window", f"{E_SQL} SELECT event_id, CAST(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS 2 PRECEDING) AS BIGINT) AS value FROM e")
def _(spark, d):
    return per_user(spark, d).rows_window(3, "sum", "cents").select("event_id", F.col("value").cast("long"))


@query("range_window", f"{E_SQL} SELECT event_id, CAST(coalesce(sum(cents) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN {5 * HOUR} PRECEDING AND {2 * HOUR} PRECEDING), 0) AS BIGINT) AS value FROM e")
def _(spark, d):
    return per_user(spark, d).ranged(5 * HOUR, 2 * HOUR, "sum", "cents").select("event_id", F.col("value").cast("long"))


@query("semantic_window", f"""{E_SQL}, g AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS episode FROM e),
o AS (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, episode ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM g WHERE episode > 0)
SELECT user_id, CAST(episode AS BIGINT) AS episode, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM o WHERE over = 0 GROUP BY ALL""")
def _(spark, d):
    s = per_user(spark, d).episodes(F.col("event_type") == "click", F.col("event_type") == "purchase")
    return s.df.groupBy("user_id", "episode").agg(F.count("*").alias("n"), F.sum("cents").alias("total"))


# -- continuous values and dictionaries ---------------------------------------------------------
@query("changes", E_SQL + ", l AS (SELECT user_id, ts, arg_max(event_type, seq) AS x FROM e GROUP BY ALL)" + changes_sql("x", source="l"))
def _(spark, d):
    return per_user(spark, d).last("event_type").changes().df.select("user_id", "ts", "value")


@query("updates", f"{E_SQL} SELECT user_id, ts, arg_max(event_type, seq) AS value FROM e GROUP BY ALL")
def _(spark, d):
    return per_user(spark, d).last("event_type").updates().df.select("user_id", "ts", "value")


@query("compare_values", E_SQL + """, p AS (SELECT DISTINCT user_id, ts FROM e WHERE event_type IN ('click', 'view')),
c AS (SELECT user_id, ts, cents FROM e WHERE event_type = 'click'), v AS (SELECT user_id, ts, cents FROM e WHERE event_type = 'view'),
a AS (SELECT p.*, c.cents AS c FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts),
b AS (SELECT a.*, v.cents AS v FROM a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.ts >= v.ts)""" .replace("c AS (SELECT user_id, ts, cents FROM e WHERE event_type = 'click')", "k AS (SELECT user_id, ts, cents FROM e WHERE event_type = 'click')").replace("c.cents AS c FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts", "k.cents AS c FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.ts >= k.ts") + changes_sql("c > v", source="b"))
def _(spark, d):
    s = per_user(spark, d)
    return kind(s, "click").last("cents").compare(kind(s, "view").last("cents"), F.col("value") > F.col("other")).df


@query("dict_where_changelog", V_SQL + """, f AS (SELECT user_id, lo AS ts, x, x > 5000 AS vis, coalesce(lag(x > 5000) OVER (PARTITION BY user_id ORDER BY lo), FALSE) AS was FROM s)
SELECT user_id, ts, CASE WHEN vis THEN 'SET' ELSE 'DEL' END AS op, CASE WHEN vis THEN x END AS value FROM f WHERE vis OR was""")
def _(spark, d):
    return per_user(spark, d).last("cents").where(F.col("value") > 5000).select("user_id", "ts", "op", "value")


@query("dict_select", V_SQL + ", z AS (SELECT user_id, lo AS ts, x // 1000 AS y FROM s)" + changes_sql("y", source="z"))
def _(spark, d):
    return per_user(spark, d).last("cents").select(F.floor(F.col("value") / 1000).cast("long")).df


@query("dict_values", V_SQL + " SELECT user_id, x AS value, lo AS valid_from, hi AS valid_to FROM s")
def _(spark, d):
    return per_user(spark, d).last("cents").values().select("user_id", "value", "valid_from", "valid_to")


@query("dict_index", V_SQL + " SELECT lo AS ts, x AS value FROM s WHERE user_id = 7")
def _(spark, d):
    return per_user(spark, d).last("cents").at(7).df.select("ts", "value")


@query("topk_by_value", f"{E_SQL} SELECT user_id, arg_max(cents, (ts, seq)) AS value FROM e GROUP BY user_id ORDER BY value DESC, user_id LIMIT 10")
def _(spark, d):
    return per_user(spark, d).last("cents").sort_by(F.col("value").desc(), F.col("user_id"), k=10)


@query("nested_groupby", E_SQL + changes_sql("CAST(sum(cents) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT)", keys="user_id, event_type"))
def _(spark, d):
    return per_user(spark, d).groupby("event_type").agg("sum", "cents").df.select("user_id", "event_type", "ts", F.col("value").cast("long"))


@query("computed_group_key", E_SQL + f", h AS (SELECT *, ts // {DAY} AS day FROM e)" + changes_sql("count(cents) OVER (PARTITION BY day ORDER BY ts RANGE UNBOUNDED PRECEDING)", keys="day", source="h"))
def _(spark, d):
    return events(spark, d).groupby(day=F.floor(F.col("ts") / DAY).cast("long")).agg("count", "cents").df.select("day", "ts", "value")


END_SQL = f", t AS (SELECT max(ts) + {HOUR} AS fin FROM e)"


def _end(s: Stream) -> int:
    return (s.df.agg(F.max("ts")).first()[0] or 0) + HOUR


@query("how_long", V_SQL + END_SQL + " SELECT user_id, CAST(sum(CASE WHEN x > 5000 THEN coalesce(hi, fin) - lo ELSE 0 END) AS BIGINT) AS how_long FROM s, t GROUP BY user_id")
def _(spark, d):
    s = per_user(spark, d)
    return s.last("cents").how_long(F.col("value") > 5000, _end(s))


@query("how_long_reaches", V_SQL + END_SQL + f", r AS (SELECT user_id, lo, coalesce(hi, fin) - lo AS n, sum(coalesce(hi, fin) - lo) OVER (PARTITION BY user_id ORDER BY lo) AS upto FROM s, t WHERE x > 5000) \
SELECT user_id, CAST(lo + {DAY} - (upto - n) AS BIGINT) AS ts FROM r WHERE upto >= {DAY} AND upto - n < {DAY}")
def _(spark, d):
    s = per_user(spark, d)
    return s.last("cents").reaches(F.col("value") > 5000, DAY, _end(s))


@query("longest_interval", V_SQL + END_SQL + """, b AS (SELECT *, x > 5000 AS c FROM s), q AS (SELECT *, CASE WHEN c IS DISTINCT FROM lag(c) OVER (PARTITION BY user_id ORDER BY lo) THEN 1 ELSE 0 END AS turn FROM b),
i AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY lo) AS isle FROM q) SELECT user_id, max(n)::BIGINT AS longest FROM (SELECT user_id, isle, max(coalesce(hi, fin)) - min(lo) AS n FROM i, t WHERE c GROUP BY ALL) GROUP BY user_id""")
def _(spark, d):
    s = per_user(spark, d)
    return s.last("cents").longest(F.col("value") > 5000, _end(s))


# -- entities -----------------------------------------------------------------------------------
@query("entity_user", f"{E_SQL} SELECT user_id, arg_max(event_type, (ts, seq)) AS event_type, arg_max(cents, (ts, seq)) AS cents, arg_max(cents, (ts, seq)) > 5000 AS rich FROM e GROUP BY user_id")
def _(spark, d):
    s = events(spark, d).select(user_id=F.col("user_id"), event_type=F.col("event_type"), cents=F.col("cents"))
    return Entity.create_from("User", s, "user_id").member("rich", F.col("cents") > 5000).all()


def orders(spark: SparkSession, d: str) -> Stream:
    df = read(spark, d, "orders").select(F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("order_id"))
    return Stream(df)


@query("entity_belongs_to", """SELECT o_orderkey AS order_id, c_mktsegment AS segment, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, d):
    c = read(spark, d, "customer").select(F.lit(0).cast("long").alias("ts"), F.lit(0).cast("long").alias("seq"), F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation_id"))
    n = read(spark, d, "nation").select(F.lit(0).cast("long").alias("ts"), F.lit(0).cast("long").alias("seq"), F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("name"))
    customer = Entity.create_from("Customer", Stream(c), "customer_id").belongs_to(Entity.create_from("Nation", Stream(n), "nation_id"), {"name": "nation"})
    order = Entity.create_from("Order", orders(spark, d), "order_id").belongs_to(customer, {"segment": "segment", "nation": "nation"})
    return order.all().where("segment IS NOT NULL").select("order_id", "segment", "nation")


@query("entity_has_many", """WITH m AS (SELECT o_custkey AS customer_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS ts, count(*) AS n FROM orders GROUP BY ALL)
SELECT customer_id, ts, CAST(sum(n) OVER (PARTITION BY customer_id ORDER BY ts) AS BIGINT) AS value FROM m""")
def _(spark, d):
    o = orders(spark, d)
    customer = Entity.create_from("Customer", o.select(customer_id=F.col("customer_id"), order_id=F.col("order_id")), "customer_id")
    return customer.has_many(Entity.create_from("Order", o, "order_id"), "orders").table.select("customer_id", "ts", F.col("orders").cast("long").alias("value"))


# -- listeners, functions, enums ----------------------------------------------------------------
STEP_SQL = ", z AS (SELECT user_id, ts, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS x FROM e WHERE event_type IN ('click', 'view'))"


@query("listener_counter", E_SQL + STEP_SQL + changes_sql(f"CAST(sum(x) {SO_FAR} AS BIGINT)", source="z", first="value IS DISTINCT FROM 0"))
def _(spark, d):
    s = per_user(spark, d)
    both = tagged(kind(s, "click"), kind(s, "view"))
    return counter(("user_id",), both, F.when(F.col("listener") == 0, 1).otherwise(-1), 0).df.select("user_id", "ts", F.col("value").cast("long"))


@query("listener_reset", f"""{E_SQL}, g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS g FROM e),
z AS (SELECT user_id, ts, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE cents END) OVER (PARTITION BY user_id, g ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS x FROM g)""" + changes_sql("CAST(x AS BIGINT)", source="z", first="value IS DISTINCT FROM 0"))
def _(spark, d):
    s = per_user(spark, d)
    return resetting(("user_id",), tagged(s, fields=("event_type", "cents")), F.col("cents"), F.col("event_type") == "purchase").df.select("user_id", "ts", F.col("value").cast("long"))


@query("ema", f"""WITH RECURSIVE e AS ({E_SQL.split(' AS (', 1)[1][:-1]}), l AS (SELECT user_id, ts, CAST(cents AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS n FROM e),
r AS (SELECT user_id, ts, n, x AS total, x AS v FROM l WHERE n = 1 UNION ALL SELECT l.user_id, l.ts, l.n, r.total + l.x, CASE WHEN l.n <= 12 THEN (r.total + l.x) / l.n ELSE 2.0::DOUBLE / 13 * l.x + (1 - 2.0::DOUBLE / 13) * r.v END
  FROM r JOIN l ON l.user_id = r.user_id AND l.n = r.n + 1),
c AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM r) SELECT user_id, ts, round(v, 4) AS value FROM c WHERE v IS DISTINCT FROM was""")
def _(spark, d):
    return ema(per_user(spark, d), "cents", 12).df.select("user_id", "ts", F.round("value", 4).alias("value"))


LEVEL = Enum(Gain="long", Loss="long", Flat=None)


@query("variant_classify", f"{E_SQL} SELECT event_id, CASE WHEN cents >= 9000 THEN 'big ' || cents WHEN cents > 5000 THEN 'gain' WHEN cents = 5000 THEN 'flat' ELSE 'loss' END AS label FROM e")
def _(spark, d):
    x = F.col("cents")
    v = F.when(x > 5000, LEVEL.Gain(x)).when(x < 5000, LEVEL.Loss(x)).otherwise(LEVEL.Flat())
    df = events(spark, d).df.withColumn("v", v)
    label = match(F.col("v"), (variant("Gain", bind("n")), lambda n: n >= 9000, lambda n: plus_text("big ", n)), (variant("Gain"), F.lit("gain")), (variant("Flat"), F.lit("flat")), (anything, F.lit("loss")))
    return df.select("event_id", label.alias("label"))


@query("literal_match", f"{E_SQL} SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS code FROM e")
def _(spark, d):
    return events(spark, d).df.select("event_id", match(F.col("event_type"), (literal("click"), 1), (literal("view"), 2), (anything, 0)).alias("code"))


@query("recursive_function", "WITH RECURSIVE r(n, f) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
def _(spark, d):
    return recursive(spark, "SELECT 1L, 1L", "n + 1, f * (n + 1)", "n >= 15", "n, f")


@query("ticks_resample", f"""{E_SQL}, k AS (SELECT unnest(generate_series((SELECT min(ts) // {DAY} FROM e), (SELECT max(ts) // {DAY} FROM e))) * {DAY} AS ts), u AS (SELECT DISTINCT user_id FROM e),
g AS (SELECT user_id, ts FROM u, k), l AS (SELECT user_id, ts, cents FROM e) SELECT g.user_id, g.ts, l.cents AS value FROM g ASOF LEFT JOIN l ON g.user_id = l.user_id AND g.ts >= l.ts""")
def _(spark, d):
    s = per_user(spark, d)
    lo, hi = s.df.agg(F.floor(F.min("ts") / DAY), F.floor(F.max("ts") / DAY)).first()
    clock = ticks(spark, (lo or 0) * DAY, (hi if hi is not None else -1) * DAY, DAY)
    grid = clock.cross(s.df.select("user_id").distinct()).groupby("user_id")
    last = Value(s.df.select("user_id", "ts", F.col("cents").alias("value")), ("user_id",))
    return grid.seeing(last, value="value").df.select("user_id", "ts", "value")


# -- bodies, records, indexes, aggregates of one's own ------------------------------------------
@query("grouped_body", E_SQL + f""", u AS (SELECT user_id, ts, cents AS x FROM e UNION ALL SELECT user_id, ts + {HOUR}, NULL FROM e),
n AS (SELECT user_id, ts, count(x) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW) AS n, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS x FROM u)""" + changes_sql("x * n", source="n"))
def _(spark, d):
    body = lambda g: g.last("cents").compare(g.window(HOUR).agg("count", "cents"), F.col("value") * F.col("other"))
    return events(spark, d).grouped(["user_id"], body).df.select("user_id", "ts", "value")


@query("record_of_values", E_SQL + ", r AS (SELECT user_id, ts, arg_max(cents, seq) AS cents, arg_max(event_type, seq) AS event_type FROM e GROUP BY ALL), \
c AS (SELECT *, lag(cents) OVER k AS c0, lag(event_type) OVER k AS t0 FROM r WINDOW k AS (PARTITION BY user_id ORDER BY ts)) \
SELECT user_id, ts, cents, event_type FROM c WHERE cents IS DISTINCT FROM c0 OR event_type IS DISTINCT FROM t0")
def _(spark, d):
    s = per_user(spark, d)
    return Value.record_of(cents=s.last("cents"), event_type=s.last("event_type")).df.select("user_id", "ts", "value.cents", "value.event_type")


@query("uda_window_avg", V_SQL + f", m AS (SELECT user_id, lo AS ts, x, 1 AS n FROM s UNION ALL SELECT user_id, hi + {HOUR}, -x, -1 FROM s WHERE hi IS NOT NULL), \
t AS (SELECT user_id, ts, sum(x) {SO_FAR} AS x, sum(n) {SO_FAR} AS n FROM m)" + changes_sql("CAST(CASE WHEN n = 0 THEN 0 ELSE x // n END AS BIGINT)", source="t"))
def _(spark, d):
    w = per_user(spark, d).last("cents").window(HOUR)
    total, count = w.uda(F.col("value"), -F.col("value")), w.uda(F.lit(1), F.lit(-1))
    return total.compare(count, F.when(F.col("other") == 0, 0).otherwise(divide(F.col("value"), F.col("other"))).cast("long")).df.select("user_id", "ts", "value")


@query("live_index", E_SQL + ", k AS (SELECT ts, user_id AS k FROM e WHERE event_type = 'purchase'), p AS (SELECT e.ts, k.k FROM e ASOF JOIN k ON e.ts >= k.ts), \
l AS (SELECT user_id, ts, cents FROM e), v AS (SELECT p.ts, l.cents AS x FROM p ASOF LEFT JOIN l ON p.k = l.user_id AND p.ts >= l.ts)" + changes_sql("x", keys="", source="v"))
def _(spark, d):
    s = per_user(spark, d)
    buyer = kind(events(spark, d), "purchase").last("user_id")
    return s.last("cents").index(buyer).df.select("ts", "value")


HELD = f"OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW)"
U_SQL = E_SQL + f", u AS (SELECT user_id, ts, cents AS x FROM e UNION ALL SELECT user_id, ts + {HOUR}, NULL FROM e)"


@query("window_index_first", U_SQL + changes_sql(f"first_value(x IGNORE NULLS) {HELD}", source="u"))
def _(spark, d):
    return per_user(spark, d).window(HOUR).index(0, "cents").df.select("user_id", "ts", "value")


@query("window_index_second_last", U_SQL + f", h AS (SELECT user_id, ts, list(x) FILTER (x IS NOT NULL) {HELD} AS l FROM u)" + changes_sql("l[-2]", source="h"))
def _(spark, d):
    return per_user(spark, d).window(HOUR).index(-2, "cents").df.select("user_id", "ts", "value")


@query("window_sort_by", E_SQL + f""", u AS (SELECT user_id, ts, {{'o': -cents, 't': -ts, 'q': -seq, 'id': event_id}} AS x FROM e UNION ALL SELECT user_id, ts + {HOUR}, NULL FROM e),
h AS (SELECT user_id, ts, array_to_string(list_transform(list_sort(coalesce(list(x) FILTER (x IS NOT NULL) {HELD}, []))[1:3], lambda y: y.id), ',') AS l FROM u)""" + changes_sql("l", source="h"))
def _(spark, d):
    top = per_user(spark, d).window(HOUR).sort_by(-F.col("cents"), fields=("event_id",), k=3)
    return top.select(F.array_join(F.transform("value", lambda e: e["event_id"].cast("string")), ",")).df.select("user_id", "ts", "value")


@query("dict_count", V_SQL + ", f AS (SELECT user_id, lo AS ts, x > 5000 AS vis, coalesce(lag(x > 5000) OVER (PARTITION BY user_id ORDER BY lo), FALSE) AS was FROM s), \
g AS (SELECT ts, sum(vis::INT - was::INT) AS d FROM f GROUP BY ts HAVING bool_or(vis <> was)), r AS (SELECT ts, sum(d) OVER (ORDER BY ts) AS n FROM g)" + changes_sql("CAST(n AS BIGINT)", keys="", source="r"))
def _(spark, d):
    return per_user(spark, d).last("cents").count(F.col("value") > 5000).df.select("ts", F.col("value").cast("long"))


@query("global_running_avg", E_SQL + changes_sql("CAST(trunc((sum(cents) OVER w - sum(cents) OVER w % count(cents) OVER w) / count(cents) OVER w) AS BIGINT)".replace("OVER w", "OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING)"), keys=""))
def _(spark, d):
    return events(spark, d).agg("avg", "cents").df.select("ts", "value")


@query("global_window_sum", E_SQL + f", u AS (SELECT ts, cents AS x FROM e UNION ALL SELECT ts + {HOUR}, NULL FROM e)" + changes_sql(f"CAST(coalesce(sum(x) OVER (ORDER BY ts RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW), 0) AS BIGINT)", keys="", source="u"))
def _(spark, d):
    return events(spark, d).window(HOUR).agg("sum", "cents").df.select("ts", F.col("value").cast("long"))


@query("value_window_avg", V_SQL + f", p AS (SELECT DISTINCT user_id, lo AS ts FROM s UNION SELECT user_id, hi + {HOUR} FROM s WHERE hi IS NOT NULL), \
j AS (SELECT p.user_id, p.ts, CAST(sum(x) // count(x) AS BIGINT) AS x FROM p JOIN s ON p.user_id = s.user_id AND lo <= p.ts AND (hi IS NULL OR p.ts < hi + {HOUR}) GROUP BY ALL)" + changes_sql("x", source="j"))
def _(spark, d):
    return per_user(spark, d).last("cents").window(HOUR).agg("avg").df.select("user_id", "ts", "value")


@query("dynamic_window", f"""{E_SQL}, a AS (SELECT *, ts - (cents % 5 + 1) * {HOUR} AS lo FROM e)
SELECT a.event_id, count(*) AS n, CAST(sum(e.cents) AS BIGINT) AS total FROM a JOIN e ON a.user_id = e.user_id AND e.ts > a.lo AND e.ts <= a.ts GROUP BY a.event_id""")
def _(spark, d):
    s, length = per_user(spark, d), (F.col("cents") % 5 + 1) * HOUR
    n = s.dynamic(length, "count", "cents", name="n").select("event_id", "n")
    return s.dynamic(length, "sum", "cents", name="total").join(n, "event_id").select("event_id", "n", "total")


@query("while_window", f"""{E_SQL}, g AS (SELECT *, sum(CASE WHEN cents > 2000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS episode FROM e)
SELECT user_id, CAST(episode AS BIGINT) AS episode, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM g WHERE cents > 2000 GROUP BY ALL""")
def _(spark, d):
    s = per_user(spark, d).while_(F.col("cents") > 2000)
    return s.df.groupBy("user_id", "episode").agg(F.count("*").alias("n"), F.sum("cents").alias("total"))


DAILY_SQL = f"""{E_SQL}, c AS (SELECT user_id, ts // {DAY} AS ts, sum(cents)::BIGINT AS clicks FROM e WHERE event_type = 'click' GROUP BY ALL),
v AS (SELECT user_id, ts // {DAY} AS ts, sum(cents)::BIGINT AS views FROM e WHERE event_type = 'view' GROUP BY ALL)"""
for _how, _word in {"right": "RIGHT", "full": "FULL"}.items():
    QUERIES[f"{_how}_outer_join"] = lambda spark, d, how=_how: daily(kind(events(spark, d), "click"), "clicks").join(
        daily(kind(events(spark, d), "view"), "views"), ["user_id", "ts"], how=how).select("user_id", "ts", "clicks", "r_views")
    ORACLE[f"{_how}_outer_join"] = f"{DAILY_SQL} SELECT user_id, ts, clicks, views AS r_views FROM c {_word} JOIN v USING (user_id, ts)"


@query("full_join_within", f"""{E_SQL} SELECT a.event_id, b.event_id AS r_event_id FROM (SELECT * FROM e WHERE event_type = 'click') a
FULL JOIN (SELECT * FROM e WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND abs(a.ts - b.ts) <= {HOUR}""")
def _(spark, d):
    s = events(spark, d)
    return kind(s, "click").join(kind(s, "purchase"), ["user_id"], within=HOUR, how="full").select("event_id", "r_event_id")


@query("cross_join", f"{E_SQL}, c AS (SELECT user_id, arg_max(cents, (ts, seq)) AS value FROM e GROUP BY user_id) SELECT c.user_id, r_regionkey, value * (r_regionkey + 1) AS scaled FROM c, region")
def _(spark, d):
    last = Stream(per_user(spark, d).last("cents").snapshot())
    return last.cross(read(spark, d, "region").select("r_regionkey")).df.select("user_id", "r_regionkey", (F.col("value") * (F.col("r_regionkey") + 1)).alias("scaled"))


@query("comprehension", f"{E_SQL} SELECT event_id, cents + 1 AS a FROM e WHERE cents > 5000")
def _(spark, d):
    return comprehension(events(spark, d), F.col("cents") > 5000, event_id=F.col("event_id"), a=F.col("cents") + 1).df.select("event_id", "a")


@query("chosen_function", f"{E_SQL} SELECT event_id, CASE event_type WHEN 'click' THEN cents * 2 WHEN 'view' THEN cents * cents ELSE -cents END AS value FROM e")
def _(spark, d):
    f = choose(F.col("event_type"), {"click": lambda x: x * 2, "view": lambda x: x * x}, lambda x: -x)
    return events(spark, d).df.select("event_id", f(F.col("cents")).alias("value"))


@query("way_between_events", f"""{E_SQL}, p AS (SELECT user_id, event_id, radians(cents % 90) AS a, radians(cents % 180) AS o, lag(radians(cents % 90)) OVER k AS a0, lag(radians(cents % 180)) OVER k AS o0 FROM e WINDOW k AS (PARTITION BY user_id ORDER BY ts, seq))
SELECT event_id, round(2 * 6371.0 * asin(sqrt(least(sin((a - a0) / 2) ** 2 + cos(a0) * cos(a) * sin((o - o0) / 2) ** 2, 1.0))), 3) AS way FROM p WHERE a0 IS NOT NULL""")
def _(spark, d):
    s = per_user(spark, d)
    at = s.prev("cents").updates().df
    seen = s.df.join(at.withColumnRenamed("value", "was"), ["user_id", "ts"])
    return seen.select("event_id", F.round(distance(F.col("was") % 90, F.col("was") % 180, F.col("cents") % 90, F.col("cents") % 180), 3).alias("way"))


@query("listener_states", E_SQL + ", n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS n FROM e), z AS (SELECT user_id, ts, chr(CAST(65 + (n - 1) % 3 AS INT)) AS x FROM n)" + changes_sql("x", source="z"))
def _(spark, d):
    step = lambda s, e: {"A": "B", "B": "C", "C": "A"}.get(s, "A")
    return fold(("user_id",), tagged(per_user(spark, d), fields=("event_type",)), step, None, "string").df.select("user_id", "ts", "value")


def children(spark: SparkSession, d: str) -> tuple[Entity, Entity]:
    o = read(spark, d, "orders").select(F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("customer_id"),
                                        F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("order_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return Entity("Customer", "customer_id", Stream(o), o), Entity.create_from("Order", Stream(o), "order_id")


@query("entity_child_sum", """WITH m AS (SELECT o_custkey AS customer_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS ts,
  sum(CASE WHEN o_orderpriority LIKE '1%' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS n FROM orders GROUP BY ALL),
r AS (SELECT customer_id, ts, CAST(sum(n) OVER (PARTITION BY customer_id ORDER BY ts) AS BIGINT) AS value FROM m),
c AS (SELECT *, lag(value) OVER (PARTITION BY customer_id ORDER BY ts) AS was FROM r) SELECT customer_id, ts, value FROM c WHERE value IS DISTINCT FROM was""")
def _(spark, d):
    customer, order = children(spark, d)
    return child_sum(customer, order, F.col("cents"), where=F.col("priority").startswith("1")).df.select("customer_id", "ts", F.col("value").cast("long"))


@query("entity_memberships", V_SQL.replace("arg_max(cents, seq)", "arg_max(event_type, seq)") + " SELECT x AS segment_id, user_id AS vehicle_id, lo AS valid_from, hi AS valid_to FROM s")
def _(spark, d):
    vehicles = events(spark, d).select(vehicle_id=F.col("user_id"), segment_id=F.col("event_type"))
    return memberships(Entity("Segment", "segment_id", vehicles, vehicles.df), Entity.create_from("Vehicle", vehicles, "vehicle_id"))


@query("entity_births", f"{E_SQL} SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id")
def _(spark, d):
    s = events(spark, d).select(user_id=F.col("user_id"), cents=F.col("cents"))
    return Entity.create_from("User", [s.where("cents > 5000"), s.where("cents <= 5000")], "user_id").on_new().df.select("user_id", "ts")


from . import applications  # noqa: E402, F401  (registers its queries)
