"""Streams, windows, continuous values and dictionaries over DataFrames.

Each is a thin immutable wrapper: a frame, its key columns, and nothing that runs. A wrapper with
keys is a dictionary (an aggregate's per key); without keys it is one global value. Time is a
``long`` column ``ts``, rows of one instant are ordered by ``seq``, and a result is what holds once
the whole instant has been seen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import as_of, beside, by_time, changed, interval_join, intervals, overlapping, prefix

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "stddev": F.stddev_samp,
    "any": lambda c: F.coalesce(F.bool_or(c), F.lit(False)),
    "all": lambda c: F.coalesce(F.bool_and(c), F.lit(True)),
}


def over(kind: str, c: Column, w, whole: bool) -> Column:
    """An aggregate over a window specification; integer averages truncate."""
    if kind == "avg":
        s, n = F.sum(c).over(w), F.count(c).over(w)
        return F.when(n > 0, ((s - s % n) / n).cast("long") if whole else s / n)
    if kind in ("sum", "any", "all"):
        plain = {"sum": F.sum, "any": F.bool_or, "all": F.bool_and}[kind]
        return F.coalesce(plain(c).over(w), F.lit({"sum": 0, "any": False, "all": True}[kind]))
    return {"count": F.count, "max": F.max, "min": F.min, "stddev": F.stddev_samp}[kind](c).over(w)


def _parts(kind: str) -> dict[str, tuple[str, Column]]:
    """The running parts of an aggregate of ``_x``, by name."""
    x = F.col("_x")
    s, n, m = {"_s": ("sum", x)}, {"_n": ("count", x)}, "_m"
    if kind == "stddev":
        return {"_s": ("sum", x.cast("double")), "_q": ("sum", x.cast("double") * x.cast("double")), **n}
    return {"sum": s, "count": n, "avg": {**s, **n}, "min": {m: ("min", x)}, "max": {m: ("max", x)},
            "any": {m: ("max", x.cast("int"))}, "all": {m: ("min", x.cast("int"))}}[kind]


def _whole(kind: str, whole: bool, parts: dict[str, Column] | None = None) -> Column:
    """An aggregate of its parts, which are columns of their names or as given."""
    s, n, m = ((parts or {}).get(p, F.col(p)) for p in ("_s", "_n", "_m"))
    if kind == "stddev":
        return F.when(n > 1, F.sqrt(F.greatest(F.col("_q") - s * s / n, F.lit(0.0)) / (n - 1)))
    if kind == "avg":
        return F.when(n > 0, ((s - s % n) / n).cast("long") if whole else s / n)
    return {"sum": s, "count": n, "min": m, "max": m, "any": F.coalesce(m == 1, F.lit(False)), "all": F.coalesce(m == 1, F.lit(True))}[kind]


@dataclass(frozen=True)
class Stream:
    """Events: each row is an instant's pulse."""

    df: DataFrame
    keys: tuple[str, ...] = ()
    #: Width of the time buckets in which global aggregates run (in units of ``ts``).
    bucket: int = 86_400_000_000

    def where(self, cond: Column | str) -> Stream:
        """Events for which the condition is true; an unknown condition drops the event."""
        return replace(self, df=self.df.where(cond))

    def select(self, **fields: Column) -> Stream:
        """New fields; ``ts``, ``seq`` and the keys stay."""
        stay = [c for c in ("ts", "seq", *self.keys) if c not in fields]
        return replace(self, df=self.df.select(*stay, *[c.alias(k) for k, c in fields.items()]))

    def groupby(self, *keys: str | Column, **computed: Column) -> Stream:
        """Per key from here on; keys may be several, computed, and nested by grouping again."""
        df = self.df
        for k, c in computed.items():
            df = df.withColumn(k, c)
        return replace(self, df=df, keys=(*self.keys, *[k for k in keys], *computed))

    def grouped(self, keys: list[str], body: Callable[[Stream], Value]) -> Value:
        """A dictionary whose entries are what ``body`` makes of each group: any expression of its events and of global values."""
        return body(self.groupby(*keys))

    def seeing(self, value: Value, /, before: bool = False, **names: str) -> Stream:
        """Each event with another value as of its instant, or just before it: ``seeing(v, new_name='field')``."""
        on = [k for k in value.keys if k in self.df.columns]
        right = value.df.withColumn("ts", F.col("ts") + 1) if before else value.df
        return replace(self, df=as_of(self.df, right, on, {old: new for new, old in names.items()}, bucket=None if on else self.bucket))

    def merge(self, other: Stream, *keys: str) -> Stream:
        """Full outer join on instant and key; of shared fields the left one's wins, if known."""
        a, b = self.df, other.df
        on = ["ts", *keys]
        shared = [c for c in a.columns if c in b.columns and c not in on]
        b2 = b.select(*on, *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in b.columns if c not in on])
        both = a.join(b2, on, "full_outer")
        out = [F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) if c in shared else F.col(c) for c in dict.fromkeys([*on, *a.columns, *b.columns])]
        return replace(self, df=both.select(*out))

    def join(self, other: Stream, keys: list[str], within: int | None = None, how: str = "inner") -> DataFrame:
        """Equi-join with another stream (``how`` as in SQL), at most ``within`` apart in time where given.

        With ``within``, the right side is dealt into each bucket of time that it can meet, so a hot
        key is spread over its buckets; rows that an outer join keeps alone are found by number.
        """
        r = other.df.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in other.df.columns])
        if not keys and within is None:
            return self.df.join(r, how=how) if how != "cross" else self.df.crossJoin(r)
        if within is None:
            return self.df.join(r, keys, how)
        width = max(within, 1)
        l = self.df.withColumn("_b", F.floor(F.col("ts") / width)).alias("l")
        near = F.sequence(F.floor((F.col("r_ts") - within) / width), F.floor((F.col("r_ts") + within) / width))
        q = r.withColumn("_b", F.explode(near)).alias("q")
        on = (F.col("l._b") == F.col("q._b")) & (F.abs(F.col("ts") - F.col("r_ts")) <= within)
        for k in keys:
            on = on & (F.col(f"l.{k}") == F.col(f"q.{k}"))
        mine, theirs = [c for c in self.df.columns], [f"r_{c}" for c in other.df.columns if c not in keys]
        met = l.join(q, on, "left" if how in ("left", "full") else "inner").select(*[F.col(f"l.{c}") for c in mine], *[F.col(f"q.{c}") for c in theirs])
        if how not in ("right", "full"):
            return met
        there = r.withColumn("_b", F.floor(F.col("r_ts") / width)).alias("q")
        meet = self.df.withColumn("_b", F.explode(F.sequence(F.floor((F.col("ts") - within) / width), F.floor((F.col("ts") + within) / width)))).alias("l")
        alone = there.join(meet, on, "left_anti")
        kinds = dict(self.df.dtypes)
        return met.unionByName(alone.select(*[F.col(c) if c in keys else F.lit(None).cast(kinds[c]).alias(c) for c in mine], *theirs))

    def cross(self, other: DataFrame) -> Stream:
        """Each event with each row of a small table, such as a clock's ticks with all keys."""
        return replace(self, df=self.df.crossJoin(other))

    # -- aggregates from the start -------------------------------------------------------------
    def agg(self, kind: str, c: Column | str, name: str = "value") -> Value:
        """A running aggregate; a change row for each instant at which it differs."""
        c = F.col(c) if isinstance(c, str) else c
        whole = dict(self.df.select(c.alias("x")).dtypes)["x"] in ("int", "bigint", "smallint", "tinyint")
        start = F.lit({"any": False, "all": True}[kind]) if kind in ("any", "all") else None
        if not self.keys:
            rows = prefix(self.df.select("ts", "seq", c.alias("_x")), ["ts", "seq"], _parts(kind), self.bucket)
            rows = rows.groupBy("ts").agg(F.max_by(F.struct(*_parts(kind)), "seq").alias("_p")).select("ts", "_p.*")
            return Value(rows.select("ts", _whole(kind, whole).alias(name)), (), name, self.bucket).distinct_until_changed(start)
        w = by_time(self.keys).rangeBetween(Window.unboundedPreceding, 0)
        rows = self.df.withColumn(name, over(kind, c, w, whole)).select(*self.keys, "ts", name).dropDuplicates([*self.keys, "ts"])
        return Value(rows, self.keys, name, self.bucket).distinct_until_changed(start)

    def extreme(self, kind: str, by: Column | str, field: str, name: str = "value") -> DataFrame:
        """``minBy`` and ``maxBy`` of all events so far: the field of the one with the least or greatest ``by``, per key."""
        return self.df.groupBy(*self.keys).agg({"min": F.min_by, "max": F.max_by}[kind](field, by).alias(name))

    def last(self, field: str, name: str = "value") -> Value:
        """The last known (non-null) value of a field."""
        rows = self.df.where(F.col(field).isNotNull()).groupBy(*self.keys, "ts").agg(F.max_by(field, "seq").alias(name))
        return Value(rows, self.keys, name, self.bucket).distinct_until_changed()

    def last_event(self, *fields: str) -> Value:
        """The last event as a record; unknown fields keep what they were."""
        if self.keys:
            w = by_time(self.keys, "ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
            known = self.df.withColumn("value", F.struct(*[F.last(f, ignorenulls=True).over(w).alias(f) for f in fields]))
        else:
            run = prefix(self.df, ["ts", "seq"], {f"_p_{f}": ("last", F.col(f)) for f in fields}, self.bucket)
            known = run.withColumn("value", F.struct(*[F.col(f"_p_{f}").alias(f) for f in fields]))
        rows = known.groupBy(*self.keys, "ts").agg(F.max_by("value", "seq").alias("value"))
        return Value(rows, self.keys, "value", self.bucket).distinct_until_changed()

    def prev(self, field: str, name: str = "value") -> Value:
        """The known value before the last one."""
        known = self.df.where(F.col(field).isNotNull())
        if self.keys:
            known = known.withColumn(name, F.lag(field).over(by_time(self.keys, "ts", "seq")))
        else:  # of a bucket's first event, the last of the buckets before
            parts = known.withColumn("_b", F.floor(F.col("ts") / self.bucket))
            ends = parts.groupBy("_b").agg(F.max_by(field, F.struct("ts", "seq")).alias("_end"))
            starts = ends.select("_b", F.lag("_end").over(Window.orderBy("_b")).alias("_start"))
            own = F.lag(field).over(Window.partitionBy("_b").orderBy("ts", "seq"))
            known = parts.withColumn(name, own).join(starts, "_b").withColumn(name, F.coalesce(name, "_start"))
        rows = known.groupBy(*self.keys, "ts").agg(F.max_by(name, "seq").alias(name)).where(F.col(name).isNotNull())
        return Value(rows, self.keys, name, self.bucket).distinct_until_changed()

    # -- windows -------------------------------------------------------------------------------
    def window(self, length: int, few: bool = False) -> EventWindow:
        return EventWindow(self, length, few)

    def rows_window(self, n: int, kind: str, field: str) -> DataFrame:
        """An aggregate of the last ``n`` events at each event."""
        w = by_time(self.keys, "ts", "seq").rowsBetween(-(n - 1), 0)
        return self.df.withColumn("value", over(kind, F.col(field), w, False))

    def ranged(self, far: int, near: int, kind: str, field: str) -> DataFrame:
        """An aggregate of the events between ``far`` and ``near`` ago, at each event."""
        return self.df.withColumn("value", over(kind, F.col(field), by_time(self.keys).rangeBetween(-far, -near), False))

    def dynamic(self, length: Column, kind: str, field: str, bucket: int | None = None, name: str = "value") -> DataFrame:
        """An aggregate, at each event, of the events of its own last ``length``: a window whose size may change.

        Joined by key and bucket of time, so that a hot key is many tasks.
        """
        width = bucket or self.bucket
        mine = self.df.withColumn("_n", F.monotonically_increasing_id()).withColumn("_from", F.col("ts") - length)
        at = mine.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_from") + 1) / width), F.floor(F.col("ts") / width)))).alias("l")
        seen = self.df.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys], F.col("ts").alias("_ts"), F.col(field).alias("_x")).withColumn("_b", F.floor(F.col("_ts") / width)).alias("q")
        on = (F.col("l._b") == F.col("q._b")) & (F.col("_ts") > F.col("_from")) & (F.col("_ts") <= F.col("ts"))
        for k in self.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        fields = [F.first(F.col(f"l.{c}")).alias(c) for c in self.df.columns]
        return at.join(seen, on).groupBy("_n").agg(*fields, AGGREGATES[kind](F.col("_x")).alias(name)).drop("_n")

    def while_(self, cond: Column) -> Stream:
        """Windows that last while a condition holds: its events, numbered by how often it has failed before them."""
        holds = F.coalesce(cond, F.lit(False))
        w = by_time(self.keys, "ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
        return replace(self, df=self.df.withColumn("episode", F.sum((~holds).cast("int")).over(w)).where(holds))

    def episodes(self, start: Column, stop: Column | None = None) -> Stream:
        """Semantic windows: events numbered by the last ``start`` before them; those after a ``stop`` have none."""
        w = by_time(self.keys, "ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
        n = F.sum(start.cast("int")).over(w)
        df = self.df.withColumn("episode", n).where("episode > 0")
        if stop is not None:
            own = Window.partitionBy(*self.keys, "episode").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
            df = df.withColumn("_over", F.coalesce(F.max(stop.cast("int")).over(own), F.lit(0))).where("_over = 0").drop("_over")
        return replace(self, df=df)

    def when(self, value: Value, body: Column, *names: str) -> Value:
        """``body`` for each event after all values of its instant have settled; holds until the next."""
        seen = self.seeing(value, **{n: value.field for n in names or (value.field,)})
        rows = seen.df.withColumn("value", body).groupBy(*self.keys, "ts").agg(F.max_by("value", "seq").alias("value"))
        return Value(rows, self.keys, "value", self.bucket).distinct_until_changed()


def _summed(moves: DataFrame, keys: tuple[str, ...], name: str, bucket: int, initial: float = 0) -> Value:
    """The running sum of ``_d``, a change each instant at which it differs."""
    at = moves.groupBy(*keys, "ts").agg(F.sum("_d").alias("_d"))
    if keys:
        out = at.withColumn(name, F.sum("_d").over(by_time(keys).rowsBetween(Window.unboundedPreceding, 0)) + initial)
    else:
        out = prefix(at, ["ts"], {name: ("sum", F.col("_d"))}, bucket).withColumn(name, F.col(name) + initial)
    return Value(out.drop("_d"), keys, name, bucket).distinct_until_changed()


@dataclass(frozen=True)
class EventWindow:
    """The events of ``(now - length, now]``; an event leaves at ``ts + length``."""

    stream: Stream
    length: int
    #: Few keys, of many events each: an aggregate runs by block of time.
    few: bool = False

    def where(self, cond: Column | str) -> EventWindow:
        return replace(self, stream=self.stream.where(cond))

    def select(self, **fields: Column) -> EventWindow:
        return replace(self, stream=self.stream.select(**fields))

    def groupby(self, *keys: str) -> EventWindow:
        return replace(self, stream=self.stream.groupby(*keys))

    def _spread(self, df: DataFrame) -> tuple[DataFrame, tuple[str, ...], Column]:
        """Rows in partitions that hold all that their windows see, the partitions' keys, and whether a row is its partition's own.

        Without keys, each bucket of time also holds what its first windows reach back to.
        """
        s = self.stream
        if s.keys:
            return df, s.keys, F.lit(True)
        width = max(s.bucket, self.length)
        near = F.sequence(F.floor(F.col("ts") / width), F.floor((F.col("ts") + self.length - 1) / width))
        return df.withColumn("_b", F.explode(near)), ("_b",), F.col("_b") == F.floor(F.col("ts") / width)

    def at_events(self, kind: str, field: str, name: str = "value") -> DataFrame:
        """The aggregate at each event: a plain range frame."""
        rows, keys, own = self._spread(self.stream.df)
        w = by_time(keys).rangeBetween(-(self.length - 1), 0)
        return rows.withColumn(name, over(kind, F.col(field), w, False)).where(own).drop("_b")

    def _probed(self, x: Column, made: Callable[[object], Column], name: str, initial: Column | None = None) -> Value:
        """``made`` of a window over the events held, in column ``_x`` (null: only time has passed), at each event and each expiry."""
        s = self.stream
        rows = s.df.select(*s.keys, "ts", "seq", x.alias("_x"))
        probes = rows.select(*s.keys, (F.col("ts") + self.length).alias("ts"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(rows.schema["_x"].dataType).alias("_x"))
        both, keys, own = self._spread(rows.unionByName(probes))
        w = by_time(keys).rangeBetween(-(self.length - 1), 0)
        out = both.withColumn(name, made(w)).where(own).select(*s.keys, "ts", name).dropDuplicates([*s.keys, "ts"])
        return Value(out, s.keys, name, s.bucket).distinct_until_changed(initial)

    def agg(self, kind: str, c: Column | str, name: str = "value") -> Value:
        """The aggregate as a value, with the changes that expiry brings."""
        c = F.col(c) if isinstance(c, str) else c
        whole = self.stream.df.select(c.alias("x")).dtypes[0][1] in ("int", "bigint", "smallint", "tinyint")
        initial = F.lit({"any": False, "all": True}[kind]) if kind in ("any", "all") else None
        if kind == "stddev":  # its parts would cancel
            return self._probed(c, lambda w: over(kind, F.col("_x"), w, whole), name, initial)
        s, spread = self.stream, self.few or not self.stream.keys
        rows = self._moves(c)
        rows = self._met(rows if spread else rows.repartition(*s.keys), kind, whole, name)
        rows = rows.dropDuplicates([*s.keys, "_b", "ts"])
        out = Value(rows.select(*s.keys, "ts", name), s.keys, name, s.bucket)
        if not spread:
            return out.distinct_until_changed(initial)
        differs = ~F.col(name).eqNullSafe(F.col("_before"))
        if initial is None:  # a key's first row always stays
            first = s.df.groupBy(*s.keys).agg(F.min("ts").alias("_first"))
            rows, differs = beside(rows, first, s.keys), differs | (F.col("ts") == F.col("_first"))
        return replace(out, df=rows.where(differs).select(*s.keys, "ts", name), raw=out.df)

    def seen(self, points: DataFrame, kind: str, c: Column | str, name: str = "value") -> DataFrame:
        """``points``, rows with the keys and ``ts``, with the aggregate as of their instant: in one pass with the events."""
        c = F.col(c) if isinstance(c, str) else c
        whole = self.stream.df.select(c.alias("x")).dtypes[0][1] in ("int", "bigint", "smallint", "tinyint")
        rows = self._moves(c).withColumn("_row", F.lit(None).cast(points.schema))
        at = points.select(*self.stream.keys, "ts", F.struct(*points.columns).alias("_row"))
        met = self._met(rows.unionByName(at, allowMissingColumns=True), kind, whole, name)
        return met.where("_row IS NOT NULL").select("_row.*", name)

    def _moves(self, c: Column) -> DataFrame:
        """What comes (``_in``) and what leaves, with ``c`` as ``_x``."""
        come = self.stream.df.select(*self.stream.keys, "ts", F.lit(True).alias("_in"), c.alias("_x"))
        return come.unionByName(come.withColumn("ts", F.col("ts") + self.length).withColumn("_in", F.lit(False)))

    def _met(self, moves: DataFrame, kind: str, whole: bool, name: str) -> DataFrame:
        """``moves`` with the aggregate at their instant and just before it (``_before``), at a cost that does not depend on how many events a window holds.

        Time is cut into blocks of ``length`` (``_b``). A window that ends in a block holds what has come in
        the block so far and what came in the block before and leaves later in this one: two running
        aggregates, one forwards and one backwards, neither of which takes anything away.
        """
        rows = moves.withColumn("_b", F.col("ts") - F.pmod(F.col("ts"), F.lit(self.length)))
        run = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        zero = lambda x: F.coalesce(x, F.lit(0))
        met = {"sum": lambda a, b: zero(a) + zero(b), "count": lambda a, b: a + b, "min": F.least, "max": F.greatest}
        keys, start = (*self.stream.keys, "_b"), Window.unboundedPreceding
        on, back = by_time(keys), by_time(keys, F.col("ts").desc())
        ends = {"_now": (on.rangeBetween(start, 0), back.rangeBetween(start, -1)), "_before": (on.rangeBetween(start, -1), back.rangeBetween(start, 0))}
        halves = {}  # in one select: one sort for each direction
        for p, (how, x) in _parts(kind).items():
            for end, (so_far, later) in ends.items():
                halves |= {p + end + "_a": run[how](F.when(F.col("_in"), x)).over(so_far), p + end + "_z": run[how](F.when(~F.col("_in"), x)).over(later)}
        out = rows.select("*", *[c.alias(half) for half, c in halves.items()])
        both = {end: {p: met[how](F.col(p + end + "_a"), F.col(p + end + "_z")).cast(out.schema[p + end + "_a"].dataType) for p, (how, _) in _parts(kind).items()} for end in ends}
        return out.select(*rows.columns, _whole(kind, whole, both["_now"]).alias(name), _whole(kind, whole, both["_before"]).alias("_before"))

    def index(self, i: int, field: str, name: str = "value") -> Value:
        """``w[i]``: the field of the oldest event held for 0, of the newest for -1, and so on; null beyond the window.

        Events of one instant stand in no order of their own.
        """
        if i >= 0:
            return self._probed(F.struct(F.col(field).alias("x")), lambda w: F.nth_value("_x", i + 1, ignoreNulls=True).over(w)["x"], name)
        s = self.stream
        back = F.lag(F.struct("ts", F.col(field).alias("x")), -i - 1).over(by_time(s.keys, "ts", "seq"))
        had = replace(self, stream=replace(s, df=s.df.withColumn("_back", F.struct(back.alias("e")))))
        last = lambda w: F.last("_x", ignorenulls=True).over(w)["e"]
        return had._probed(F.col("_back"), lambda w: F.when(last(w)["ts"] > F.col("ts") - self.length, last(w)["x"]), name)

    def sort_by(self, *order: Column, fields: tuple[str, ...], k: int | None = None, name: str = "value") -> Value:
        """The events held in order, newest first where it ties, as an array of their fields; with ``k`` the first of them."""
        rank = [c.alias(f"o{j}") for j, c in enumerate(order)]
        x = F.struct(*rank, (-F.col("ts")).alias("t"), (-F.col("seq")).alias("q"), *fields)

        def made(w) -> Column:
            held = F.sort_array(F.collect_list("_x").over(w))
            held = F.slice(held, 1, k) if k else held
            return F.transform(held, lambda e: F.struct(*[e[f].alias(f) for f in fields]))

        return self._probed(x, made, name)

    def uda(self, added: Column, expired: Column, initial: float = 0, name: str = "value") -> Value:
        """A user's aggregate that adds up: what an event brings when it comes and when it leaves."""
        moves = self.stream.df.select(*self.stream.keys, "ts", added.alias("_d")).unionByName(self.expired().df.select(*self.stream.keys, "ts", expired.alias("_d")))
        return _summed(moves, self.stream.keys, name, self.stream.bucket, initial)

    def added(self) -> Stream:
        return self.stream

    def expired(self) -> Stream:
        return replace(self.stream, df=self.stream.df.withColumn("ts", F.col("ts") + self.length))

    def log(self) -> DataFrame:
        """Both kinds of change in one frame, with ``op``."""
        return self.added().df.withColumn("op", F.lit("added")).unionByName(self.expired().df.withColumn("op", F.lit("expired")))

    def contents(self, now: int, order: list[Column] | None = None) -> DataFrame:
        """The events held at an instant, oldest first or in another order."""
        held = self.stream.df.where((F.col("ts") > now - self.length) & (F.col("ts") <= now))
        return held.orderBy(*(order or ["ts", "seq"]))


@dataclass(frozen=True)
class Value:
    """A continuous value: a step function, or with keys a dictionary of them."""

    df: DataFrame
    keys: tuple[str, ...] = ()
    field: str = "value"
    bucket: int = 86_400_000_000
    #: All settings of the value, also those that left it as it was.
    raw: DataFrame | None = None

    def distinct_until_changed(self, initial: Column | None = None) -> Value:
        return replace(self, df=changed(self.df, self.keys, [self.field], initial, None if self.keys else self.bucket), raw=self.df)

    def select(self, expr: Column) -> Value:
        """Map the value; for a dictionary, each entry's."""
        df = self.df if self.raw is None else self.raw
        return replace(self, df=df.withColumn(self.field, expr)).distinct_until_changed()

    def compare(self, other: Value, expr: Column, name: str = "other") -> Value:
        """An expression of two values (of one key, or global): evaluated when either changes."""
        on = [k for k in self.keys if k in other.keys]
        if self.keys and not other.keys:  # a global value changes every live key: keys meet its changes by bucket of time
            last = other.df.agg(F.max("ts")).first()[0]
            at = lambda c: F.floor(c / self.bucket)
            born = self.df.groupBy(*self.keys).agg(F.min("ts").alias("_born")).where(F.col("_born") <= F.lit(last))
            live = born.withColumn("_b", F.explode(F.sequence(at(F.col("_born")), at(F.lit(last)))))
            points = live.join(other.df.select("ts", at(F.col("ts")).alias("_b")), "_b").where("ts >= _born").drop("_b", "_born")
        else:
            points = other.df.select(*on, "ts")
        points = points.unionByName(self.df.select(*self.keys, "ts")).distinct()
        mine = as_of(points, self.df, list(self.keys), {self.field: self.field}, bucket=None if self.keys else self.bucket)
        both = as_of(mine, other.df, on, {other.field: name}, bucket=None if on else self.bucket)
        return replace(self, df=both.withColumn(self.field, expr).select(*self.keys, "ts", self.field)).distinct_until_changed()

    @staticmethod
    def record_of(**values: Value) -> Value:
        """A record of live values of the same keys, by name: changes when any of them does."""
        first = next(iter(values.values()))
        points = reduce(lambda a, b: a.unionByName(b), [v.df.select(*first.keys, "ts") for v in values.values()]).distinct()
        for name, v in values.items():
            points = as_of(points, v.df, list(first.keys), {v.field: name}, bucket=None if first.keys else first.bucket)
        out = points.select(*first.keys, "ts", F.struct(*values).alias("value"))
        return Value(out, first.keys, "value", first.bucket).distinct_until_changed()

    def where(self, visible: Column) -> DataFrame:
        """A dictionary's visible entries as a changelog: ``op`` SET when shown or changed, DEL when hidden.

        State keeps running while an entry is hidden: the filter is the last step. An unknown
        predicate hides.
        """
        w = by_time(self.keys)
        vis = F.coalesce(visible, F.lit(False))
        rows = self.df.withColumn("_vis", vis).withColumn("_was", F.coalesce(F.lag("_vis").over(w), F.lit(False)))
        return rows.where("_vis OR _was").withColumn("op", F.when(F.col("_vis"), "SET").otherwise("DEL")).withColumn(
            self.field, F.when(F.col("_vis"), F.col(self.field))).drop("_vis", "_was")

    def values(self) -> DataFrame:
        """The window of live values: each with the span in which it is the key's."""
        return intervals(self.df, self.keys, None if self.keys else self.bucket)

    def index(self, key: Value) -> Value:
        """``d[k]`` of a live key: changes when the key does or its entry; null where there is no entry.

        This is also the fixed access to a member of an association: the target's own history, under the key that holds.
        """
        spans = key.values().select(*key.keys, "ts", F.col(key.field).alias("_key"), F.col("valid_to").alias("_to"))
        out = overlapping(spans, "_key", self.df, self.keys[0], {self.field: "value"})
        return Value(out.select(*key.keys, "ts", "value"), key.keys, "value", key.bucket).distinct_until_changed()

    def count(self, visible: Column | None = None) -> Value:
        """``dict.count()``: how many entries there are, or are visible, live."""
        vis = F.lit(True) if visible is None else F.coalesce(visible, F.lit(False))
        turns = self.df.withColumn("_v", vis.cast("int")).withColumn("_d", F.col("_v") - F.coalesce(F.lag("_v").over(by_time(self.keys)), F.lit(0)))
        return _summed(turns.where("_d <> 0").select("ts", "_d"), (), "value", self.bucket)

    def updates(self) -> Stream:
        """All settings as a stream of ``value``, also those that leave it as it was."""
        rows = (self.df if self.raw is None else self.raw).select(*self.keys, "ts", F.col(self.field).alias("value"))
        return Stream(rows.withColumn("seq", F.lit(0).cast("long")), self.keys, self.bucket)

    def at(self, *key) -> Value:
        """``d[k]``"""
        df = self.df
        for k, v in zip(self.keys, key):
            df = df.where(F.col(k) == v)
        return Value(df.drop(*self.keys), (), self.field, self.bucket)

    def changes(self) -> Stream:
        """The changes as a stream of ``value``."""
        return Stream(self.df.withColumn("seq", F.lit(0).cast("long")), self.keys, self.bucket)

    def snapshot(self, now: int | None = None) -> DataFrame:
        """What holds at an instant, or at the end."""
        df = self.df if now is None else self.df.where(F.col("ts") <= now)
        return df.groupBy(*self.keys).agg(F.max_by(self.field, "ts").alias(self.field))

    def lagged(self, by: int) -> Value:
        """The value a fixed time ago."""
        return replace(self, df=self.df.withColumn("ts", F.col("ts") + by))

    def window(self, length: int) -> ValueWindow:
        return ValueWindow(self, length)

    def how_long(self, cond: Column, end: Column | int) -> DataFrame:
        """Total time for which a condition of the value has held, until ``end``, per key."""
        spans = self.values().withColumn("_to", F.least(F.coalesce("valid_to", F.lit(end) if isinstance(end, int) else end), F.lit(end) if isinstance(end, int) else end))
        held = F.when(F.coalesce(cond, F.lit(False)), F.greatest(F.col("_to") - F.col("valid_from"), F.lit(0))).otherwise(0)
        return spans.groupBy(*self.keys).agg(F.sum(held).cast("long").alias("how_long"))

    def reaches(self, cond: Column, length: int, end: int) -> DataFrame:
        """When the total time for which a condition has held comes to ``length``, per key."""
        spans = self.values().where(F.coalesce(cond, F.lit(False))).withColumn("_n", F.least(F.coalesce("valid_to", F.lit(end)), F.lit(end)) - F.col("valid_from"))
        w = by_time(self.keys).rowsBetween(Window.unboundedPreceding, 0)
        sums = spans.withColumn("_upto", F.sum("_n").over(w)).where((F.col("_upto") >= length) & (F.col("_upto") - F.col("_n") < length))
        return sums.select(*self.keys, (F.col("valid_from") + length - (F.col("_upto") - F.col("_n"))).alias("ts"))

    def longest(self, cond: Column, end: int) -> DataFrame:
        """The longest unbroken time for which a condition has held, per key: gaps and islands."""
        spans = self.values().withColumn("_c", F.coalesce(cond, F.lit(False)))
        w = by_time(self.keys)
        marked = spans.withColumn("_turn", (F.col("_c") != F.coalesce(F.lag("_c").over(w), ~F.col("_c"))).cast("int"))
        marked = marked.withColumn("_i", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_c")
        own = marked.groupBy(*self.keys, "_i").agg((F.max(F.least(F.coalesce("valid_to", F.lit(end)), F.lit(end))) - F.min("valid_from")).alias("_n"))
        return own.groupBy(*self.keys).agg(F.max("_n").alias("longest"))

    def sort_by(self, *order: Column, k: int | None = None) -> DataFrame:
        """The live values in order; with ``k`` the first of them (a top-k, which never sorts all)."""
        out = self.snapshot().orderBy(*order)
        return out.limit(k) if k else out


@dataclass(frozen=True)
class ValueWindow:
    """The values that held at some time in ``(now - length, now]``: one leaves ``length`` after it was replaced."""

    value: Value
    length: int

    def spans(self) -> DataFrame:
        return self.value.values().withColumn("valid_to", F.col("valid_to") + self.length)

    def added(self) -> Stream:
        """A value comes in when it is set."""
        return Stream(self.value.df.withColumn("seq", F.lit(0).cast("long")), self.value.keys, self.value.bucket)

    def expired(self) -> Stream:
        """It leaves ``length`` after it was replaced."""
        gone = self.spans().where("valid_to IS NOT NULL").withColumn("ts", F.col("valid_to")).drop("valid_from", "valid_to")
        return Stream(gone.withColumn("seq", F.lit(0).cast("long")), self.value.keys, self.value.bucket)

    def uda(self, added: Column, expired: Column, initial: float = 0) -> Value:
        """A user's aggregate that adds up: what a value brings when it comes and when it leaves."""
        v = self.value
        moves = self.added().df.select(*v.keys, "ts", added.alias("_d")).unionByName(self.expired().df.select(*v.keys, "ts", expired.alias("_d")))
        return _summed(moves, v.keys, v.field, v.bucket, initial)

    def sum(self) -> Value:
        return self.uda(F.col(self.value.field), -F.col(self.value.field))

    def count(self) -> Value:
        return self.uda(F.lit(1), F.lit(-1))

    def agg(self, kind: str, c: Column | None = None, other: Value | None = None, name: str = "other") -> Value:
        """Any aggregate, at each point where the window or ``other`` changes; ``c`` may use both."""
        initial = F.lit({"any": False, "all": True}[kind]) if kind in ("any", "all") else None
        if other is None and self.value.keys and kind in _JOINED:
            return self._framed(kind, F.col(self.value.field) if c is None else c, initial)
        v, s = self.value, self.spans()
        points = s.select(*v.keys, F.col("valid_from").alias("ts")).unionByName(s.where("valid_to IS NOT NULL").select(*v.keys, F.col("valid_to").alias("ts")))
        if other is not None:
            points = points.unionByName(other.df.select(*v.keys, "ts"))
        points = points.distinct()
        if other is not None:
            points = as_of(points, other.df, list(v.keys), {other.field: name}, bucket=None if v.keys else v.bucket)
        both = interval_join(points, s.drop("ts"), list(v.keys), max(self.length, 1))
        c = c if c is not None else F.col(v.field)
        if kind == "avg":
            total = F.sum(c)
            made = F.when(F.count(c) > 0, total.cast("long") - F.try_mod(total, F.count(c)).cast("long")).otherwise(None) / F.count(c)
            out = both.groupBy(*v.keys, "ts").agg(made.cast("long").alias(v.field))
        else:
            out = both.groupBy(*v.keys, "ts").agg(AGGREGATES[kind](c).alias(v.field))
        return replace(v, df=out).distinct_until_changed(initial)

    def _framed(self, kind: str, c: Column, initial: Column | None) -> Value:
        """Without a join: the values set in the window are a range frame, and the one that held at its far end is the last before it."""
        v, whole = self.value, self.value.df.select(c.alias("x")).dtypes[0][1] in ("int", "bigint", "smallint", "tinyint")
        rows = v.df.select(*v.keys, "ts", F.struct(c.alias("x")).alias("_x"))
        probes = self.spans().where("valid_to IS NOT NULL").select(*v.keys, F.col("valid_to").alias("ts"), F.lit(None).cast(rows.schema["_x"].dataType).alias("_x"))
        w = by_time(v.keys)
        near, far = w.rangeBetween(-(self.length - 1), 0), w.rangeBetween(Window.unboundedPreceding, -self.length)
        x = F.col("_x")["x"]
        held = F.last("_x", ignorenulls=True).over(far)
        seen = rows.unionByName(probes).withColumn("_held", held).withColumn("_h", F.col("_held")["x"])
        out = seen.withColumn(v.field, _JOINED[kind](x, near, F.col("_h"), whole)).select(*v.keys, "ts", v.field).dropDuplicates([*v.keys, "ts"])
        return replace(v, df=out).distinct_until_changed(initial)


def _mean(x: Column, w, h: Column, whole: bool) -> Column:
    s = F.coalesce(F.sum(x).over(w), F.lit(0)) + F.coalesce(h, F.lit(0))
    n = F.count(x).over(w) + h.isNotNull().cast("int")
    return F.when(n > 0, ((s - s % n) / n).cast("long") if whole else s / n)


#: An aggregate of the values in a frame and the one that held before it.
_JOINED: dict[str, Callable] = {
    "max": lambda x, w, h, _: F.greatest(F.max(x).over(w), h),
    "min": lambda x, w, h, _: F.least(F.min(x).over(w), h),
    "any": lambda x, w, h, _: F.coalesce(F.bool_or(x).over(w), F.lit(False)) | F.coalesce(h, F.lit(False)),
    "all": lambda x, w, h, _: F.coalesce(F.bool_and(x).over(w), F.lit(True)) & F.coalesce(h, F.lit(True)),
    "avg": _mean,
}
