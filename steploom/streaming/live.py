"""The same operators on unbounded input, with Structured Streaming.

Stateless operators are the batch ones: ``where`` and ``select`` of a Stream over ``readStream``
run as they are. Stateful ones keep their state per key, by event time, and answer when the
watermark has passed an instant, in order of time: rows of one instant count as one whatever their
batch, and the changes are those of the batch operators. State that no window, value or retention
needs any more is removed.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that the stateful operators ask for.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Timed(StatefulProcessor):
    """Rows wait in the state until the watermark passes their instant; ``at`` then sees all of one instant, in order of time."""

    def __init__(self, retention_ms: int | None = None):
        self.retention = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows binary")
        self.kept = handle.getValueState("kept", "state binary, until long")

    def _wait(self, at: int, row: tuple) -> None:
        old = pickle.loads(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
        self.waiting.updateValue((at,), (pickle.dumps([*old, row]),))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.arrived(int(r["ts"].timestamp() * 1000), r)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        state, until = (pickle.loads(x[0]), x[1]) if self.kept.exists() and (x := self.kept.get()) else (self.initial(), 0)
        if not self.waiting.containsKey((at,)):
            if self.retention is not None and until and at >= until:
                self.kept.clear()
            return
        rows = pickle.loads(self.waiting.getValue((at,))[0])
        self.waiting.removeKey((at,))
        state, out = self.at(at, state, rows)
        if state is None:
            self.kept.clear()
        else:
            until = at + self.retention if self.retention is not None else 0
            self.kept.update((pickle.dumps(state), until))
            if until:
                self.handle.registerTimer(until)
        for x in out:
            yield Row(key=str(key[0]), ts_ms=at, **x)

    def arrived(self, at: int, row: Row) -> None:
        """Put what a row means at its instants into the state."""
        raise NotImplementedError

    def initial(self):
        """The state of a key that has none."""
        return None

    def at(self, at: int, state, rows: list[tuple]) -> tuple[object, list[dict]]:
        """The new state (None: none) and the changes of one instant."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class SlidingWindow(Timed):
    """Aggregates over a sliding window, with the changes that expiry brings.

    The state counts how often each value is held, so that sums are exact and least and greatest survive an expiry.
    """

    def __init__(self, length_ms: int, kind: str):
        super().__init__()
        self.length, self.kind = length_ms, kind

    def arrived(self, at: int, row: Row) -> None:
        if row["value"] is not None:
            self._wait(at, (row["value"], 1))
            self._wait(at + self.length, (row["value"], -1))

    def at(self, at: int, state, rows: list[tuple]):
        held, was = state or ({}, None)
        for value, n in rows:
            held[value] = held.get(value, 0) + n
            if not held[value]:
                del held[value]
        n = sum(held.values())
        total = sum(v * c for v, c in held.items())
        now = {"sum": total, "count": n, "min": min(held, default=None), "max": max(held, default=None), "avg": total / n if n else None}[self.kind]
        out = [{"value": None if now is None else float(now), "n": n}] if now != was or state is None else []
        return ((held, now) if held else None), out


def sliding(stream: DataFrame, key: str, ts: str, value: str, length_ms: int, kind: str = "sum", lateness: str = "0 seconds") -> DataFrame:
    """``(key, ts_ms, value, n)``: a row whenever an aggregate (sum, count, min, max, avg) of the last ``length_ms`` changes.

    ``n`` is the number of values held. Rows later than the watermark go. An empty window has no
    state; a key that comes back begins anew.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    return rows.withWatermark("ts", lateness).groupBy("key").transformWithState(
        statefulProcessor=SlidingWindow(length_ms, kind), outputStructType="key string, ts_ms long, value double, n long", outputMode="Append", timeMode="EventTime")


def sliding_sum(stream: DataFrame, key: str, ts: str, value: str, length_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """``(key, ts_ms, total, n)``: ``sliding`` of a sum."""
    return sliding(stream, key, ts, value, length_ms, "sum", lateness).withColumnRenamed("value", "total")


class Listener(Timed):
    """A state machine: one change for each instant at which the state differs."""

    def __init__(self, step: Callable, start: object, order: list[str], emit: Callable, retention_ms: int | None):
        super().__init__(retention_ms)
        self.step, self.start, self.order, self.emit = step, start, order, emit

    def arrived(self, at: int, row: Row) -> None:
        event = row.asDict()
        self._wait(at, (tuple(event[c] for c in self.order), event))

    def initial(self):
        return (self.start,)

    def at(self, at: int, state, rows: list[tuple]):
        now = state[0]
        for _, event in sorted(rows, key=lambda r: r[0]):
            now = self.step(now, event)
        return (now,), [self.emit(now)] if now != state[0] else []


def listener(stream: DataFrame, key: str, ts: str, step: Callable[[object, dict], object], initial: object, out: str, emit: Callable[[object], dict],
             order: list[str] | None = None, lateness: str = "0 seconds", retention_ms: int | None = None) -> DataFrame:
    """``(key, ts_ms, out)``: a state machine per key, ``state = step(state, event)`` in order of time and ``order``.

    A row for each instant at which the state changes. With ``retention_ms`` a key that has had no
    event for so long is forgotten and begins anew.
    """
    rows = stream.withColumn("ts", F.col(ts).cast("timestamp")).withColumn("key", F.col(key).cast("string"))
    return rows.withWatermark("ts", lateness).groupBy("key").transformWithState(
        statefulProcessor=Listener(step, initial, order or [], emit, retention_ms), outputStructType=f"key string, ts_ms long, {out}", outputMode="Append", timeMode="EventTime")


class Shown(Timed):
    """A dictionary's visible entries: SET when shown or changed, DEL when hidden."""

    def __init__(self, visible: Callable[[float], bool | None]):
        super().__init__()
        self.visible = visible

    def arrived(self, at: int, row: Row) -> None:
        if row["value"] is not None:
            self._wait(at, (row["value"],))

    def at(self, at: int, state, rows: list[tuple]):
        now, was = rows[-1][0], state
        shown = bool(self.visible(now))
        hidden = was is not None and was[1] and not shown
        out = [{"op": "SET", "value": now}] if shown and (was is None or was != (now, True)) else [{"op": "DEL", "value": None}] if hidden else []
        return (now, shown), out


def shown(stream: DataFrame, key: str, ts: str, value: str, visible: Callable[[float], bool | None], lateness: str = "0 seconds") -> DataFrame:
    """``(key, ts_ms, op, value)``: the changelog of a dictionary of last values filtered by ``visible``; entries keep their state while hidden."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    return rows.withWatermark("ts", lateness).groupBy("key").transformWithState(
        statefulProcessor=Shown(visible), outputStructType="key string, ts_ms long, op string, value double", outputMode="Append", timeMode="EventTime")


def latest(stream: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Per key the last value by event time, in update mode."""
    return stream.groupBy(key).agg(F.max_by(value, ts).alias("value"))
