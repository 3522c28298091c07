"""Entities: objects keyed by a field of a stream, with associations and derived members.

An entity is a keyed change table of its attributes; an association is a temporal join, so a
member's history is its own and follows both the key and the target.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stream import Stream, Value
from .timeline import by_time, changed, overlapping, prefix


@dataclass(frozen=True)
class Entity:
    name: str
    id: str
    events: Stream
    #: ``(id, ts, attributes and members)``, a row a change.
    table: DataFrame
    members: tuple[str, ...] = field(default=())

    @staticmethod
    def create_from(name: str, stream: Stream | list[Stream], id: str) -> Entity:
        """Attributes are the last known values of the fields of a stream, or of several; ``events`` is the entity's own stream."""
        if isinstance(stream, list):
            frames = [s.df.withColumn("seq", F.struct(F.lit(i).alias("i"), F.col("seq").cast("long").alias("seq"))) for i, s in enumerate(stream)]
            stream = Stream(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), (), stream[0].bucket)
        s = stream.groupby(id)
        fields = [c for c in s.df.columns if c not in ("ts", "seq", id)]
        rec = s.last_event(*fields).df
        return Entity(name, id, s, rec.select(id, "ts", *[F.col("value")[f].alias(f) for f in fields]), tuple(fields))

    def on_new(self) -> Stream:
        """The births of objects: each id at its first instant."""
        return Stream(self.table.groupBy(self.id).agg(F.min("ts").alias("ts")).withColumn("seq", F.lit(0).cast("long")), (self.id,))

    def pulse(self, field: str) -> Stream:
        """A field that holds only at the instant of its event: the events that know it."""
        return replace(self.events, df=self.events.df.where(F.col(field).isNotNull()).select(*self.events.keys, "ts", "seq", field))

    def on_change(self, action: Callable[[DataFrame, int], None], checkpoint: str):
        """A method with side effects: ``action`` on each micro-batch of the object's changes, where the table streams."""
        return self.table.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).start()

    def attribute(self, f: str) -> Value:
        """One attribute of all objects, as a dictionary."""
        return Value(self.table.select(self.id, "ts", F.col(f).alias("value")), (self.id,)).distinct_until_changed()

    def all(self, now: int | None = None) -> DataFrame:
        """The objects as they are at an instant."""
        df = self.table if now is None else self.table.where(F.col("ts") <= now)
        return df.groupBy(self.id).agg(F.max_by(F.struct(*self.members), "ts").alias("_r")).select(self.id, "_r.*")

    def member(self, name: str, value: Value | Column, default: object = None) -> Entity:
        """A derived attribute: an expression of the others, or a value keyed by the entity's id (``default`` until it is known)."""
        if isinstance(value, Value):
            # Both changelogs in one pass by id: each row sees the last of either, its own instant included.
            told = F.struct(F.lit(True).alias("_known"), *self.members)
            mine = self.table.select(self.id, "ts", told.alias("_m"))
            new = value.df.select(F.col(value.keys[0]).alias(self.id), "ts", F.struct(F.col(value.field).alias("_x")).alias("_v"))
            w = by_time([self.id]).rangeBetween(Window.unboundedPreceding, 0)
            seen = mine.unionByName(new, allowMissingColumns=True).select(
                self.id, "ts", F.last("_m", ignorenulls=True).over(w).alias("_m"), F.last("_v", ignorenulls=True).over(w).alias("_v"))
            x = F.col("_v._x") if default is None else F.coalesce("_v._x", F.lit(default))
            table = seen.where("_m IS NOT NULL").dropDuplicates([self.id, "ts"]).select(self.id, "ts", *[F.col("_m")[m].alias(m) for m in self.members], x.alias(name))
        else:
            table = self.table.withColumn(name, value)
        return Entity(self.name, self.id, self.events, changed(table, [self.id], [*self.members, name]), (*self.members, name))

    def belongs_to(self, other: Entity, fields: dict[str, str], fk: str | None = None) -> Entity:
        """N:1 by ``<other>_id``: the target's fields, live. Changes when the key or the target does.

        An object's spans meet the versions of their target in one join on the key. The target may be
        declared later than this entity: only its table is asked for, when this is called.
        """
        fk = fk or f"{other.name.lower()}_id"
        spans = self.table.withColumn("_to", F.lead("ts").over(by_time([self.id])))
        seen = overlapping(spans, fk, other.table, other.id, fields)
        names = (*self.members, *fields.values())
        return Entity(self.name, self.id, self.events, changed(seen, [self.id], names), names)

    def has_many(self, child: Entity, name: str, fk: str | None = None) -> Entity:
        """1:N: how many children hold this entity's id, live (their ids are ``children``)."""
        return self.member(name, child_counts(self, child, fk), 0)

    def children(self, child: Entity, now: int | None = None, fk: str | None = None) -> DataFrame:
        fk = fk or f"{self.name.lower()}_id"
        return child.all(now).groupBy(fk).agg(F.sort_array(F.collect_set(child.id)).alias("children"))


def child_counts(parent: Entity, child: Entity, fk: str | None = None, where: Column | None = None, few: bool = False) -> Value:
    """A keyed count: +1 where a child's key becomes the parent's, -1 where it ceases to be."""
    return child_sum(parent, child, F.lit(1), fk, where, few)


def child_sum(parent: Entity, child: Entity, expr: Column, fk: str | None = None, where: Column | None = None, few: bool = False) -> Value:
    """The live sum of an expression over an entity's children, of those for which ``where`` holds.

    A correlated sub-select with an aggregate: what a child adds moves with its key, its members and
    the condition. With ``few`` parents, of many changes each, these are run by bucket of time.
    """
    moves, bucket = child_moves(parent, child, expr, fk, where), child.events.bucket
    at = moves.groupBy(parent.id, "ts").agg(F.sum("_d").alias("_d"))
    if few:
        out = prefix(at, ["ts"], {"value": ("sum", F.col("_d"))}, bucket, (parent.id,)).drop("_d")
    else:
        out = at.withColumn("value", F.sum("_d").over(by_time([parent.id]).rowsBetween(Window.unboundedPreceding, 0))).drop("_d")
    return Value(changed(out, [parent.id], ["value"], None, bucket if few else None), (parent.id,), "value", bucket, out)


def child_moves(parent: Entity, child: Entity, expr: Column, fk: str | None = None, where: Column | None = None) -> DataFrame:
    """What ``child_sum`` sums: ``_d``, which a child brings its parent (+) or takes from it (-) at an instant."""
    fk = fk or f"{parent.name.lower()}_id"
    x = F.coalesce(expr, F.lit(0)) if where is None else F.when(where, expr).otherwise(F.lit(0))
    now = child.table.select(child.id, "ts", F.col(fk).alias("_fk"), x.alias("_x"))
    rows = now.withColumn("_was", F.lag(F.struct("_fk", "_x")).over(by_time([child.id])))
    rows = rows.where(F.col("_was").isNull() | ~F.struct("_fk", "_x").eqNullSafe(F.col("_was")))
    return rows.where("_fk IS NOT NULL").select(F.col("_fk").alias(parent.id), "ts", F.col("_x").alias("_d")).unionByName(
        rows.where("_was._fk IS NOT NULL").select(F.col("_was._fk").alias(parent.id), "ts", (-F.col("_was._x")).alias("_d")))


def memberships(parent: Entity, child: Entity, fk: str | None = None) -> DataFrame:
    """``hasMany`` itself, live: ``(parent's id, child's id, valid_from, valid_to)``, a row for each time that a child was the parent's."""
    fk = fk or f"{parent.name.lower()}_id"
    spans = child.attribute(fk).values().where("value IS NOT NULL")
    return spans.select(F.col("value").alias(parent.id), child.id, "valid_from", "valid_to")
