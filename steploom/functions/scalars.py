"""Scalar semantics of the continuous-query language, as Column builders.

Null means "not known yet". It differs from SQL's null in logic, in conditionals and in string
concatenation; elsewhere Spark's own operators already agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Any = Column | str | int | float | bool


def col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def logical_and(a: Column, b: Column) -> Column:
    """null and null is null; null and b is false."""
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False)))


def logical_or(a: Column, b: Column) -> Column:
    """null or null is null; null or b is b."""
    return F.when(a.isNull() & b.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))


def negate(a: Column) -> Column:
    return ~a


def if_then_else(c: Column, a: Any, b: Any) -> Column:
    """A null condition gives null, not the else branch."""
    return F.when(c.isNull(), None).when(c, col(a)).otherwise(col(b))


def plus_text(a: Any, b: Any) -> Column:
    """``+`` with a string on either side; null prints as (null)."""
    show = lambda x: F.coalesce(col(x).cast("string"), F.lit("(null)"))
    return F.concat(show(a), show(b))


def divide(a: Column, b: Column) -> Column:
    """Integers: toward zero, null for a zero divisor."""
    return F.when(b == 0, None).otherwise((a - a % b) / b).cast("long")


def remainder(a: Column, b: Column) -> Column:
    """Keeps the sign of the dividend; null for a zero divisor."""
    return F.try_mod(a, b)


def is_null(a: Column) -> Column:
    return a.isNull()


def first_known(*xs: Any) -> Column:
    return F.coalesce(*[col(x) for x in xs])


def at(window: Column, i: int) -> Column:
    """``w[i]`` of an array: from the front from 0, from the end below 0, null outside."""
    return F.try_element_at(window, F.lit(i + 1 if i >= 0 else i))


def seconds(n: float, unit: str = "sec") -> int:
    """A length of time in seconds; units as in ``[3 sec]``, ``[5 min]``."""
    return int(n * {"sec": 1, "min": 60, "hour": 3600, "day": 86400}[unit.rstrip("s") if unit != "s" else "sec"])


def record(**fields: Any) -> Column:
    return F.struct(*[col(v).alias(k) for k, v in fields.items()])


def updated(r: Column, **fields: Any) -> Column:
    """``{ r with a = ... }``"""
    for k, v in fields.items():
        r = r.withField(k, col(v))
    return r


def tuple_of(*xs: Any) -> Column:
    return F.struct(*[col(x).alias(f"_{i + 1}") for i, x in enumerate(xs)])


def now() -> Column:
    """The instant of evaluation: an event's or a change's own time."""
    return F.col("ts")


def distance(lat1: Any, lon1: Any, lat2: Any, lon2: Any, radius: float = 6371.0) -> Column:
    """The way along a great circle between two points in degrees, in units of ``radius`` (kilometres on Earth)."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.sin((c - a) / 2) ** 2 + F.cos(a) * F.cos(c) * F.sin((d - b) / 2) ** 2
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def comprehension(source, where: Column | None = None, by: str | None = None, **fields: Column):
    """``[fields for x in source if where]`` of a stream or a window, and with ``by`` its groups."""
    out = source if where is None else source.where(where)
    out = out.select(**fields) if fields else out
    return out if by is None else out.groupby(by)
