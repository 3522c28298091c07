"""Tagged unions and pattern matching as struct columns and conditional chains."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col


class Enum:
    """``Enum(Gain="double", Flat=None)``: labels with the type of their payload, or none.

    A value is a struct of ``tag`` and one nullable field for each label with a payload; equality
    is the struct's. Constructors are attributes: ``e.Gain(c)``.
    """

    def __init__(self, **labels: str | None):
        self.labels = labels

    def __getattr__(self, label: str) -> Callable[..., Column]:
        if label.startswith("_") or label not in self.labels:
            raise AttributeError(label)
        return lambda payload=None: F.struct(F.lit(label).alias("tag"), *[
            (col(payload) if k == label and payload is not None else F.lit(None)).cast(t).alias(k) for k, t in self.labels.items() if t])


@dataclass
class Pattern:
    """What a value must be (``test``) and what is bound if it is (``names``)."""

    test: Column
    names: dict[str, Column] = field(default_factory=dict)


Matcher = Callable[[Column], Pattern]


def anything(c: Column) -> Pattern:
    return Pattern(F.lit(True))


def bind(name: str) -> Matcher:
    return lambda c: Pattern(F.lit(True), {name: c})


def literal(v) -> Matcher:
    return lambda c: Pattern(F.coalesce(c == F.lit(v), F.lit(False)))


def variant(label: str, inner: Matcher = anything) -> Matcher:
    def m(c: Column) -> Pattern:
        p = inner(c[label]) if inner is not anything else anything(c)
        return Pattern(F.coalesce(c["tag"] == label, F.lit(False)) & p.test, p.names)
    return m


def fields(**inner: Matcher) -> Matcher:
    """A record, or with ``_1=``, ``_2=`` a tuple."""
    def m(c: Column) -> Pattern:
        ps = [f(c[k]) for k, f in inner.items()]
        test, names = F.lit(True), {}
        for p in ps:
            test, names = test & p.test, names | p.names
        return Pattern(test, names)
    return m


def match(c: Column, *cases: tuple, default: Column | None = None) -> Column:
    """Cases are (matcher, body) or (matcher, guard, body); guard and body take the bound names. First match wins."""
    out = None
    for matcher, *rest in cases:
        p = matcher(c)
        guard, body = rest if len(rest) == 2 else (None, rest[0])
        test = p.test & F.coalesce(guard(**p.names), F.lit(False)) if guard else p.test
        value = col(body(**p.names)) if callable(body) else col(body)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(default if default is not None else F.raise_error(F.lit("no case matches")))
