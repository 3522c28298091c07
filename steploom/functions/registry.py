"""Functions of the language: named, curried, higher-order; they expand when a plan is built."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIMITIVES: dict[str, Callable] = {}


def define(f: Callable) -> Callable:
    """Register a function under its name; it may be called with fewer arguments and then waits for the rest."""
    n = len(inspect.signature(f).parameters)

    def call(*args):
        if len(args) >= n:
            out = f(*args[:n])
            return out(*args[n:]) if len(args) > n else out
        return lambda *more: call(*args, *more)

    call.__name__ = f.__name__
    PRIMITIVES[f.__name__] = call
    return call


def recursive(spark: SparkSession, first: str, step: str, until: str, columns: str) -> DataFrame:
    """A recursive definition as a recursive CTE: rows of ``first``, then ``step`` over ``r`` while ``until`` fails."""
    return spark.sql(f"WITH RECURSIVE r({columns}) AS ({first} UNION ALL SELECT {step} FROM r WHERE NOT ({until})) SELECT * FROM r")


def choose(selector: Column, functions: dict[object, Callable], default: Callable | None = None) -> Callable:
    """A function chosen at run time: for each row the one whose name ``selector`` holds; null where none is.

    With a live dictionary's value as the selector this is a dictionary of functions. Each function is
    a branch of one expression, so only the chosen one is evaluated.
    """
    def call(*args):
        out = None
        for name, f in functions.items():
            out = F.when(selector == F.lit(name), f(*args)) if out is None else out.when(selector == F.lit(name), f(*args))
        return out if default is None else out.otherwise(default(*args))

    return call
