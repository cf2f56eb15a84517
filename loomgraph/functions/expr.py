"""Small helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often and in whatever lambda the body uses it."""
    return F.transform(F.array(value), body)[0]


def no_items(kind: str) -> Column:
    """An empty array of element type ``kind``."""
    return F.array().cast(f"array<{kind}>")


def positions(n: Column) -> Column:
    """Array 0 .. n-1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(no_items("int"))


def total(values: Column, kind: str = "long") -> Column:
    """Sum of an array; 0 if empty."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)
