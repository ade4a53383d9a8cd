"""Trailing row frames of one instrument, full or undefined."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ["pair"]

def ordered() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("ts")


def trailing(n: int) -> WindowSpec:
    """The row and the n - 1 before it."""
    return ordered().rowsBetween(1 - n, 0)


def prior(n: int) -> WindowSpec:
    """The n rows before the row."""
    return ordered().rowsBetween(-n, -1)


def full(value: Column, x: Column, n: int, frame: WindowSpec) -> Column:
    """``value`` where the frame has n defined x."""
    return F.when(F.count(x).over(frame) == n, value)


def ratio(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def prev(x, k: int = 1) -> Column:
    return F.lag(x, k).over(ordered())


def following(x, k: int = 1) -> Column:
    return F.lead(x, k).over(ordered())


def bar_number() -> Column:
    return F.row_number().over(ordered())
