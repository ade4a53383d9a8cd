"""Long histories in slices of time: windows with halos, carried values, and scans in two levels.

An instrument's rows are dealt to slices, so that one instrument fills all tasks. Three forms:

``over_slices`` runs any builder of windows on slices of so many rows, each with the
rows before (and behind) it that its frames reach: a builder that partitions by ``pair`` gets
a pair of (pair, slice), so nothing in it changes. Slices follow counts of rows by day.

``carried`` takes the last known value before a row: inside the row's own day by a window
over (pair, day), else from a table with one row for each day, whose last values are passed on.

``scan`` makes running results: totals of each day, their prefix over the days of an instrument (one row
for each day), then the day's own window, which starts from that prefix.

Windows that do not partition by day run on one row for each instrument and day. Null times
are a day of their own, before the others. Rows of equal times are in the order that the window gives
them: callers whose rows tie need a further column of order. Empty frames give empty frames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a slice has, about: small enough to be sorted in memory, and many times the usual halo.
SLICE_ROWS = 200_000
UNIT = "day"


def _key(unit: str) -> Column:
    """(pair, day) in one column: nulls inside a struct are equal, so that rows without an instrument or a time are a key, too."""
    return F.struct("pair", F.date_trunc(unit, F.col("ts")).alias("day"))


def in_slices(frame: DataFrame, before: int, behind: int = 0, rows: int | None = None, unit: str = UNIT, counted: DataFrame | None = None) -> DataFrame:
    """``frame`` with ``_slice`` and ``_of_slice``: each row once as its slice's own, and again in the slices whose halo it is in.

    A slice has the days whose first row is numbered in [k rows, (k + 1) rows) in its instrument; its halo is
    whole days, with the ``before`` rows before its first row and the ``behind`` rows after its last one.
    ``counted`` has the same rows by pair and ts, where they are cheaper to count than those of ``frame``.
    """
    rows = rows or SLICE_ROWS
    days = (frame if counted is None else counted).groupBy(_key(unit).alias("_key")).agg(F.count("*").alias("_n"))
    of_pair = Window.partitionBy("_key.pair")
    path = of_pair.orderBy("_key.day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumns({"_end": F.sum("_n").over(path), "_days": F.ceil(F.max("_n").over(of_pair) / rows)})
    days = days.withColumn("_start", F.col("_end") - F.col("_n")).withColumn("_slice", F.floor(F.col("_start") / rows).cast("int"))
    to = F.struct(F.col("_key.pair").alias("pair"), F.col("_slice").alias("slice"))
    slices = days.groupBy(to.alias("_to")).agg(F.min("_start").alias("_first"), F.max("_end").alias("_last"))
    # a slice's first row is numbered k rows or later, its last one before (k + 1) rows and one day more
    reach = F.greatest(F.lit(0), F.floor((F.col("_start") - behind) / rows) - F.col("_days"))
    asked = days.select("*", F.explode(F.sequence(reach, F.floor((F.col("_end") + before) / rows))).alias("_asks"))
    asked = asked.withColumn("_asks", F.col("_asks").cast("int")).withColumn("_to", F.struct(F.col("_key.pair").alias("pair"), F.col("_asks").alias("slice")))
    needed = (F.col("_end") > F.col("_first") - before) & (F.col("_start") < F.col("_last") + behind)
    own = F.col("_asks") == F.col("_slice")
    dealt = asked.join(slices, "_to").where(own | needed).select("_key", F.col("_asks").alias("_slice"), own.alias("_of_slice"))
    return frame.withColumn("_key", _key(unit)).join(dealt, "_key").drop("_key")


def over_slices(frame: DataFrame, build: Callable[[DataFrame], DataFrame], before: int, behind: int = 0, rows: int | None = None, unit: str = UNIT, counted: DataFrame | None = None) -> DataFrame:
    """``build`` of ``frame``, slice by slice: equal to ``build(frame)`` if its frames reach ``before`` and ``behind`` rows at most."""
    dealt = in_slices(frame, before, behind, rows, unit, counted).withColumn("pair", F.struct("pair", "_slice"))
    built = build(dealt).where("_of_slice").withColumn("pair", F.col("pair.pair"))
    return built.drop("_slice", "_of_slice")


def _order(order: list) -> Column:
    return F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])


def _held(frame: DataFrame, values: dict[str, Column], unit: str) -> DataFrame:
    return frame.withColumns({"_key": _key(unit), **{f"_v_{n}": v for n, v in values.items()}})


def _before(days: DataFrame, columns: dict[str, Callable]) -> DataFrame:
    """(_key, _before_name): what each function makes of its name over the days before of the same instrument."""
    path = Window.partitionBy("_key.pair").orderBy("_key.day").rowsBetween(Window.unboundedPreceding, -1)
    return days.select("_key", *[how(n).over(path).alias(f"_before_{n}") for n, how in columns.items()])


def _last(name: str) -> Column:
    return F.last(name, ignorenulls=True)


def carried(frame: DataFrame, values: dict[str, Column], order: list, unit: str = UNIT) -> DataFrame:
    """``frame`` with the last value, nulls apart, of each column up to and with the row, in ``order`` (times first) in its instrument."""
    held = _held(frame, values, unit)
    lasts = held.groupBy("_key").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), _order(order))).alias(n) for n in values])
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.withColumns({n: _last(f"_v_{n}").over(inside) for n in values})
    out = out.join(_before(lasts, dict.fromkeys(values, _last)), "_key", "left")
    return out.select(*frame.columns, *[F.coalesce(n, f"_before_{n}").alias(n) for n in values])


@dataclass(frozen=True)
class Running:
    """A running result of a column: ``sum``, ``max``, ``min`` or ``count`` of its values up to and with the row."""

    value: Column
    how: str = "sum"


_FUNCTIONS = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
_OF_DAYS = _FUNCTIONS | {"count": F.sum}
_TOGETHER = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "max": F.greatest, "min": F.least}


def scan(frame: DataFrame, columns: dict[str, Running], order: list | None = None, unit: str = UNIT) -> DataFrame:
    """``frame`` with each running result over its instrument's rows in ``order``."""
    held = _held(frame, {n: r.value for n, r in columns.items()}, unit)
    totals = held.groupBy("_key").agg(*[_FUNCTIONS[r.how](f"_v_{n}").alias(n) for n, r in columns.items()])
    inside = Window.partitionBy("_key").orderBy(*(order or ["ts"])).rowsBetween(Window.unboundedPreceding, 0)
    out = held.withColumns({n: _FUNCTIONS[r.how](f"_v_{n}").over(inside) for n, r in columns.items()})
    out = out.join(_before(totals, {n: _OF_DAYS[r.how] for n, r in columns.items()}), "_key", "left")
    return out.select(*frame.columns, *[_TOGETHER[r.how](F.col(f"_before_{n}"), F.col(n)).alias(n) for n, r in columns.items()])


def previous(frame: DataFrame, values: dict[str, Column], order: list | None = None, unit: str = UNIT) -> DataFrame:
    """``frame`` with each value of the row before in its instrument (a null stays one), null at the first row."""
    order = order or ["ts"]
    # structs, so that a day's last value that is null is not taken for none
    held = _held(frame, {n: F.struct(v.alias("v")) for n, v in values.items()}, unit)
    lasts = held.groupBy("_key").agg(*[F.max_by(f"_v_{n}", _order(order)).alias(n) for n in values])
    inside = Window.partitionBy("_key").orderBy(*order)
    out = held.withColumns({n: F.lag(f"_v_{n}").over(inside) for n in values})
    out = out.join(_before(lasts, dict.fromkeys(values, _last)), "_key", "left")
    return out.select(*frame.columns, *[F.coalesce(n, f"_before_{n}")["v"].alias(n) for n in values])
