"""Recurrences: values that depend on the value before. One grouped Arrow pass computes a whole family.

Windows of many rows are folds, too, where a sliding structure beats a frame that is read
again for every row. The group is a piece of an instrument's time (or instrument's and configuration's),
with as many rows before it as it takes for the start to be forgotten: a smoother of
weight a keeps (1 - a)^n of what it was n rows ago, which is below a double's last bit
after 40 / a rows. Pieces come from counts of rows for each year; a short history is
one piece, and its values are those of one pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows that a piece should have at least.
PIECE_ROWS = 100_000


def piece_starts(frame: DataFrame, keys: tuple[str, ...], lookback: int, rows: int | None = None) -> DataFrame:
    """(keys, _year, _pieces): for each year with rows, the pieces that need it, its own first.

    Years follow one another into a piece until it has ``rows`` rows; a piece needs the
    years before it that hold the last ``lookback`` rows. A few rows for each group.
    """
    rows = PIECE_ROWS if rows is None else rows
    years = frame.groupBy(*keys, F.year("ts").alias("_year")).agg(F.count("*").alias("_n"))
    path = Window.partitionBy(*keys).orderBy("_year")
    years = years.withColumn("_before", F.sum("_n").over(path.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    years = years.withColumn("_piece", F.floor(F.col("_before") / rows).cast("int"))
    first = F.min("_before").over(Window.partitionBy(*keys, "_piece"))
    years = years.withColumn("_need", first - lookback)
    each = years.groupBy(*keys, "_piece").agg(F.min("_need").alias("_need"), F.min("_before").alias("_start"))
    held = F.collect_list(F.struct("_piece", "_need", "_start")).over(Window.partitionBy(*keys))
    each = each.select(*keys, held.alias("_all")).dropDuplicates(list(keys))
    ends = F.col("_before") + F.col("_n")
    wanted = years.join(each, list(keys))
    later = F.filter("_all", lambda p: (p["_start"] > F.col("_before")) & (p["_need"] < ends) & (p["_piece"] != F.col("_piece")))
    return wanted.select(*keys, "_year", F.concat(F.array("_piece"), F.transform(later, lambda p: p["_piece"])).alias("_pieces"))


def in_pieces(frame: DataFrame, keys: tuple[str, ...], lookback: int) -> DataFrame:
    """The rows of each piece and those it looks back on: ``_piece``, and whether the row is its own."""
    starts = piece_starts(frame, keys, lookback)
    dealt = frame.withColumn("_year", F.year("ts")).join(F.broadcast(starts), [*keys, "_year"])
    placed = dealt.select(*frame.columns, F.posexplode("_pieces").alias("_at", "_piece"))
    return placed.select(*frame.columns, "_piece", (F.col("_at") == 0).alias("_own"))


def fold(frame: DataFrame, inputs: list[str], outputs: dict[str, Callable], keys: tuple[str, ...] = ("pair",), lookback: int | None = None) -> DataFrame:
    """``frame`` with one double column for each output, a function of the inputs' arrays in the order of ts.

    With ``lookback`` the arrays are those of a piece of time and of so many rows or
    more before it; without, of all the group's time.
    """
    schema = StructType([*frame.schema.fields, *[StructField(name, DoubleType()) for name in outputs]])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts", kind="stable")
        arrays = [group[c].to_numpy(float) for c in inputs]
        out = group.assign(**{name: how(*arrays) for name, how in outputs.items()})
        return out[schema.names] if lookback is None else out[out["_own"]][schema.names]

    if lookback is None:
        return frame.groupBy(*keys).applyInPandas(run, schema)
    return in_pieces(frame, keys, lookback).groupBy(*keys, "_piece").applyInPandas(run, schema)


def trailing_extreme(x: np.ndarray, window: int, largest: bool) -> np.ndarray:
    """The largest (or smallest) of the ``window`` values before each one; undefined where one of those is, or there are fewer.

    Blocks of one window's length: a window is the end of one block and the start of the
    next, so that it costs two looks whatever its length.
    """
    n, sign = len(x), 1.0 if largest else -1.0
    known = ~np.isnan(x)
    y = np.full(-(-max(n, 1) // window) * window, -np.inf)
    y[:n] = np.where(known, sign * x, -np.inf)
    blocks = y.reshape(-1, window)
    start = np.maximum.accumulate(blocks, axis=1).ravel()
    end = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    out = np.full(n, np.nan)
    if n > window:
        seen = np.concatenate([[0], np.cumsum(known)])
        at = np.arange(window, n)
        found = sign * np.maximum(end[at - window], start[at - 1])
        out[window:] = np.where(seen[at] - seen[at - window] == window, found, np.nan)
    return out


def trailing_quantile(x: np.ndarray, window: int, least: int, share: float) -> np.ndarray:
    """The interpolated quantile of the known ones of the last ``window`` values, where there are ``least``; a sorted structure slides along, at log cost a value."""
    return pd.Series(x).rolling(window, min_periods=least).quantile(share, interpolation="linear").to_numpy()


def first_reach(x: np.ndarray, level: np.ndarray, horizon: int) -> np.ndarray:
    """How many values after each one it is to the first that is its ``level`` or more, among the next ``horizon``; 0 where none is.

    Maxima of 1, 2, 4, ... values from each place on, each from two of the one before; the
    longest stretch below the level is put together from them, the longest first.
    """
    n = len(x)
    tables = [np.concatenate([np.where(np.isnan(x), -np.inf, x), np.full(horizon + 1, -np.inf)])]
    while 2 << (len(tables) - 1) <= horizon:
        last, half = tables[-1], 1 << (len(tables) - 1)
        tables.append(np.maximum(last, np.concatenate([last[half:], np.full(half, -np.inf)])))
    below = np.zeros(n, np.int64)
    place = np.arange(1, n + 1)
    for k in reversed(range(len(tables))):
        free = (below + (1 << k) <= horizon) & (tables[k][np.minimum(place + below, len(tables[k]) - 1)] < level)
        below += free.astype(np.int64) << k
    met = (below < horizon) & (place + below < n)
    return np.where(met, below + 1, 0)


def ema(x: np.ndarray, alpha: float) -> np.ndarray:
    """e0 = x0, e = alpha x + (1 - alpha) e."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def span(n: int) -> float:
    return 2 / (n + 1)


def rma(x: np.ndarray, period: int, start: int) -> np.ndarray:
    """Undefined before start + period - 1, there the mean of the first ``period`` values, then r += (x - r) / period."""
    out = np.full(len(x), np.nan)
    seed = start + period - 1
    if len(x) > seed:
        tail = np.concatenate([[x[start : seed + 1].mean()], x[seed + 1 :]])
        out[seed:] = ema(tail, 1 / period)
    return out


def rsi(close: np.ndarray, period: int) -> np.ndarray:
    if period < 1:
        raise ValueError("a period of one bar at least")
    change = np.diff(close, prepend=np.nan)
    gain, loss = rma(np.maximum(change, 0), period, 1), rma(np.maximum(-change, 0), period, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + gain / loss)
    out = np.where(loss == 0, np.where(gain == 0, 50.0, 100.0), out)
    return np.where(np.isnan(gain), np.nan, out)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int = 14) -> np.ndarray:
    return ema(true_range(high, low, close), 1 / period)


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int = 14) -> dict[str, np.ndarray]:
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    smooth = [rma(x, period, 1) for x in (true_range(high, low, close), plus, minus)]
    with np.errstate(divide="ignore", invalid="ignore"):
        plus_di, minus_di = (100 * s / smooth[0] for s in smooth[1:])
        dx = 100 * np.abs(plus_di - minus_di) / (plus_di + minus_di)
    # a flat bar has no direction: 0, so that the second smoothing goes on
    dx[period:] = np.where(np.isfinite(dx[period:]), dx[period:], 0.0)
    return {"plus_di": plus_di, "minus_di": minus_di, "adx": rma(dx, period, period), "di_spread": plus_di - minus_di}
