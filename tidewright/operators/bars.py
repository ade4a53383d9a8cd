"""Time-bucket aggregation onto clock and session grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import calendar

SIDES = ("bid", "ask")
PRICES = ("open", "high", "low", "close")


def _first(price: str) -> Column:
    return F.min_by(price, F.when(F.col(price).isNotNull(), F.col("ts")))


def _last(price: str) -> Column:
    return F.max_by(price, F.when(F.col(price).isNotNull(), F.col("ts")))


def _side_aggregates() -> list[Column]:
    how = {"open": _first, "high": F.max, "low": F.min, "close": _last}
    return [how[p](f"{p}_{s}").alias(f"{p}_{s}") for s in SIDES for p in PRICES]


def with_mids(bars: DataFrame) -> DataFrame:
    """Mids and spread of the sides as they now are; a mid high is not the highest mid."""
    mids = {f"mid_{p}": (F.col(f"{p}_bid") + F.col(f"{p}_ask")) / 2 for p in PRICES}
    return bars.withColumns(mids | {"spread_close": F.greatest(F.col("close_ask") - F.col("close_bid"), F.lit(0.0))})


def repeated_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def merge_sides(bid: DataFrame, ask: DataFrame, one_to_one: bool = False, keys: tuple[str, ...] = ("pair", "ts")) -> DataFrame:
    """The keys and four prices of each side where both sides have the bar; keys that are null on both sides are equal.
    A bar that both sides have twice is joined four times: ``keys`` may tell such bars apart, and with ``one_to_one`` they raise."""
    for name, side in (("bid", bid), ("ask", ask)):
        if one_to_one and (twice := repeated_keys(side, list(keys)).first()):
            raise ValueError(f"{name} has {twice['n']} bars of {twice['pair']} at {twice['ts']}")
    named = lambda x, s, to: x.select(*[F.col(k).alias(to + k) for k in keys], *[F.col(p).alias(f"{p}_{s}") for p in PRICES])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return with_mids(named(bid, "bid", "").join(named(ask, "ask", "_"), same).drop(*[f"_{k}" for k in keys]))


def negative_spreads(bars: DataFrame) -> DataFrame:
    """(pair, n, clipped): bars, and those whose ask closes under the bid, which ``with_mids`` takes for a spread of 0."""
    return bars.groupBy("pair").agg(F.count("*").alias("n"), F.count_if(F.col("close_ask") < F.col("close_bid")).alias("clipped"))


def bars_per_window(width: str) -> int:
    """How many one-minute bars a clock window of e.g. "15 minutes" or "1 hour" holds."""
    number, unit = width.split()
    minutes = {"minute": 1, "hour": 60, "day": 1440}[unit.rstrip("s")]
    return int(number) * minutes


def clock_alignment(bars: DataFrame, width: str) -> DataFrame:
    """(pair, aligned): whether every label is the start of its clock window."""
    return bars.groupBy("pair").agg(F.bool_and(F.window("ts", width)["start"] == F.col("ts")).alias("aligned"))


def session_checks(bars: DataFrame, period: str, thin: float = 0.25) -> DataFrame:
    """Per pair: labels at 17:00 New York (and on Sunday for weekly bars), times that rise and do not repeat, minutes of a bar, and thin bars."""
    wall = calendar.to_wall(F.col("ts"))
    at_open = (F.hour(wall) == 17) & (F.minute(wall) == 0) if period in ("daily", "weekly") else (F.pmod(F.hour(wall) - 17, F.lit(int(period[0]) if period[0].isdigit() else 24)) == 0) & (F.minute(wall) == 0)
    if period == "weekly":
        at_open = at_open & (F.weekday(wall) == 6)
    middle = bars.groupBy("pair").agg(F.percentile("n_minutes", F.lit(0.5)).alias("median_minutes"))
    # one row for each instrument
    return bars.join(F.broadcast(middle), "pair").groupBy("pair").agg(
        F.bool_and(at_open).alias("labels_at_open"), (F.count_distinct("ts") == F.count("ts")).alias("unique_labels"), F.min("n_minutes").alias("min_minutes"),
        F.max("median_minutes").alias("median_minutes"), F.max("n_minutes").alias("max_minutes"), F.count_if(F.col("n_minutes") < thin * F.col("median_minutes")).alias("thin_bars"),
    )


def slice_window(frame: DataFrame, start, end) -> DataFrame:
    """Rows from start to end, both included; None leaves an end open."""
    if start is not None:
        frame = frame.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return frame if end is None else frame.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def finite(columns: list[str]) -> Column:
    """Whether every one of the columns is defined, a number and no infinity."""
    out = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        out = out & x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0))) & (F.abs(F.coalesce(x, F.lit(0.0))) < float("inf"))
    return out


def clock_bars(bars: DataFrame, width: str) -> DataFrame:
    """[t, t + width) labelled t; empty buckets have no row; n_minutes counts defined bid closes."""
    bucket = F.window("ts", width)["start"].alias("label")
    out = bars.groupBy("pair", bucket).agg(*_side_aggregates(), F.count("close_bid").alias("n_minutes"))
    return with_mids(out.withColumnRenamed("label", "ts"))


def session_bars(bars: DataFrame, period: str) -> DataFrame:
    """2h, 4h, daily or weekly bars from 17:00 New York, labelled with their UTC start; n_minutes counts rows."""
    key = calendar.session_key(F.col("ts"), period).alias("key")
    out = bars.groupBy("pair", key).agg(*_side_aggregates(), F.count("*").alias("n_minutes"))
    return with_mids(out.withColumn("ts", calendar.session_label(F.col("key"))).drop("key"))


def close_time(ts: Column, tf: str) -> Column:
    """When a bar labelled ts is complete."""
    if tf in calendar.SPANS:
        return calendar.session_close(ts, tf)
    return ts + F.expr(f"interval {tf}")


def side_bars(bars: DataFrame, side: str) -> DataFrame:
    """One side in the schema of the store."""
    return bars.select("pair", F.col("ts").alias("timestamp"), *[F.col(f"{p}_{side}").alias(p) for p in PRICES], F.lit(-1.0).alias("volume"))


def gaps(bars: DataFrame, step_minutes: int = 1) -> DataFrame:
    """(pair, start, end, minutes, kind) of every step longer than one bar."""
    from tidewright.functions.rolling import prev

    steps = bars.select("pair", prev("ts").alias("start"), F.col("ts").alias("end"))
    minutes = calendar.seconds_between(F.col("start"), F.col("end")) / 60
    return steps.where(minutes > step_minutes).select("pair", "start", "end", minutes.alias("minutes"), calendar.gap_kind(F.col("start"), F.col("end"), step_minutes).alias("kind"))


def quality_summary(bars: DataFrame, step_minutes: int = 1) -> DataFrame:
    """Rows, range and gaps of each kind per pair."""
    found = gaps(bars, step_minutes).groupBy("pair").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("weekend", "daily_reset", "active")],
        F.max(F.when(F.col("kind") == "active", F.col("minutes"))).alias("largest_active"),
    )
    rows = bars.groupBy("pair").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return rows.join(found, "pair", "left").fillna(0, ["n_weekend", "n_daily_reset", "n_active"])


def active_gap_samples(bars: DataFrame, step_minutes: int = 1, most: int = 5) -> DataFrame:
    """(pair, nth, start, end, minutes): the first gaps of each pair that no calendar explains."""
    found = gaps(bars, step_minutes).where("kind = 'active'")
    nth = F.row_number().over(Window.partitionBy("pair").orderBy("start"))
    return found.select("pair", nth.alias("nth"), "start", "end", "minutes").where(F.col("nth") <= most)


def format_quality(row, samples: list, label: str) -> str:
    """A quality summary and its samples of gaps as text."""
    largest = "none" if row["largest_active"] is None else f"{row['largest_active']:.0f} min"
    lines = [
        f"{label}: {row['n_rows']:,} bars, {row['first_ts']} to {row['last_ts']}",
        f"  gaps: weekend {row['n_weekend']}, daily reset {row['n_daily_reset']}, active {row['n_active']} (largest {largest})",
    ]
    return "\n".join([*lines, *(f"    {g['start']} to {g['end']}: {g['minutes']:.0f} min" for g in samples)])


def common_rows(frames: list[DataFrame], keys: tuple[str, ...] = ("pair", "ts")) -> DataFrame:
    """The distinct keys that every frame has; keys that are null are equal."""
    out = frames[0].select(*keys)
    for frame in frames[1:]:
        out = out.intersect(frame.select(*keys))
    return out.distinct()


def common_columns(frames: list[DataFrame]) -> list[str]:
    """Names that every frame has, in the first one's order."""
    return [c for c in frames[0].columns if all(c in frame.columns for frame in frames[1:])]


def numeric_view(frame: DataFrame, columns: list[str], keep: tuple[str, ...] = ("pair", "ts")) -> DataFrame:
    """The columns as doubles: flags are 0 and 1, times are seconds, text that is no number is null, and what is undefined stays so."""
    if absent := [c for c in columns if c not in frame.columns]:
        raise KeyError(f"the frame lacks {absent}")
    kinds = dict(frame.dtypes)

    def view(c: str) -> Column:
        if kinds[c] in ("timestamp", "timestamp_ntz", "date"):
            return F.unix_micros(F.col(c).cast("timestamp")) / 1e6
        return F.col(c).try_cast("double")

    return frame.select(*keep, *[view(c).alias(c) for c in columns])
