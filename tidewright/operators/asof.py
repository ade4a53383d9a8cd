"""As-of projection of completed bars: a row sees a coarser bar only once it has closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.bars import close_time
from tidewright.operators.slices import carried


def asof(target: DataFrame, bars: DataFrame, columns: list[str], tf: str, suffix: str = "") -> DataFrame:
    """``target`` with the columns of the last bar whose close is at or before ts."""
    return asof_many(target, [(bars, columns, tf, suffix)])


def asof_many(target: DataFrame, sources: list[tuple[DataFrame, list[str], str, str]]) -> DataFrame:
    """``target`` with columns of several series (bars, columns, timeframe, suffix), each as of its own closes.

    Rows are carried, not values: a null inside the last closed bar stays null. One
    union and one window over (pair, day), whose sort serves all series; a day without a
    closed bar yet takes the last one of the days before, from a table with a row for each day.
    """
    both = target.select("pair", "ts", F.lit(1).alias("_order"), F.struct(*[F.col(c) for c in target.columns]).alias("_row"))
    for i, (bars, columns, tf, suffix) in enumerate(sources):
        payload = F.struct(*[F.col(c).alias(f"{c}{suffix}") for c in columns])
        source = bars.select("pair", close_time(F.col("ts"), tf).alias("ts"), F.lit(0).alias("_order"), payload.alias(f"_bar_{i}"))
        both = both.unionByName(source, allowMissingColumns=True)
    seen = carried(both, {f"_seen_{i}": F.col(f"_bar_{i}") for i in range(len(sources))}, ["ts", "_order"])
    return seen.where("_order = 1").select("_row.*", *[f"_seen_{i}.*" for i in range(len(sources))])
