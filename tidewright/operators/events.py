"""Training events: blocks of one outcome, spaced sampling, levels frozen at entry and prices that are live."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.rolling import ratio
from tidewright.operators import features
from tidewright.operators.slices import Running, previous, scan


def blocks(frame: DataFrame, key: str) -> DataFrame:
    """block_id grows wherever the key changes (a null differs from every key); event_offset counts from 0 inside.

    Scans in two levels: no window over an instrument's whole time or over a block.
    """
    own = previous(frame, {"_was": F.col(key)})
    same = F.col(key).isNotNull() & F.col(key).eqNullSafe(F.col("_was"))
    own = scan(own.withColumn("_new", ~same), {"_row": Running(F.lit(1)), "block_id": Running(F.col("_new").cast("long"))})
    own = scan(own, {"_first": Running(F.when(F.col("_new"), F.col("_row")), "max")})
    out = own.withColumns({"block_id": F.col("block_id") - 1, "event_offset": (F.col("_row") - F.col("_first")).cast("long")})
    return out.drop("_was", "_new", "_row", "_first")


def spaced_sample(frame: DataFrame, seed: int, per_block: int = 3, min_gap: int = 3) -> DataFrame:
    """Up to ``per_block`` rows of each block, ``min_gap`` apart, every legal set equally likely.

    m of n - (m - 1) (gap - 1) places are drawn by a hash of seed, block and place and
    then spread: sampling without a gap maps one to one on sampling with it.
    """
    block = Window.partitionBy("pair", "block_id")
    n = F.count("*").over(block)
    m = F.least(F.lit(per_block), F.floor((n - 1) / min_gap) + 1)
    out = frame.withColumns({"_m": m, "_span": n - (m - 1) * (min_gap - 1)})
    drawn = F.row_number().over(block.orderBy((F.col("event_offset") >= F.col("_span")).cast("int"), F.md5(F.concat_ws("|", F.lit(seed), "pair", F.col("block_id"), F.col("event_offset")))))
    out = out.withColumn("_drawn", (drawn <= F.col("_m")) & (F.col("event_offset") < F.col("_span")))
    nth = F.sum(F.col("_drawn").cast("int")).over(block.orderBy("event_offset"))
    place = F.when(F.col("_drawn"), F.col("event_offset") + (min_gap - 1) * (nth - 1))
    out = out.withColumn("_places", F.collect_set(place).over(block))
    return out.withColumn("sampled_flag", F.array_contains("_places", F.col("event_offset"))).drop("_m", "_span", "_drawn", "_places")


def live_recompute(frame: DataFrame, ema_spans=(9, 21), windows=(60,), price: str = "anchor") -> DataFrame:
    """Band, mean and channel distances at the live price against levels that stay as they were."""
    out = frame.withColumn("bb_position", features.band_position(F.col(price)))
    out = out.withColumns({f"dist_ema_{n}": ratio(F.col(price) - F.col(f"ema_{n}"), F.col(f"ema_{n}")) for n in ema_spans})
    return features.donchian_position(out, windows, price)
