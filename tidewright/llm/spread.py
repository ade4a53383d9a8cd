"""Joins on keys that may hold a third of all rows: such keys are parted by a salt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def hot_keys(frame: DataFrame, key: str) -> DataFrame:
    """(hot_key, parts) of the keys that a thousandth of the rows or more have: a thousand at most, with two thousand parts at most."""
    counts = frame.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("hot_key")).agg(F.count("*").alias("n"))
    total = max(1, frame.count())
    return counts.where((F.col("n") * SHARE >= total) & (F.col("n") > 1)).select("hot_key", F.ceil(F.col("n") * SHARE / total).cast("int").alias("parts"))


def spread_left_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """``left`` with the columns of ``right`` (one row for each key). Rows of hot and of null keys are dealt to parts by a hash of ``by``."""
    hot = F.broadcast(hot)  # at most SHARE rows
    marked = left.join(hot, left[key] == hot["hot_key"], "left").drop("hot_key")
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(SHARE))).otherwise(F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))))
    marked = marked.withColumn("salt", salt.cast("int")).drop("parts")
    wide = right.join(hot, right[key] == hot["hot_key"], "left").drop("hot_key")
    wide = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return marked.join(wide.hint("merge"), [key, "salt"], "left").drop("salt")
