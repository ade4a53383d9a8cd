"""Feature frames by timeframe and pair, and the two tables of training events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMEFRAMES = ("15min", "30min", "1h", "2h", "4h", "daily")


def features_path(root: str, tf: str, pair: str | None = None) -> str:
    return f"{root}/features/tf={tf}" + (f"/pair={pair.upper()}" if pair else "")


def write_features(frame: DataFrame, root: str, tf: str) -> None:
    """The pairs in ``frame`` are replaced, others stay."""
    placed = frame.withColumn("pair", F.upper("pair")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    placed.partitionBy("pair").parquet(features_path(root, tf))


def read_features(spark: SparkSession, root: str, tf: str, columns: list[str] | None = None, pairs: list[str] | None = None) -> DataFrame:
    """(pair, ts, ...) of one timeframe; only the columns asked for are read, only the pairs' folders are opened."""
    held = spark.read.parquet(features_path(root, tf))
    if pairs is not None:
        held = held.where(F.col("pair").isin([p.upper() for p in pairs]))
    names = [c for c in held.columns if c not in ("pair", "ts")] if columns is None else columns
    return held.select(F.col("pair").cast("string").alias("pair"), "ts", *names)


def read_timeframes(spark: SparkSession, root: str, timeframes=TIMEFRAMES, columns: list[str] | None = None) -> dict[str, DataFrame]:
    return {tf: read_features(spark, root, tf, columns) for tf in timeframes}


def write_events(events: DataFrame, root: str) -> None:
    """All events, and those that are sampled: the second table comes from the first one's files, not from another run of the plan."""
    events.write.mode("overwrite").partitionBy("pair").parquet(f"{root}/events")
    held = events.sparkSession.read.schema(events.schema).parquet(f"{root}/events")
    held.where("sampled_flag").write.mode("overwrite").partitionBy("pair").parquet(f"{root}/events_sampled")
