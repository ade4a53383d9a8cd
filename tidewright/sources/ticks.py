"""Quotes out of the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def utc(frame: DataFrame, name: str) -> Column:
    """A time column as UTC without a zone, whatever the session's zone is."""
    if dict(frame.dtypes)[name] != "timestamp":
        return F.col(name).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(name).cast("timestamp_ntz"))


def read_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """(pair, ts, mid, bid, ask): an event type is an instrument, the value its mid, props its spread."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    half = F.col("value") * (1 + F.get_json_object("props", "$.k").cast("int")) / 200000.0
    return events.select(F.col("event_type").alias("pair"), utc(events, "ts").alias("ts"), F.col("value").alias("mid"), half.alias("half")).select(
        "pair", "ts", "mid", (F.col("mid") - F.col("half")).alias("bid"), (F.col("mid") + F.col("half")).alias("ask")
    )


def flat_bars(ticks: DataFrame) -> DataFrame:
    """Each tick as one bar whose four prices are the tick's."""
    sides = [F.col(s).alias(f"{p}_{s}") for s in ("bid", "ask") for p in ("open", "high", "low", "close")]
    return ticks.select("pair", "ts", *sides)
