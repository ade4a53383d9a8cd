"""Frames that many queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import bars, features, strategies
from tidewright.operators.asof import asof
from tidewright.operators.simulate import Setup
from tidewright.sources.ticks import flat_bars, read_ticks

SETUP = Setup(notional=1000.0, warmup=30)
BAND = 0.8  # the tick table's prices are skewed: bands of two deviations are hardly ever touched from below
FAST = dict(ema_spans=(9, 21), atr_period=14, rsi_periods=(14, 2), adx_period=14)


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return read_ticks(spark, folder)


def flat(spark: SparkSession, folder: str) -> DataFrame:
    return flat_bars(read_ticks(spark, folder))


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return bars.clock_bars(flat(spark, folder), "1 hour")


def session(spark: SparkSession, folder: str, period: str) -> DataFrame:
    return bars.session_bars(flat(spark, folder), period)


def recurrent(frame: DataFrame) -> DataFrame:
    return features.recurrences(frame, **FAST, pieces=True)


def bands(frame: DataFrame, window: int = 20) -> DataFrame:
    return features.bollinger(frame, window, BAND)


def banded(spark: SparkSession, folder: str) -> DataFrame:
    return bands(recurrent(hourly(spark, folder)))


def regime(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars with bands and the reversion signal of the daily bars that have closed."""
    daily = strategies.reversion_signal(bands(session(spark, folder, "daily"), 5))
    joined = asof(banded(spark, folder), daily.withColumnRenamed("signal", "regime_daily"), ["regime_daily"], "daily")
    return joined.withColumn("regime_daily", F.coalesce("regime_daily", F.lit(0)).cast("int"))


def signalled(spark: SparkSession, folder: str) -> DataFrame:
    return strategies.reversion_signal(bands(hourly(spark, folder)), pieces=True)


def rounded(frame: DataFrame, keep: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return frame.select(*keep, *[(F.round(F.col(v).cast("double"), digits) + 0.0).alias(v) for v in values])
