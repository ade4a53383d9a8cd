"""Bars of a stream of quotes, and rules over them: a bucket or a signal is emitted once, when the watermark has passed its end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewright.functions import calendar
from tidewright.sources.barstore import BarStore

BAND_COLUMNS = ["mid_close", "bb_lower", "bb_middle", "bb_upper"]

def stream_clock_bars(ticks: DataFrame, width: str, late: str = "1 minute") -> DataFrame:
    """(pair, ts, open, high, low, close, n) of the mid of a stream (pair, ts, mid)."""
    of = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    order = F.struct("ts", "mid")
    out = of.groupBy("pair", F.window("ts", width).alias("w")).agg(
        F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"), F.count("*").alias("n")
    )
    return out.select("pair", F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")


def stream_session_bars(ticks: DataFrame, period: str = "daily", late: str = "1 minute") -> DataFrame:
    """As above over New York sessions; the stream's time column carries the watermark into the session's start."""
    of = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    key = calendar.session_label(calendar.session_key(F.col("ts").cast("timestamp_ntz"), period)).cast("timestamp")
    order = F.struct("ts", "mid")
    return of.groupBy("pair", key.alias("session")).agg(F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"), F.count("*").alias("n"))


class _BandRule(StatefulProcessor):
    """Bars wait under their times until the watermark has passed them; a timer for each time then decides them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "held int")
        self.waiting = handle.getMapState("waiting", "at long", "mid_close double, bb_lower double, bb_middle double, bb_upper double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            times = part["ts"].astype("datetime64[ms]").astype("int64")
            for at, *bar in zip(times.tolist(), *(part[c].tolist() for c in BAND_COLUMNS)):
                if not self.waiting.containsKey((at,)):
                    self.handle.registerTimer(at)
                self.waiting.updateValue((at,), tuple(None if pd.isna(x) else float(x) for x in bar))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        bar = self.waiting.getValue((at,))
        self.waiting.removeKey((at,))
        held = self.held.get()[0] if self.held.exists() else 0
        held = _next_signal(held, *bar)
        self.held.update((held,))
        yield pd.DataFrame({"pair": [key[0]], "ts": pd.to_datetime([at], unit="ms"), "signal": pd.array([held], "int32")})

    def close(self) -> None:
        pass


def _next_signal(held: int, price, low, mid, high) -> int:
    if price is None or low is None or mid is None or high is None:
        return 0
    if held:
        return 0 if held * (price - mid) >= 0 else held
    return 1 if price <= low else -1 if price >= high else 0


def stream_reversion(bars: DataFrame, late: str = "1 minute") -> DataFrame:
    """(pair, ts, signal) of the band rule on a stream (pair, ts, mid_close, bb_lower, bb_middle, bb_upper).

    A bar is decided when the watermark, ``late`` behind the newest bar, has passed its time: whatever the order of
    arrival within that, the signals are those of all bars in order. Bars that come after the
    watermark has passed are dropped; of bars at one millisecond the last to come counts. The state of a pair is
    its signal and the bars that wait, which the watermark bounds. Needs a RocksDB state store.
    """
    of = bars.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return of.groupBy("pair").transformWithStateInPandas(_BandRule(), "pair string, ts timestamp, signal int", "Append", "EventTime")


def upsert_bars(stream: DataFrame, root: str, side: str = "mid"):
    """A writer that appends every micro-batch of ``stream`` (pair, ts, open, high, low, close) to the bar store: a bar that comes again replaces its former self, so a batch may be replayed."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("pair", F.col("ts").cast("timestamp_ntz").alias("timestamp"), "open", "high", "low", "close", F.lit(-1.0).alias("volume"))
        for r in rows.select("pair").distinct().collect():  # one row for each instrument
            BarStore(spark, root, r.pair, side).append(rows.where(F.col("pair") == r.pair))

    return stream.writeStream.outputMode("append").foreachBatch(write)
