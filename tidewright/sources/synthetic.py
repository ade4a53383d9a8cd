"""Made-up bars for demonstrations and tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def synthetic_bars(spark: SparkSession, n: int = 2000, seed: int = 0, pair: str = "DEMO", spread: float = 1e-4) -> DataFrame:
    """n quarter-hour bars on weekdays whose mid returns to 1 (an autoregressive walk), with one spread; made on the driver."""
    rng = np.random.default_rng(seed)
    close = np.ones(n + 1)
    for i in range(n):
        close[i + 1] = 1 + 0.995 * (close[i] - 1) + rng.normal(0, 4e-4)
    wicks = np.abs(rng.normal(0, 2e-4, (2, n)))
    at, rows, half = dt.datetime(2024, 1, 1), [], spread / 2
    for i in range(n):
        while at.weekday() > 4:
            at += dt.timedelta(days=1)
        a, b = float(close[i]), float(close[i + 1])
        mid = (a, max(a, b) + float(wicks[0, i]), min(a, b) - float(wicks[1, i]), b)
        rows.append((pair, at, *(p - half for p in mid), *(p + half for p in mid)))
        at += dt.timedelta(minutes=15)
    sides = ", ".join(f"{p}_{s} double" for s in ("bid", "ask") for p in ("open", "high", "low", "close"))
    return spark.createDataFrame(rows, f"pair string, ts timestamp_ntz, {sides}")
