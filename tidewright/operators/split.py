"""Leakage-controlled time splits: chunks of months, purge of rows whose label window reaches the test, embargo after it."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.rolling import ordered
from tidewright.operators.slices import over_slices


def build_chunks(start: dt.datetime, end: dt.datetime, months: int = 3, least_days: int = 45) -> list[tuple[dt.datetime, dt.datetime]]:
    """Edges every ``months`` months, each from the edge before (so month ends drift); a short tail joins the last chunk."""
    edges, at = [start], start
    while (at := (pd.Timestamp(at) + pd.DateOffset(months=months)).to_pydatetime()) <= end:
        edges.append(at)
    if len(edges) > 1 and end - edges[-1] < dt.timedelta(days=least_days):
        edges.pop()
    return list(zip(edges, [*edges[1:], end + dt.timedelta(minutes=1)]))


def chunk_table(spark: SparkSession, chunks) -> DataFrame:
    rows = [(i, a, b) for i, (a, b) in enumerate(chunks)]
    return spark.createDataFrame(rows, "chunk_id int, chunk_start timestamp_ntz, chunk_end timestamp_ntz")


def with_chunk(frame: DataFrame, chunks: list) -> DataFrame:
    """chunk_id of every row, -1 outside; the chunks are a short list of literals."""
    found = F.lit(-1)
    for i, (a, b) in enumerate(chunks):
        found = F.when((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz")), i).otherwise(found)
    return frame.withColumn("chunk_id", found)


def _any_within(frame: DataFrame, spans: dict[str, tuple[str, int, int]]) -> DataFrame:
    """``frame`` with, for each name, whether its flag holds in one of the rows from ``first`` to ``last`` away: differences of one running count, at any span."""
    flags = sorted({flag for flag, _, _ in spans.values()})
    path = ordered().rowsBetween(Window.unboundedPreceding, 0)
    out = frame.withColumns({f"_upto_{f}": F.count_if(F.col(f)).over(path) for f in flags} | {f"_all_{f}": F.count_if(F.col(f)).over(Window.partitionBy("pair")) for f in flags})

    def upto(flag: str, away: int) -> Column:
        count = F.col(f"_upto_{flag}")
        if away > 0:
            return F.coalesce(F.lead(count, away).over(ordered()), F.col(f"_all_{flag}"))
        return F.coalesce(F.lag(count, -away).over(ordered()), F.lit(0)) if away else count

    out = out.withColumns({name: upto(flag, last) > upto(flag, first - 1) for name, (flag, first, last) in spans.items()})
    return out.drop(*[f"_{kind}_{f}" for f in flags for kind in ("upto", "all")])


def assign_splits(frame: DataFrame, test: list[int], horizon: int = 240, embargo: int = 1440, slice_rows: int | None = None) -> DataFrame:
    """split of every row with a chunk_id: warmup, train, test, purged (train whose window reaches the test), embargoed (rows after an edge)."""
    is_test = F.col("chunk_id").isin(test)

    def build(own: DataFrame) -> DataFrame:
        out = own.withColumn("_test", F.coalesce(is_test & (F.col("chunk_id") >= 0), F.lit(False)))
        edge = (F.col("chunk_id") >= 0) & (F.lag("chunk_id").over(ordered()) >= 0) & (F.col("_test") != F.lag("_test").over(ordered()))
        out = _any_within(out.withColumn("_edge", F.coalesce(edge, F.lit(False))), {"_reach": ("_test", 1, horizon), "_near": ("_edge", 1 - embargo, 0)})
        side = F.when(F.col("_test"), "test").otherwise("train")
        split = F.when(F.col("chunk_id") < 0, "warmup").when(~F.col("_test") & F.col("_reach"), "purged").when(F.col("_near"), "embargoed").otherwise(side)
        return out.withColumn("split", split).drop("_test", "_edge", "_reach", "_near")

    return over_slices(frame, build, embargo + 1, horizon, slice_rows)


def period_labels(frame: DataFrame, test: list[int], train_start: dt.datetime, val_start: dt.datetime, embargo: int = 96, slice_rows: int | None = None) -> DataFrame:
    """pre, train, val or test, with an embargo on both sides of every edge of the test."""
    before = lambda t: F.col("ts") < F.lit(t).cast("timestamp_ntz")

    def build(own: DataFrame) -> DataFrame:
        out = own.withColumn("_test", F.col("chunk_id").isin(test))
        edge = F.col("_test") != F.lag("_test").over(ordered())
        out = _any_within(out.withColumn("_edge", F.coalesce(edge, F.lit(False))), {"_near": ("_edge", 1 - embargo, embargo)})
        period = F.when(F.col("_near"), "embargo").when(F.col("_test"), "test").when(before(train_start), "pre").when(before(val_start), "train").otherwise("val")
        return out.withColumn("period", period).drop("_test", "_edge", "_near")

    return over_slices(frame, build, embargo + 1, embargo, slice_rows)


def purged_validation(frame: DataFrame, val_start: dt.datetime, horizon: int = 240, embargo: int = 1440, slice_rows: int | None = None) -> DataFrame:
    """is_fit and is_val of train rows: fit rows do not reach the validation, whose first ``embargo`` rows are dropped."""
    late = F.col("ts") >= F.lit(val_start).cast("timestamp_ntz")
    train = F.col("split") == "train"

    def build(own: DataFrame) -> DataFrame:
        out = _any_within(own.withColumns({"_late": late, "_val": F.coalesce(train & late, F.lit(False))}), {"_reach": ("_val", 1, horizon)})
        # late rows come last, so that a row has more than ``embargo`` of them up to it if the one so far back is late
        settled = F.coalesce(F.lag("_late", embargo).over(ordered()), F.lit(False))
        return out.withColumns({"is_fit": train & ~late & ~F.col("_reach"), "is_val": F.col("_val") & settled}).drop("_late", "_val", "_reach")

    return over_slices(frame, build, embargo + 1, horizon, slice_rows)


def draw_candidates(chunks: int, test: int, draws: int = 200, seed: int = 0) -> list[tuple[int, ...]]:
    """Distinct sorted subsets, in the order drawn."""
    rng, seen = np.random.default_rng(seed), {}
    most = min(draws, math.comb(chunks, test))
    for _ in range(50 * draws):
        if len(seen) == most:
            break
        seen[tuple(sorted(rng.choice(chunks, test, replace=False).tolist()))] = None
    return list(seen)


def rank_candidates(scores: DataFrame, criteria: list[str]) -> DataFrame:
    """Sum of average-tie ranks over the criteria (smaller is better); the first row is the choice."""
    total = F.lit(0.0)
    for c in criteria:
        ties = Window.partitionBy(c)
        total = total + F.rank().over(Window.orderBy(c)) + (F.count("*").over(ties) - 1) / 2
    # a score for each of a few hundred candidates
    return scores.withColumn("rank_sum", total).orderBy("rank_sum", "candidate")
