import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions.rolling import ordered, trailing
from tidewright.operators import asof, events, features, slices, stats
from tidewright.operators.slices import Running, carried, in_slices, over_slices, previous, scan

START = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def bars(spark):
    """Two instruments of unlike density, with gaps of days, a day of many rows, and unknown prices."""
    rng = np.random.default_rng(4)
    rows = []
    for pair, n, step in (("A", 700, 37), ("B", 90, 700)):
        minute = 0
        for i in range(n):
            minute += int(rng.integers(1, 2 * step)) + (4000 if rng.random() < 0.01 else 0)
            x = float(rng.normal(100, 1))
            rows.append((pair, START + dt.timedelta(minutes=minute), None if rng.random() < 0.05 else x, x + 1, x - 1, float(rng.integers(0, 4)) if rng.random() < 0.9 else None))
        rows += [(pair, START + dt.timedelta(days=9, seconds=i), 100.0 + i % 7, 101.0 + i % 7, 99.0, 1.0) for i in range(150)]
    frame = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, mid_close double, mid_high double, mid_low double, key double")
    return frame.dropDuplicates(["pair", "ts"]).cache()


def key(frame, digits=9):
    plain = lambda v: round(v, digits) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in frame.collect()), key=str)


@pytest.mark.parametrize("rows,before,behind", [(40, 25, 0), (40, 0, 25), (7, 60, 60), (100_000, 5, 5), (60, 500, 3)])
def test_slices_hold_their_halos(bars, rows, before, behind):
    dealt = in_slices(bars, before, behind, rows).collect()
    order = {pair: sorted(r.ts for r in bars.collect() if r.pair == pair) for pair in "AB"}
    assert sorted((r.pair, r.ts) for r in dealt if r._of_slice) == sorted((p, t) for p, own in order.items() for t in own)
    held = {}
    for r in dealt:
        held.setdefault((r.pair, r._slice), []).append((r.ts, r._of_slice))
    for (pair, _), own in held.items():
        times = order[pair]
        first, last = min(t for t, o in own if o), max(t for t, o in own if o)
        a, b = times.index(first), times.index(last)
        assert {t for t, _ in own} >= set(times[max(0, a - before) : b + behind + 1]) and len({t for t, _ in own}) == len(own)
    assert rows > 1000 or len(held) > 4


def test_windows_over_slices_equal_plain_windows(bars):
    def build(f):
        return f.withColumns({"s": F.sum("mid_close").over(trailing(20)), "h": F.max("mid_high").over(ordered().rowsBetween(1, 12)), "l": F.lag("key", 3).over(ordered())})

    sliced = over_slices(bars, build, 20, 12, rows=50)
    assert key(sliced) == key(build(bars))
    plan = sliced._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(pair#" in plan  # the struct of instrument and slice
    assert key(over_slices(bars, features.bollinger, 20, rows=30), 7) == key(features.bollinger(bars), 7)


def test_moments_over_slices_equal_plain_ones(bars):
    own = features.with_usual_step(bars.na.fill(100.0, ["mid_close"]))
    assert key(over_slices(own, lambda f: features.moments(f, (24,)), 40, rows=60), 6) == key(features.moments(own, (24,)), 6)


def test_scans_equal_plain_windows(bars):
    path = ordered().rowsBetween(Window.unboundedPreceding, 0)
    wanted = bars.withColumns({"s": F.sum("mid_close").over(path), "m": F.max("mid_close").over(path), "n": F.count("key").over(path), "least": F.min("key").over(path)})
    found = scan(bars, {"s": Running(F.col("mid_close")), "m": Running(F.col("mid_close"), "max"), "n": Running(F.col("key"), "count"), "least": Running(F.col("key"), "min")})
    assert key(found, 6) == key(wanted, 6)
    assert "Window.unbounded" not in str(found) and key(previous(bars, {"p": F.col("key")})) == key(bars.withColumn("p", F.lag("key").over(ordered())))
    last = F.last("key", ignorenulls=True).over(path)
    assert key(carried(bars, {"c": F.col("key")}, ["ts"])) == key(bars.withColumn("c", last))


def test_blocks_equal_a_loop(bars):
    found = {(r.pair, r.ts): (r.block_id, r.event_offset) for r in events.blocks(bars, "key").collect()}
    for pair in "AB":
        block, offset, was = -1, 0, None
        for r in sorted((r for r in bars.collect() if r.pair == pair), key=lambda r: r.ts):
            if r.key is None or r.key != was or block < 0:
                block, offset = block + 1, 0
            assert found[pair, r.ts] == (block, offset)
            offset, was = offset + 1, r.key


def test_drawdown_equals_a_loop(bars):
    found = {(r.pair, r.ts): (r.cumulative, r.drawdown) for r in stats.drawdown(bars.withColumn("x", F.coalesce(F.col("mid_close") - 100, F.lit(0.0))), "x").collect()}
    for pair in "AB":
        total = peak = 0.0
        for r in sorted((r for r in bars.collect() if r.pair == pair), key=lambda r: r.ts):
            total += (r.mid_close - 100) if r.mid_close is not None else 0.0
            peak = max(peak, total)
            assert found[pair, r.ts] == pytest.approx((total, total - peak))


def test_asof_over_days_equals_a_search(spark, bars):
    coarse = bars.where("key is not null").groupBy("pair", F.date_trunc("day", "ts").alias("ts")).agg(F.max_by("mid_close", "ts").alias("x")).where("day(ts) % 5 <> 0")
    found = asof.asof(bars.select("pair", "ts"), coarse, ["x"], "1 day").collect()
    closes = sorted((r.pair, r.ts + dt.timedelta(days=1), r.x) for r in coarse.collect())
    for r in found:
        own = [c for c in closes if c[0] == r.pair and c[1] <= r.ts]
        assert r.x == (own[-1][2] if own else None)
    assert len(found) == bars.count()
    plan = asof.asof(bars.select("pair", "ts"), coarse, ["x"], "1 day")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_key#" in plan  # rows by instrument and day; only the table of days goes by instrument


def test_rows_without_an_instrument_or_a_time(spark):
    rows = [(None, START, 1.0), (None, START + dt.timedelta(days=2), 2.0), ("A", None, 5.0), ("A", START, 7.0)]
    frame = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, x double")
    found = {(r.pair, r.ts): r.s for r in scan(frame, {"s": Running(F.col("x"))}).collect()}
    assert found == {(None, START): 1.0, (None, START + dt.timedelta(days=2)): 3.0, ("A", None): 5.0, ("A", START): 12.0}
    assert sorted(r.s for r in over_slices(frame, lambda f: f.withColumn("s", F.sum("x").over(ordered())), 10, rows=1).collect()) == [1.0, 3.0, 5.0, 12.0]
    empty = frame.limit(0)
    assert scan(empty, {"s": Running(F.col("x"))}).count() == carried(empty, {"c": F.col("x")}, ["ts"]).count() == over_slices(empty, lambda f: f, 3).count() == 0
    assert slices.SLICE_ROWS > 1000


def test_first_reach_equals_a_loop():
    from tidewright.operators.folds import first_reach

    rng = np.random.default_rng(8)
    for horizon in (1, 2, 3, 7, 8, 240):
        x = rng.normal(size=400).cumsum()
        x[rng.random(400) < 0.05] = np.nan
        level = np.where(rng.random(400) < 0.1, np.nan, np.nan_to_num(x) + rng.normal(0.5, 2, 400))
        found = first_reach(x, level, horizon)
        for i in range(400):
            met = [k for k in range(1, horizon + 1) if i + k < 400 and x[i + k] >= level[i]]
            assert np.isnan(level[i]) or found[i] == (met[0] if met else 0)
    assert first_reach(np.zeros(0), np.zeros(0), 5).tolist() == [] and first_reach(np.ones(1), np.ones(1), 5).tolist() == [0]


def test_trailing_extremes_and_quantiles_equal_a_loop():
    from tidewright.operators.folds import trailing_extreme, trailing_quantile

    rng = np.random.default_rng(9)
    x = rng.normal(size=333)
    x[rng.random(333) < 0.02] = np.nan
    for w in (1, 2, 7, 60, 332, 333, 1440):
        for largest in (True, False):
            found = trailing_extreme(x, w, largest)
            for i in range(333):
                own = x[i - w : i] if i >= w else np.array([np.nan])
                want = np.nan if np.isnan(own).any() else (own.max() if largest else own.min())
                assert (np.isnan(found[i]) and np.isnan(want)) or found[i] == want
    for w, least in ((24, 12), (96, 48), (400, 4)):
        for k in range(1, 8):
            found = trailing_quantile(x, w, least, k / 8)
            for i in range(333):
                own = x[max(0, i - w + 1) : i + 1]
                own = own[~np.isnan(own)]
                assert np.isnan(found[i]) if len(own) < least else abs(found[i] - np.quantile(own, k / 8)) < 1e-12



def test_splits_over_slices_equal_a_loop(bars):
    from tidewright.operators import split

    chunks = [(START + dt.timedelta(days=3 * k), START + dt.timedelta(days=3 * k + 3)) for k in range(5)]
    own = split.with_chunk(bars, chunks)
    late = START + dt.timedelta(days=7)
    for rows in (35, 100_000):
        table = split.purged_validation(split.assign_splits(own, [1, 3], 9, 14, rows), late, 9, 14, rows)
        found = {(r.pair, r.ts): r for r in table.collect()}
        assert len(found) == bars.count()
        for pair in "AB":
            series = sorted((r for r in found.values() if r.pair == pair), key=lambda r: r.ts)
            test = [r.chunk_id in (1, 3) for r in series]
            edge = [i > 0 and series[i].chunk_id >= 0 <= series[i - 1].chunk_id and test[i] != test[i - 1] for i in range(len(series))]
            is_late = [r.ts >= late for r in series]
            for i, r in enumerate(series):
                want = "test" if test[i] else "train"
                if r.chunk_id < 0:
                    want = "warmup"
                elif not test[i] and any(test[i + 1 : i + 10]):
                    want = "purged"
                elif any(edge[max(0, i - 13) : i + 1]):
                    want = "embargoed"
                assert r.split == want
            val = [r.split == "train" and is_late[i] for i, r in enumerate(series)]
            for i, r in enumerate(series):
                assert r.is_fit == (r.split == "train" and not is_late[i] and not any(val[i + 1 : i + 10]))
                assert r.is_val == (val[i] and sum(is_late[: i + 1]) > 14)
