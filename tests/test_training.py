import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import features, model, training
from tidewright.operators.split import rank_candidates

START = dt.datetime(2024, 3, 4)


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, f"pair string, ts timestamp_ntz, {columns}")


def minutes(n):
    return START + dt.timedelta(minutes=n)


def test_levels_are_seen_at_their_own_close(spark):
    base = frame(spark, [("a", minutes(m), 1.0 + m, 0.0 + m) for m in (0, 15, 30)], "bb_upper double, bb_lower double")
    coarse = frame(spark, [("a", minutes(0), 9.0, 8.0)], "bb_upper double, bb_lower double")
    events = frame(spark, [("a", minutes(m), m) for m in (14, 15, 29, 30, 31)], "n int")
    rows = training.frozen_levels(events, base, {"30 minutes": coarse}, "15 minutes", (), ()).orderBy("ts").collect()
    assert [r.bb_upper for r in rows] == [None, 1.0, 1.0, 16.0, 16.0]
    assert [r["bb_upper_30 minutes"] for r in rows] == [None, None, None, 9.0, 9.0]


def test_assembly_prunes_prices_and_refuses_shared_names(spark):
    base = frame(spark, [("a", minutes(m), 2.0, 0.0, 5.0, 7) for m in range(0, 60, 15)], "bb_upper double, bb_lower double, mid_close double, n_minutes int")
    events = frame(spark, [("a", minutes(m), 3.0, m // 30 * 1.0) for m in range(60)], "anchor double, atr double")
    out = training.assemble(events, base, {}, ["anchor"], seed=3, ema_spans=(), windows=())
    assert out.columns == ["pair", "ts", "block_id", "event_offset", "sampled_flag", "n_minutes", "bb_pct_b", "tf_stretch_count", "tf_stretch_max", "anchor"]
    rows = out.orderBy("ts").collect()
    assert [r.bb_pct_b for r in rows[:15]] == [None] * 15 and all(r.bb_pct_b == 1.5 for r in rows[15:])
    assert sum(r.sampled_flag for r in rows) == 6 and {r.block_id for r in rows} == {0, 1}
    with pytest.raises(ValueError):
        training.assemble(events.withColumn("n_minutes", F.lit(1)), base, {}, ["anchor"], ema_spans=(), windows=())
    with pytest.raises(ValueError):
        training.assemble(events, base, {}, ["gone"], ema_spans=(), windows=())


def test_price_units_are_forty_three():
    assert len(training.price_units()) == 43


def test_balance_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [("a", dt.datetime(2023, 1, 1) + dt.timedelta(days=3 * i), i // 50, int(rng.integers(-1, 2)), float(rng.gamma(2))) for i in range(250)]
    rows += [("a", dt.datetime(2023, 1, 1), -1, 1, 99.0)]
    found = training.balance(frame(spark, rows, "chunk_id int, label int, vol double"), [(0, 1), (1, 4)], "label", "vol")
    best = rank_candidates(found, training.BALANCE).collect()
    for r in best:
        test = [x for x in rows if x[2] in r.held]
        train = [x for x in rows if x[2] >= 0 and x[2] not in r.held]
        share = lambda of: max(np.unique([of(x[1]) for x in test], return_counts=True)[1]) / len(test)
        apart = max(abs(np.mean([x[3] == k for x in test]) - np.mean([x[3] == k for x in train])) for k in (-1, 0, 1))
        medians = [np.median([x[4] for x in side]) for side in (test, train)]
        assert r.quarter_max_share == pytest.approx(share(lambda t: (t.month - 1) // 3))
        assert r.year_max_share == pytest.approx(share(lambda t: t.year))
        assert r.label_max_div_pp == pytest.approx(100 * apart)
        assert r.vol_rel_div == pytest.approx(abs(medians[0] - medians[1]) / medians[1])
        assert r.adjacent_pairs == (r.held[1] - r.held[0] == 1)


def test_live_columns_agree_with_carried_ones(spark):
    rows = [("a", minutes(i), float(i), float(2 * i)) for i in range(20)]
    f = frame(spark, rows, "x double, y double")
    assert training.live_agreement(f, f.withColumn("y", -F.col("y")), ["x", "y"]).collect() == [("x", pytest.approx(1.0)), ("y", pytest.approx(-1.0))]


def test_subsets(spark):
    names = [*model.CORE, "bb_position_2h", "run_above_2h", "hour_sin", "adx_14"]
    assert model.subset(names, "B_strategy_core") == list(model.CORE)
    assert "hour_sin" not in model.subset(names, "D_no_time") and "adx_14" not in model.subset(names, "C_mtf_bollinger")
    with pytest.raises(KeyError):
        model.subset(names[1:], "B_strategy_core")
    assert set(features.DONCHIAN) == {60, 180, 240, 360, 720, 1440}
