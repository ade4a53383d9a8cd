import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import calendar
from tidewright.operators import bars, features, labels, model, pipeline, stats, strategies
from tidewright.plans import jobs
from tidewright.sources import barstore, featurestore, files
from tidewright.sources.synthetic import synthetic_bars

START = dt.datetime(2024, 1, 2)


def mids(rng, n, step=60, pair="P", start=START):
    close = 10 + np.cumsum(rng.normal(0, 0.02, n))
    opened = np.concatenate([[10.0], close[:-1]])
    rows = []
    for i in range(n):
        high, low = max(opened[i], close[i]) + 0.01, min(opened[i], close[i]) - 0.01
        rows.append((pair, start + dt.timedelta(minutes=step * i), *(float(x) for p in (opened[i], high, low, close[i]) for x in (p - 0.005, p + 0.005))))
    return rows


SIDES = "pair string, ts timestamp_ntz, " + ", ".join(f"{p}_{s} double" for p in bars.PRICES for s in bars.SIDES)


def frame(spark, *rows):
    return bars.with_mids(spark.createDataFrame([r for part in rows for r in part], SIDES))


def test_bars_become_timeframes_and_features(spark, tmp_path):
    minute = synthetic_bars(spark, 700, 5, "demo")
    for s in bars.SIDES:
        barstore.BarStore(spark, f"{tmp_path}/1min", "demo", s).append(bars.side_bars(minute, s).drop("pair"))
    for tf in ("1h", "daily"):
        check = jobs.resample_job(spark, str(tmp_path), tf).collect()
        assert [(r.pair, r.rows_in, r.rows_held, r.kept) for r in check] == [("DEMO", 700, 700, True)]
        held = featurestore.read_features(spark, str(tmp_path), tf)
        assert held.count() == barstore.BarStore(spark, f"{tmp_path}/{tf}", "demo", "bid").row_count()
        assert {"ema_9", "adx_14", "bb_pct_b", "donchian_pos_60", "upper_wick_atr", "spread_z_60", "hour_sin"} <= set(held.columns)
    hours = jobs.load_pairs(spark, f"{tmp_path}/1h", ["demo"])
    assert bars.clock_alignment(hours, "1 hour").first().aligned and not bars.clock_alignment(hours, "4 hours").first().aligned
    assert bars.bars_per_window("15 minutes") == 15 and bars.bars_per_window("1 day") == 1440


def test_a_bar_that_a_side_has_twice_is_refused(spark):
    side = spark.createDataFrame([("P", START, 1.0, 1.0, 1.0, 1.0)] * 2, "pair string, ts timestamp_ntz, open double, high double, low double, close double")
    assert bars.merge_sides(side, side.limit(1)).count() == 2
    with pytest.raises(ValueError):
        bars.merge_sides(side, side.limit(1), one_to_one=True)


def test_quality_as_text(spark):
    rng = np.random.default_rng(2)
    rows = mids(rng, 10, 1) + mids(rng, 10, 1, start=START + dt.timedelta(hours=10))
    f = frame(spark, rows)
    text = bars.format_quality(bars.quality_summary(f).first(), bars.active_gap_samples(f).collect(), "P")
    assert "20 bars" in text and "active 1 (largest 591 min)" in text and text.count("\n") == 2


def test_finite_rows_and_starts(spark):
    rows = [(START + dt.timedelta(hours=i), x, y) for i, (x, y) in enumerate([(None, 1.0), (float("nan"), 2.0), (float("inf"), 3.0), (1.0, None), (2.0, 4.0)])]
    f = spark.createDataFrame(rows, "ts timestamp_ntz, x double, y double")
    assert [r.ok for r in f.select("ts", bars.finite(["x", "y"]).alias("ok")).orderBy("ts").collect()] == [False, False, False, False, True]
    late = f.withColumn("z", F.lit(None).cast("double"))
    assert stats.usable_start(late, ["x", "y", "z"]) == (None, "z") and stats.usable_start(late, ["x", "y"]) == (START + dt.timedelta(hours=1), "x")
    d = {r.feature: r for r in stats.describe(late, ["x", "y", "z"], {"y": F.col("x").isNull()}).collect()}
    assert (d["x"].n, d["x"].inf_share, d["x"].p50, d["x"].max) == (3, 0.2, 1.5, 2.0) and d["y"].guarded_share == 0.2 and d["z"].n == 0 and d["z"].p50 is None


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=501), 1)
    f = spark.createDataFrame([(START, float(v)) for v in x], "ts timestamp_ntz, x double")
    r = stats.describe(f, ["x"]).first()
    assert np.allclose([r.p1, r.p25, r.p50, r.p75, r.p99], np.quantile(x, [0.01, 0.25, 0.5, 0.75, 0.99]))
    assert stats.frame_median(f, "x") == pytest.approx(np.median(x)) and stats.frame_median(f.limit(0), "x") is None


def test_top_and_best(spark):
    f = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 5.0), ("c", 2, 9.0), ("d", 2, None)], "name string, k int, v double")
    assert [r.name for r in stats.top(f, "v", 3, ["name"]).collect()] == ["c", "a", "b"]
    assert sorted(r.name for r in stats.top(f, "v", 1, ["name"], ["k"]).collect()) == ["a", "c"]
    assert stats.best_eligible(f, "v", F.col("k") == 1, ["name"]).first().name == "a" and stats.best_eligible(f, "v", F.col("k") == 7, ["name"]).count() == 0


def test_composition_refuses_what_is_absent(spark):
    rng = np.random.default_rng(4)
    base = features.bollinger(features.recurrences(frame(spark, mids(rng, 60)), (9,)))
    with pytest.raises(KeyError):
        pipeline.with_higher_timeframes(base, {}, ["2h"], 1.0)
    with pytest.raises(KeyError):
        pipeline.with_excursions(base, {"2h": base.drop("bb_upper")}, ["2h"])
    made = pipeline.with_higher_timeframes(base, {"2h": base, "daily": strategies.reversion_signal(base)}, ["2h"], 1.0)
    assert set(pipeline.htf_columns(["2h"])) <= set(made.columns)
    assert set(pipeline.excursion_columns(["2h"])) <= set(pipeline.with_excursions(base, {"2h": base}, ["2h"], 2, 5).columns)
    assert set(pipeline.moment_columns((6,), 9)) <= set(features.moments(base, (6,), 9).columns)
    assert set(pipeline.label_columns([1.0])) <= set(labels.triple_barrier(base.withColumnRenamed("atr_14", "atr"), (1.0,), 3).columns)
    assert pipeline.column_name("frac_above", "4h") == "frac_above_20_4h" and pipeline.column_name("depth", "4h") == "depth_4h"


def test_label_job_checks_its_anchors(spark, tmp_path):
    rng = np.random.default_rng(5)
    minute = frame(spark, mids(rng, 300, 15), mids(rng, 300, 15, "Q"))
    ways = jobs.label_job(minute, features.recurrences(minute, (9,)), str(tmp_path), (1.0, 2.0), 8)
    whole = {r.k: r for r in ways["k"].collect()}
    assert set(whole) == {1.0, 2.0} and all(abs(r.up + r.down + r["none"] - 1) < 1e-12 for r in whole.values()) and whole[2.0].bars > whole[1.0].bars
    assert sum(r.n for r in ways["friday"].where("k = 1").collect()) == whole[1.0].n == sum(r.n for r in ways["gap"].where("k = 1").collect())
    spoiled = spark.read.parquet(f"{tmp_path}/labels").withColumn("anchor", F.col("anchor") + 1e-9)
    assert jobs.wrong_anchors(spoiled, minute).count() == 598


def test_split_job_takes_its_limit_from_training_rows(spark):
    rng = np.random.default_rng(6)
    rows = [("P", dt.datetime(2023, 1, 1) + dt.timedelta(hours=12 * i), int(rng.integers(-1, 2)), float(rng.gamma(2)), float(i)) for i in range(700)]
    f = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, label int, vol double, spread double")
    table, chosen = jobs.split_job(f, "label", "vol", "spread", rows[0][1], rows[-1][1], 5, 9, 0.3, 30, 2)
    held = table.collect()
    assert chosen["chunks"] == 6 and {r.chunk_id for r in held if r.split == "test"} == set(chosen["test"]) and len(chosen["test"]) == 2
    assert chosen["spread_max"] == np.median([r.spread for r in held if r.split == "train"])


def test_assembly_job_writes_both_tables(spark, tmp_path):
    base = spark.createDataFrame([("P", START + dt.timedelta(minutes=m), 2.0, 0.0, float(m)) for m in range(0, 120, 15)], "pair string, ts timestamp_ntz, bb_upper double, bb_lower double, x double")
    events = spark.createDataFrame([("P", START + dt.timedelta(minutes=m), 1.0, m // 30 * 1.0) for m in range(120)], "pair string, ts timestamp_ntz, anchor double, atr double")
    tables = jobs.assembly_job(events, base, {"30 minutes": base}, ["anchor"], str(tmp_path), ema_spans=(), windows=())
    assert spark.read.parquet(f"{tmp_path}/events").count() == 120 and spark.read.parquet(f"{tmp_path}/events_sampled").count() == 12
    assert {r.feature for r in tables["blocks"].collect()} >= {"x", "bb_pct_b"} and tables["freshness"].first().n == 120


def test_training_job_saves_models_that_load(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=400)
    rows = [("P", START + dt.timedelta(minutes=i), float(v), float(rng.normal()), int(np.sign(v)) if abs(v) > 0.4 else 0, ("train", "test")[i % 2], i % 4 == 0, i % 8 == 2) for i, v in enumerate(x)]
    f = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, a double, hour_sin double, label int, split string, is_fit boolean, is_val boolean")
    out = jobs.training_job(f, ["a", "hour_sin"], str(tmp_path), ["A_all", "D_no_time"], 2.0, rounds=12, depth=2, rate=0.3, least_hessian=1.0, gamma=0.0)
    assert out["D_no_time"]["columns"] == ["a"] and out["A_all"]["accuracy"] > 0.9 and out["A_all"]["macro_auc"] > 0.8
    assert out["A_all"]["importance"][0][0] == "a" and set(files.read_json(spark, f"{tmp_path}/models.json")) == {"A_all", "D_no_time"}
    again = model.ThreeClassModel.load(spark, f"{tmp_path}/A_all", ["a", "hour_sin"]).transform(f.where("split = 'test'"))
    assert stats.directional(again, "label", "p_up", "p_down", []).first().accuracy == out["A_all"]["accuracy"]
    with pytest.raises(ValueError):
        model.ThreeClassModel.load(spark, f"{tmp_path}/A_all", ["hour_sin", "a"])


def test_shuffling_keeps_every_value(spark):
    rows = [("P", START + dt.timedelta(minutes=i), float(i)) for i in range(500)]
    f = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, x double")
    found = model.shuffled(f, "x", ["pair", "ts"], 3).orderBy("ts").collect()
    assert sorted(r.x for r in found) == [r[2] for r in rows] and sum(r.x == i for i, r in enumerate(found)) < 20
    plan = model.shuffled(f, "x", ["pair", "ts"], 3)._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(0" not in plan


def test_head_to_head_chooses_before_the_test(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        method, rule, period = ("m", "n")[i % 2], ("r1", "r2")[i // 2 % 2], ("train", "val", "test")[i // 4 % 3]
        gain = 3.0 if (method, rule) in (("m", "r2"), ("n", "r1")) and period != "test" else 0.0
        rows.append((method, rule, period, "P", START + dt.timedelta(days=i % 30, hours=3), float(rng.normal(gain, 1)), "signal"))
    trades = spark.createDataFrame(rows, "method string, rule string, period string, pair string, exit_ts timestamp_ntz, net_bps double, exit_reason string")
    days = spark.createDataFrame([("P", (START + dt.timedelta(days=k)).date()) for k in range(31)], "pair string, day date")
    tables = jobs.head_to_head(trades, days, {"m": (["train", "val"], "t", 50), "n": (["val"], "net_bps", 10)})
    assert {(r.method, r.rule) for r in tables["chosen"].collect()} == {("m", "r2"), ("n", "r1")}
    own = {m: [r[5] for r in rows if (r[0], r[1], r[2]) == (m, k, "test")] for m, k in (("m", "r2"), ("n", "r1"))}
    for r in tables["summary"].collect():
        x = own[r.method]
        assert r.trades == len(x) and np.isclose(r.net_bps, np.mean(x)) and np.isclose(r.t, np.mean(x) / (np.std(x, ddof=1) / len(x) ** 0.5))
    assert abs(tables["paired"].first().paired_t) < 4 and tables["daily"].count() == 62
    jobs.write_tables({k: tables[k] for k in ("chosen", "summary")}, str(tmp_path))
    assert files.read_json(spark, f"{tmp_path}/tables.json") == ["chosen", "summary"]
    with pytest.raises(ValueError):
        stats.binomial_se(0.5, -1)


def test_null_deviation_of_normal_moments():
    rng = np.random.default_rng(9)
    n = 40
    x = rng.normal(size=(20_000, n))
    d = x - x.mean(1, keepdims=True)
    m2, m3, m4 = ((d**k).mean(1) for k in (2, 3, 4))
    skew = m3 / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6)
    assert np.isclose(stats.null_sd("skew", n), skew.std(), rtol=0.03) and np.isclose(stats.null_sd("kurt", n), kurt.std(), rtol=0.05)
    low, high = stats.wald_interval(0.4, 50)
    assert np.isclose((high - low) / 2, 1.96 * np.sqrt(0.24 / 50))


def _random_walk(spark, n=500, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for pair in ("P", "Q"):
        at, x = START, 100.0
        for _ in range(n):
            at += dt.timedelta(minutes=int(rng.integers(1, 4)))
            x += float(rng.normal(0, 0.3))
            rows.append((pair, at, x, x + float(rng.random()), x - float(rng.random()), x + 0.1, None if rng.random() < 0.03 else 1.0))
    return spark.createDataFrame(rows, "pair string, ts timestamp_ntz, mid_open double, mid_high double, mid_low double, mid_close double, atr double").cache()


def test_labels_equal_a_scan_of_drawn_events(spark):
    frame, widths = _random_walk(spark), (1.0, 2.5)
    held = labels.triple_barrier(frame, widths, 240, slice_rows=90)
    assert held.where("label_1_0 is not null").count() > 400
    assert jobs.wrong_labels(held, frame, widths, 240, 150).count() == 0
    broken = held.withColumn("bars_2_5", F.col("bars_2_5") + 1)
    found = jobs.wrong_labels(broken, frame, widths, 240, 30).collect()
    assert len(found) == 30 and {r.k for r in found} == {2.5} and all(r.bars == r.scan_bars + 1 for r in found)


def test_gates_know_no_spread_of_the_test(spark):
    """The limit is the median of the training rows' spreads, and a gate is seen once its bar has closed."""
    rows = [("P", dt.datetime(2023, 1, 1) + dt.timedelta(days=i), (-1, 0, 1)[i % 3], float(i % 9), float(i) / 10000) for i in range(540)]
    frame = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, label int, vol double, spread double").withColumn("gate_stack", F.lit(True))
    bars = spark.createDataFrame(
        [("P", dt.datetime(2023, 1, 1) + dt.timedelta(hours=12 * i), 1.0, 1.5, 3.0, 2.0, 20.0, float(i) / 20000) for i in range(1080)],
        "pair string, ts timestamp_ntz, mid_close double, bb_lower double, bb_upper double, bb_middle double, rsi_14 double, spread_close double",
    )
    table, chosen = jobs.split_job(frame, "label", "vol", "spread", dt.datetime(2023, 1, 1), dt.datetime(2024, 6, 20), 5, 5, 0.3, 20, gates=bars, gate_tf="12 hours")
    spreads = {r.ts: r.spread_close for r in bars.collect()}
    for r in table.collect():
        seen = spreads.get(r.ts - dt.timedelta(hours=12))
        assert r.gate_stack == (seen is not None and seen < chosen["spread_max"])
    assert 0 < table.where("gate_stack").count() < table.count() == 540


def test_closes_and_clock_changes(spark):
    """The week of the change of March 2024: one daily session is 23 hours, and rows there see the last closed session."""
    hours = [dt.datetime(2024, 3, 4) + dt.timedelta(hours=h) for h in range(24 * 14)]
    frame = spark.createDataFrame([("P", h) for h in hours], "pair string, ts timestamp_ntz")
    sessions = frame.select("pair", calendar.session_label(calendar.session_key(F.col("ts"), "daily")).alias("ts")).distinct()
    (found,) = jobs.close_convention(sessions, "daily").collect()
    assert (found.off_width, found.shortest, found.longest) == (1, 23.0, 24.0)
    (checked,) = jobs.clock_change_check(frame, sessions, "daily").collect()
    assert checked.near == 144 and checked.wrong == 0
    (calm,) = jobs.clock_change_check(frame, sessions, "daily", 0).collect() or [None]
    assert calm is None or calm.near <= 1
