import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import ranks, split, stats, training
from tidewright.operators.ranks import place_among, quantiles, running, set_medians


@pytest.fixture
def many_ranges(monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 7)


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(np.round(x, 1)), bool(x > 0.3)) for x in rng.normal(size=300)] + [("b", float(x), bool(rng.random() < 0.5)) for x in rng.lognormal(0, 4, 90)]
    rows += [("c", 1.0, True)] * 40 + [("c", 1.0, False)] * 9 + [(None, 2.0, True), (None, -3.0, False)]
    return spark.createDataFrame(rows, "k string, x double, up boolean").cache()


def test_places_among_cuts(spark):
    cuts = [float(c) for c in range(0, 50, 3)]
    rows = spark.createDataFrame([(x / 2,) for x in range(-4, 120)] + [(None,)], "x double")
    for r in rows.select("x", place_among(F.col("x"), cuts).alias("n")).collect():
        assert r.n == (0 if r.x is None else sum(c <= r.x for c in cuts))


def test_running_counts_equal_a_loop(spark, values, many_ranges):
    counts = values.groupBy("k", "x").agg(F.count("*").alias("n"))
    held = counts.collect()
    assert len(ranks.range_cuts(counts, "x")) > 5
    found = running(counts, ["k"], "x", ["n"]).collect()
    assert len(found) == len(held)
    for r in found:
        assert r.upto_n == sum(h.n for h in held if h.k == r.k and h.x <= r.x)


def test_quantiles_and_auc_equal_numpy(spark, values, many_ranges):
    got = {r.k: r for r in quantiles(values, ["k"], "x", {"q1": 0.01, "half": 0.5, "q9": 0.9}).collect()}
    areas = {r.k: r.auc for r in stats.auc(values, "x", F.col("up"), ["k"]).collect()}
    for k in ("a", "b", "c", None):
        own = [(r.x, r.up) for r in values.collect() if r.k == k]
        x = np.array([v for v, _ in own])
        assert [got[k].q1, got[k].half, got[k].q9] == pytest.approx(np.quantile(x, [0.01, 0.5, 0.9]))
        won = [(a > b) + (a == b) / 2 for a, up in own if up for b, low in own if not low]
        assert areas[k] == pytest.approx(np.mean(won))
    assert stats.frame_median(values, "x") == pytest.approx(np.median([r.x for r in values.collect()]))
    assert stats.frame_median(values.limit(0), "x") is None
    (whole,) = stats.auc(values, "x", F.col("up"), []).collect()
    assert 0 < whole.auc < 1


def test_medians_of_many_sets_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), float(x)) for c in range(12) for x in np.exp(rng.normal(c / 3, 3, int(rng.integers(1, 300)))).round(int(rng.integers(0, 12)))] + [(4, None), (5, float("nan"))]
    frame = spark.createDataFrame(rows, "m int, x double")
    counts = frame.groupBy("m", "x").agg(F.count("*").alias("n"))
    sets = [frozenset(rng.choice(12, int(rng.integers(1, 12)), replace=False).tolist()) for _ in range(60)] + [frozenset(), frozenset([99])]
    found = set_medians(counts, "m", "x", sets)
    for own, median in zip(sets, found):
        x = [v for m, v in rows if m in own and v is not None and not np.isnan(v)]
        assert median == (np.median(x) if x else None)
    assert set_medians(counts.limit(0), "m", "x", sets[:2]) == [None, None]


def test_balance_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 6), f"20{20 + i % 3}-{1 + i % 12:02d}-05", int(rng.integers(-1, 2)), float(rng.normal() ** 2)) for i in range(500)]
    frame = spark.createDataFrame(rows, "chunk_id int, day string, label int, vol double").withColumn("ts", F.col("day").cast("timestamp_ntz"))
    candidates = split.draw_candidates(6, 2, 9, 1)
    for r in training.balance(frame, candidates, "label", "vol").collect():
        a, b = (np.median([x[3] for x in rows if (x[0] in r.held) == side]) for side in (True, False))
        assert r.vol_rel_div == pytest.approx(abs(a - b) / b)
