import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import model, stats
from tidewright.sources import barstore
from tidewright.streaming import bars as streaming

START = dt.datetime(2024, 1, 2)


def scored(rng, n=240):
    rows = []
    for _ in range(n):
        up, flat = rng.random(2) * 0.5
        rows.append((int(rng.integers(-1, 2)), round(float(up), 1), round(float(flat), 1), round(float(1 - up - flat), 1), "ab"[rng.integers(0, 2)]))
    return rows


def area(rows, of, positive):
    wins = [1.0 if of(x) > of(y) else 0.5 if of(x) == of(y) else 0.0 for x in rows if positive(x) for y in rows if not positive(y)]
    return sum(wins) / len(wins)


def test_areas_equal_all_pairs(spark):
    rows = scored(np.random.default_rng(71))
    f = spark.createDataFrame(rows, "y int, up double, flat double, down double, k string")
    for r in stats.auc(f, "up", F.col("y") == 1, ["k"]).collect():
        assert np.isclose(r.auc, area([x for x in rows if x[4] == r.k], lambda x: x[1], lambda x: x[0] == 1))
    macro = stats.macro_auc(f, "y", {-1: "down", 0: "flat", 1: "up"}, []).first()
    assert np.isclose(macro.macro_auc, np.mean([area(rows, lambda x, c=c: x[c], lambda x, k=k: x[0] == k) for k, c in ((-1, 3), (0, 2), (1, 1))])) and macro.classes == 3
    one_sided = stats.macro_auc(f.where("y = 1"), "y", {-1: "down", 1: "up"}, []).first()
    assert one_sided.macro_auc is None and one_sided.classes == 0


def test_class_weights_even_the_classes(spark):
    counts = {-1: 40, 0: 7, 1: 113}
    w = spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "y int")
    rows = stats.class_weights(w, "y", []).collect()
    assert {r.y: r.n for r in rows} == counts and np.allclose([r.n * r.weight for r in rows], sum(counts.values()) / 3)


def test_confusion_precision_and_direction(spark):
    rng = np.random.default_rng(73)
    rows = [(*r, int(rng.integers(-1, 2))) for r in scored(rng)]
    f = spark.createDataFrame(rows, "y int, up double, flat double, down double, k string, p int")
    found = {r["class"]: (r.precision, r.recall) for r in stats.precision_recall(f, "y", "p", [-1, 0, 1]).collect()}
    for k in (-1, 0, 1):
        hit = sum(r[0] == k == r[5] for r in rows)
        assert np.allclose(found[k], (hit / sum(r[5] == k for r in rows), hit / sum(r[0] == k for r in rows)))
    touched = [r for r in rows if r[0]]
    right = np.mean([(1 if r[1] >= r[3] else -1) == r[0] for r in touched])
    r = stats.directional_statistics(f, "y", "up", "down", 3.0, []).first()
    ups = np.mean([x[0] == 1 for x in touched])
    assert r.n == len(touched) and np.isclose(r.accuracy, right) and np.isclose(r.base_rate, max(ups, 1 - ups))
    assert np.isclose(r.se, np.sqrt(right * (1 - right) / (len(touched) / 3))) and np.isclose(r.high - r.low, 2 * 1.96 * r.se)


def test_scalars():
    assert np.isclose(stats.normal_two_sided(1.959964), 0.05, atol=1e-6) and np.isclose(stats.z_against(0.6, 0.5, 100), 2)
    with pytest.raises(ValueError):
        stats.binomial_se(0.5, 0)


def bars(n, start=0, price=1.0):
    return [(START + dt.timedelta(days=20 * i), price, price, price, price, -1.0) for i in range(start, start + n)]


def test_upserts_keep_the_newest_and_other_months(spark, tmp_path):
    store = barstore.BarStore(spark, str(tmp_path), "eurusd", "BID")
    frame = lambda rows: spark.createDataFrame(rows, barstore.BARS)
    assert store.read_all().count() == 0 and store.append(frame(bars(10))) == 10 and store.append(frame(bars(10))) == 0
    assert store.append(frame(bars(10, 5, 2.0))) == 5 and store.row_count() == 15
    kept = [r.close for r in store.read_all().orderBy("timestamp").collect()]
    assert kept == [1.0] * 5 + [2.0] * 10 and store.timestamp_range()[0] == START
    with pytest.raises(KeyError):
        store.append(spark.range(1).toDF("timestamp"))


def test_imports(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Time ,OPEN,High,low,close\n2024-07-01 17:00:00,1,2,0.5,1.5\n")
    r = barstore.import_bars(spark, str(tmp_path / "a.csv"), "America/New_York").first()
    assert (r.timestamp, r.volume, r.high) == (dt.datetime(2024, 7, 1, 21), -1.0, 2.0)
    (tmp_path / "b.csv").write_text("date,open,high,low,close\n2024-07-01 17:00:00,1,0.5,0.5,1.5\n")
    with pytest.raises(ValueError):
        barstore.import_bars(spark, str(tmp_path / "b.csv"))


def test_model_learns_and_shuffling_its_column_hurts(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    rows = [("P", START + dt.timedelta(minutes=i), float(v), float(rng.normal()), int(np.sign(v)) if abs(v) > 0.4 else 0) for i, v in enumerate(x)]
    f = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, a double, b double, label int")
    m = model.ThreeClassModel(["a", "b"], depth=2, rounds=8, rate=0.3, least_hessian=1.0, gamma=0.0).fit(f)
    accuracy = lambda d: d.agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]
    out = m.transform(f)
    assert accuracy(out) > 0.9 and abs(out.selectExpr("max(abs(p_up + p_down + p_flat - 1))").first()[0]) < 1e-9
    each = lambda d: stats.accuracy(d, "label", "predicted", ["variant"])
    found = model.permutation_importance(m, f, each, repeats=2)
    drops = {r["column"]: (r["drop"], r["sd"]) for r in found.collect()}
    assert drops["a"][0] > 0.2 > drops["b"][0]
    # the same by hand: every variant's column dealt by its own bijection
    placed = model._numbered(f, F.xxhash64(F.lit(11), "pair", "ts"))
    for k, c in enumerate("ab"):
        by_hand = []
        for r in range(2):
            values = placed.select(model.permuted(F.col("_to"), 300, 12 + 2 * k + r).alias("_to"), F.col(c).alias("_dealt"))
            assert values.select("_to").distinct().count() == 300
            by_hand.append(accuracy(out) - accuracy(m.transform(placed.join(values, "_to").withColumn(c, F.col("_dealt")))))
        assert drops[c] == pytest.approx((np.mean(by_hand), np.std(by_hand)))


def test_stream_emits_each_closed_bar_once(spark, tmp_path):
    ticks = [("P", START + dt.timedelta(minutes=i), float(i)) for i in range(0, 200, 7)]
    spark.createDataFrame(ticks, "pair string, ts timestamp, mid double").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pair string, ts timestamp, mid double").parquet(str(tmp_path / "in"))
    q = streaming.stream_clock_bars(stream, "1 hour").writeStream.format("memory").queryName("hourly").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {r.ts: (r.open, r.high, r.low, r.close, r.n) for r in spark.table("hourly").collect()}
    assert found[START] == (0, 56, 0, 56, 9) and found[START + dt.timedelta(hours=1)][3] == 119 and START + dt.timedelta(hours=3) not in found


BANDS = "pair string, ts timestamp, mid_close double, bb_lower double, bb_middle double, bb_upper double"


@pytest.fixture
def rocksdb(spark):
    name, held = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, held)


def _stream_signals(spark, folder, parts, late):
    """Signals of files that arrive one after the other."""
    (folder / "in").mkdir()
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, BANDS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(BANDS).parquet(str(folder / "in"))
        q = streaming.stream_reversion(stream, late).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c"))
        q.outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    return {(r.pair, r.ts): r.signal for r in spark.read.parquet(str(folder / "out")).collect()}


def test_stream_signals_equal_the_batch_in_any_order_of_arrival(spark, tmp_path, rocksdb):
    rng = np.random.default_rng(74)
    bars, wanted = [], {}
    for pair in "PQ":
        held = 0
        for i, m in enumerate(50 + 2 * np.sin(np.arange(90) / 9) + rng.normal(0, 0.3, 90)):
            m = None if i in (17, 40) else float(m)
            held = 0 if m is None else (0 if held * (m - 50) >= 0 else held) if held else 1 if m <= 49 else -1 if m >= 51 else 0
            bars.append((pair, START + dt.timedelta(minutes=i), m, 49.0, 50.0, 51.0))
            wanted[pair, bars[-1][1]] = held
    # each bar is up to twenty minutes late, which the watermark allows
    order = sorted(bars, key=lambda r: r[1] + dt.timedelta(minutes=float(rng.uniform(0, 20))))
    parts = [order[i : i + 60] for i in range(0, len(order), 60)]
    flush = [(p, START + dt.timedelta(days=1), 50.0, 49.0, 50.0, 51.0) for p in "PQ"]
    found = _stream_signals(spark, tmp_path, [*parts, flush], "30 minutes")
    assert found == wanted and {-1, 0, 1} == set(wanted.values())


def test_a_bar_behind_the_watermark_changes_no_signal(spark, tmp_path, rocksdb):
    bar = lambda i, m: ("P", START + dt.timedelta(minutes=i), m, 49.0, 50.0, 51.0)
    found = _stream_signals(spark, tmp_path, [[bar(0, 48.0), bar(2, 49.5), bar(9, 49.5)], [bar(1, 55.0), bar(3, 49.6)], [bar(60, 50.0)]], "5 minutes")
    signals = {ts.minute: s for (_, ts), s in found.items()}
    assert signals == {0: 1, 2: 1, 9: 1}


def test_stream_of_sessions(spark, tmp_path):
    ticks = [("P", START + dt.timedelta(hours=5 * i), float(i)) for i in range(20)]
    spark.createDataFrame(ticks, "pair string, ts timestamp, mid double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pair string, ts timestamp, mid double").parquet(str(tmp_path / "in"))
    q = streaming.stream_session_bars(stream).writeStream.format("memory").queryName("sessions").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {r.session: (r.open, r.close, r.n) for r in spark.table("sessions").collect()}
    wanted = {}
    for _, ts, mid in ticks:
        wanted.setdefault((ts - dt.timedelta(hours=22)).date(), []).append(mid)
    assert [(v[0], v[-1], len(v)) for v in wanted.values()] == [found[k] for k in sorted(found)]
