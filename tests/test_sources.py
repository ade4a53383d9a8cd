import datetime as dt
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright import importer, report, settings
from tidewright.sources import barstore, featurestore, files
from tidewright.sources.synthetic import synthetic_bars
from tidewright.streaming.bars import upsert_bars

START = dt.datetime(2024, 1, 2)


def bars(n, start=0, price=1.0):
    return [(START + dt.timedelta(days=20 * i), price, price, price, price, -1.0) for i in range(start, start + n)]


@pytest.mark.parametrize(
    "written,zone,utc",
    [
        ("2024-07-01 17:00:00", "America/New_York", dt.datetime(2024, 7, 1, 21)),
        ("2024-07-01T17:00:00Z", "America/New_York", dt.datetime(2024, 7, 1, 17)),
        ("2024-07-01 17:00:00+02:00", "America/New_York", dt.datetime(2024, 7, 1, 15)),
        ("2024-01-10", "UTC", dt.datetime(2024, 1, 10)),
    ],
)
def test_only_times_without_a_zone_are_shifted(spark, tmp_path, written, zone, utc):
    (tmp_path / "a.csv").write_text(f" Time ,OPEN,High,low,close\n{written},1,2,0.5,1.5\n")
    assert barstore.import_bars(spark, str(tmp_path / "a.csv"), zone).first().timestamp == utc


def test_parquet_instants_are_not_shifted(spark, tmp_path):
    prices = [F.lit(float(v)).alias(c) for c, v in (("open", 1), ("high", 2), ("low", 0.5), ("close", 1.5))]
    one = spark.range(1)
    one.select(F.timestamp_seconds(F.lit(1719853200)).alias("date"), *prices).write.parquet(str(tmp_path / "a.parquet"))
    one.select(F.lit("2024-07-01 17:00:00").cast("timestamp_ntz").alias("date"), *prices).write.parquet(str(tmp_path / "b.parquet"))
    read = lambda name: barstore.import_bars(spark, str(tmp_path / name), "America/New_York").first().timestamp
    assert read("a.parquet") == dt.datetime(2024, 7, 1, 17) and read("b.parquet") == dt.datetime(2024, 7, 1, 21)


def test_an_append_is_one_manifest(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, barstore.BARS)
    store = barstore.BarStore(spark, str(tmp_path), "eurusd", "bid")
    assert store.append(frame(bars(10))) == 10
    before = store.read_all()
    assert store.append(frame(bars(10, 5, 2.0))) == 5
    assert sorted(r.close for r in before.collect()) == [1.0] * 10  # who read before the append still does
    assert store.timestamp_range() == (START, START + dt.timedelta(days=280)) and store.row_count() == 15
    store.vacuum()
    assert sorted(r.close for r in store.read_all().collect()) == [1.0] * 5 + [2.0] * 10
    store.overwrite(frame(bars(2, 0, 3.0) + bars(1, 0, 4.0)))
    assert sorted(r.close for r in store.read_all().collect()) == [3.0, 4.0]
    assert barstore.BarStore(spark, str(tmp_path), "none", "bid").timestamp_range() == (None, None)


def test_the_import_entry_fills_the_store(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,open,high,low,close\n2024-07-01 17:00:00,1,2,0.5,1.5\n2024-07-01 17:01:00,1,2,0.5,1.5\n")
    for side in ("bid", "ask"):
        assert importer.main([str(tmp_path / "a.csv"), "eurusd", side, "--root", str(tmp_path / "store")], spark) == 2
    assert importer.main([str(tmp_path / "a.csv"), "eurusd", "bid", "--root", str(tmp_path / "store")], spark) == 0
    assert barstore.stored_pairs(spark, str(tmp_path / "store")) == ["EURUSD"]


def test_features_are_replaced_by_pair_and_read_by_column(spark, tmp_path):
    frame = lambda pair, x: spark.createDataFrame([(pair, START, x, 2.0)], "pair string, ts timestamp_ntz, x double, y double")
    for pair, x in (("a", 1.0), ("b", 5.0), ("a", 3.0)):
        featurestore.write_features(frame(pair, x), str(tmp_path), "1h")
    held = featurestore.read_features(spark, str(tmp_path), "1h", ["x"])
    assert held.columns == ["pair", "ts", "x"] and sorted((r.pair, r.x) for r in held.collect()) == [("A", 3.0), ("B", 5.0)]
    assert "y:double" not in held._jdf.queryExecution().executedPlan().toString()
    assert featurestore.read_features(spark, str(tmp_path), "1h", pairs=["b"]).count() == 1
    assert list(featurestore.read_timeframes(spark, str(tmp_path), ("1h",))) == ["1h"]


def test_events_and_their_sample(spark, tmp_path):
    events = spark.range(10).select(F.lit("P").alias("pair"), "id", (F.col("id") % 3 == 0).alias("sampled_flag"))
    featurestore.write_events(events, str(tmp_path))
    counts = [spark.read.parquet(f"{tmp_path}/{name}").count() for name in ("events", "events_sampled")]
    assert counts == [10, 4]


def test_json_csv_and_text(spark, tmp_path):
    value = {"at": START, "n": [1, 2.5, None], "name": "é"}
    files.write_json(spark, f"{tmp_path}/a.json", value)
    files.write_json(spark, f"{tmp_path}/a.json", value)
    assert files.read_json(spark, f"{tmp_path}/a.json") == {"at": "2024-01-02T00:00:00", "n": [1, 2.5, None], "name": "é"}
    files.write_csv(spark.createDataFrame([(1 / 3, "x")], "a double, b string"), f"{tmp_path}/c", 3)
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/c", header=True).collect()] == [("0.333", "x")]
    assert files.listing(spark, f"{tmp_path}/none") == []


def test_synthetic_bars_are_on_weekdays_and_repeatable(spark):
    rows = synthetic_bars(spark, 600, 3).collect()
    assert len(rows) == 600 and all(r.ts.weekday() < 5 for r in rows) and rows == synthetic_bars(spark, 600, 3).collect()
    assert all(abs(r.open_ask - r.open_bid - 1e-4) < 1e-12 and r.high_bid >= max(r.open_bid, r.close_bid) >= min(r.open_bid, r.close_bid) >= r.low_bid for r in rows)


def test_settings_and_logging(monkeypatch, tmp_path):
    monkeypatch.setenv("TIDEWRIGHT_ROOT", "/data/x/")
    monkeypatch.setenv("TIDEWRIGHT_LOG_LEVEL", "debug")
    settings.get_settings.cache_clear()
    assert settings.get_settings() == settings.Settings("/data/x/", "DEBUG") and settings.get_settings().path("bars", "1h") == "/data/x/bars/1h"
    assert settings.setup_logging().level == logging.DEBUG and len(settings.setup_logging().handlers) == 1
    monkeypatch.setenv("TIDEWRIGHT_LOG_LEVEL", "loud")
    settings.get_settings.cache_clear()
    with pytest.raises(ValueError):
        settings.get_settings()
    settings.get_settings.cache_clear()
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "pyproject.toml").write_text("")
    assert settings.project_root(tmp_path / "a" / "b") == str(tmp_path)


def test_report_says_what_is_not_known():
    assert (report.number(None), report.percent(float("nan")), report.number(1234.5), report.percent(0.1234, 1)) == ("n/a", "n/a", "1,234.50", "12.3 %")
    rng = np.random.default_rng(1)
    names = "total_pnl return_pct_of_notional annualized_pnl annualized_return_pct sharpe max_drawdown max_drawdown_pct_of_notional win_rate avg_bars_held avg_trade_pnl median_trade_pnl cum_spread_cost cum_commission".split()
    row = dict(zip(names, rng.random(len(names)).tolist())) | {"n_trades": 7, "costs_pct_abs": None, "pair": "P"}
    text = report.format_metrics(row)
    assert text.startswith("P\n") and "7, " in text and "n/a of the result" in text


def test_streamed_bars_are_upserted(spark, tmp_path):
    rows = [("P", START + dt.timedelta(minutes=i % 3), 1.0 + i, 2.0 + i, 0.5, 1.5) for i in range(5)]
    schema = "pair string, ts timestamp, open double, high double, low double, close double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = upsert_bars(stream, str(tmp_path / "store")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    held = barstore.BarStore(spark, str(tmp_path / "store"), "P", "mid").read_all().orderBy("timestamp").collect()
    assert [r.open for r in held] == [4.0, 5.0, 3.0]


def _minute_bars(spark, month, minutes, price):
    rows = [(dt.datetime(2024, month, 1) + dt.timedelta(minutes=m), price, price, price, price, 1.0) for m in minutes]
    return spark.createDataFrame(rows, barstore.BARS)


def test_appends_at_once_are_both_held(spark, tmp_path, monkeypatch):
    """A second writer commits between the first one's reading and its commit, to the same and to another month."""
    store = barstore.BarStore(spark, str(tmp_path), "EURUSD", "bid")
    store.overwrite(_minute_bars(spark, 1, range(5), 1.0))
    other, commit, late = barstore.BarStore(spark, str(tmp_path), "EURUSD", "bid"), barstore.BarStore._commit, []

    def commit_late(self, read, months):
        if self is store and not late:
            late.append(True)
            assert other.append(_minute_bars(spark, 1, range(3, 8), 2.0)) == 3 and other.append(_minute_bars(spark, 2, range(2), 3.0)) == 2
        return commit(self, read, months)

    monkeypatch.setattr(barstore.BarStore, "_commit", commit_late)
    assert store.append(_minute_bars(spark, 1, [7, 9], 4.0)) == 1
    found = {(r.timestamp.month, r.timestamp.minute): r.open for r in store.read_all().collect()}
    assert found == {(1, 0): 1.0, (1, 1): 1.0, (1, 2): 1.0, (1, 3): 2.0, (1, 4): 2.0, (1, 5): 2.0, (1, 6): 2.0, (1, 7): 4.0, (1, 9): 4.0, (2, 0): 3.0, (2, 1): 3.0}
    assert store.row_count() == 11 and len(store._manifests()) == 4
    store.vacuum()
    assert store.read_all().count() == 11


def test_writers_in_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(k):
        return barstore.BarStore(spark, str(tmp_path), "EURUSD", "ask").append(_minute_bars(spark, 1 + k % 2, range(10 * k, 10 * k + 10), float(k)))

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(write, range(4))) == [10] * 4
    store = barstore.BarStore(spark, str(tmp_path), "EURUSD", "ask")
    assert store.read_all().count() == store.row_count() == 40


def test_a_file_is_created_once_and_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/held.json"
    assert files.create_text(spark, path, "one") and not files.create_text(spark, path, "two") and files.read_text(spark, path) == "one"
    files.write_text(spark, path, "three")
    assert files.read_text(spark, path) == "three" and not [n for n in files.listing(spark, str(tmp_path)) if "draft" in n]
