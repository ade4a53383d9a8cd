import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import calendar
from tidewright.operators import features, folds
from tidewright.operators.asof import asof

START = dt.datetime(2024, 1, 2)


def frame(spark, columns: dict, step=60):
    n = len(next(iter(columns.values())))
    rows = [("P", START + dt.timedelta(seconds=step * i), *[None if v[i] is None else float(v[i]) for v in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "pair string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in columns))


def column(df, name):
    return [r[0] for r in df.orderBy("ts").select(name).collect()]


def walk(rng, n):
    close = 50 * np.exp(np.cumsum(rng.normal(0, 3e-3, n)))
    opened = np.concatenate([[50.0], close[:-1]])
    return opened, np.maximum(opened, close) + rng.random(n) * 0.2, np.minimum(opened, close) - rng.random(n) * 0.2, close


def smoothed(x, start, period):
    """Mean of ``period`` values from ``start`` on, then a step of 1 / period towards each next one."""
    out, value = [np.nan] * len(x), None
    for i in range(start + period - 1, len(x)):
        value = float(np.mean(x[start : start + period])) if value is None else value + (x[i] - value) / period
        out[i] = value
    return out


def test_recurrences_equal_loops():
    rng = np.random.default_rng(61)
    for n, period in ((60, 14), (40, 2), (200, 5)):
        _, high, low, close = walk(rng, n)
        value, means = close[0], []
        for x in close:
            value = value + (x - value) * 2 / (period + 1)
            means.append(value)
        assert np.allclose(folds.ema(close, folds.span(period)), means)
        rise = [np.nan, *(max(b - a, 0) for a, b in zip(close, close[1:]))]
        fall = [np.nan, *(max(a - b, 0) for a, b in zip(close, close[1:]))]
        up, down = smoothed(rise, 1, period), smoothed(fall, 1, period)
        strength = [100 * u / (u + d) if u == u and u + d else np.nan for u, d in zip(up, down)]
        assert np.allclose(folds.rsi(close, period), strength, equal_nan=True)
        true = [high[0] - low[0], *(max(high[i], close[i - 1]) - min(low[i], close[i - 1]) for i in range(1, n))]
        value, ranges = true[0], []
        for x in true:
            value = value + (x - value) / period
            ranges.append(value)
        assert np.allclose(folds.atr(high, low, close, period), ranges)
        plus, minus = [0.0], [0.0]
        for i in range(1, n):
            a, b = high[i] - high[i - 1], low[i - 1] - low[i]
            plus.append(a if a > b and a > 0 else 0.0)
            minus.append(b if b > a and b > 0 else 0.0)
        size, p, m = (smoothed(x, 1, period) for x in (true, plus, minus))
        points = [100 * abs(x - y) / (x + y) if x == x and x + y else 0.0 for x, y in zip(p, m)]
        out = folds.adx(high, low, close, period)
        assert np.allclose(out["plus_di"], [100 * x / z for x, z in zip(p, size)], equal_nan=True)
        assert np.allclose(out["adx"], smoothed(points, period, period), equal_nan=True)


def test_recurrences_over_pieces_of_time(spark, monkeypatch):
    monkeypatch.setattr(folds, "PIECE_ROWS", 500)
    rng = np.random.default_rng(66)
    opened, high, low, close = walk(rng, 4000)
    f = frame(spark, {"mid_high": high, "mid_low": low, "mid_close": close, "x": np.round(close, 1)}, step=86_400)
    pieces = folds.in_pieces(f, ("pair",), 300)
    assert pieces.select("_piece").distinct().count() > 4 and pieces.where("_own").count() == 4000
    assert pieces.groupBy("_piece").agg(F.count_if(~F.col("_own")).alias("n")).where("_piece > 0 and n < 300").count() == 0
    one, several = (features.rolling_rank(features.recurrences(f, (9, 12), 5, (5, 2), 5, p), "x", 70, "rank", p).orderBy("ts").collect() for p in (False, True))
    assert len(several) == 4000
    for a, b in zip(one, several):
        assert all(x == y or (x is not None and y is not None and abs(x - y) <= 1e-9 * max(1, abs(x))) for x, y in zip(a[2:], b[2:])), (a, b)


def test_channels_and_candles_equal_loops(spark):
    rng = np.random.default_rng(62)
    opened, high, low, close = walk(rng, 70)
    f = frame(spark, {"mid_open": opened, "mid_high": high, "mid_low": low, "mid_close": close})
    d = features.donchian(f, (7,))
    assert column(d, "donchian_high_7") == [max(high[i - 7 : i]) if i >= 7 else None for i in range(70)]
    assert column(d, "donchian_low_7") == [min(low[i - 7 : i]) if i >= 7 else None for i in range(70)]
    c = features.candles(f)
    top, bottom = high - np.maximum(opened, close), np.minimum(opened, close) - low
    assert np.allclose(column(c, "upper_wick"), top) and np.allclose(column(c, "wick_imbalance"), (top - bottom) / (high - low))


def crossings(position, cap, window):
    """Excursions of one series by looking back from each row."""
    out = []
    for i, p in enumerate(position):
        if p is None:
            out.append((None,) * 6)
            continue
        side = lambda v: None if v is None else 1 if v > 1 else -1 if v < 0 else 0
        first = i
        while first and side(position[first - 1]) == side(p):
            first -= 1
        since = None
        for j in range(i, 0, -1):
            if position[j] is None or position[j - 1] is None:
                break
            if side(position[j]) and not side(position[j - 1]):
                since = i - j + 1
                break
        run = min(i - first + 1, cap)
        depth = max(abs(v - 0.5) for v in position[first : i + 1]) if side(p) else 0.0
        seen = position[i - window + 1 : i + 1] if i >= window - 1 else []
        whole = len(seen) == window and None not in seen
        shares = [sum(side(v) == k for v in seen) / window if whole else None for k in (1, -1)]
        out.append((run if side(p) == 1 else 0, run if side(p) == -1 else 0, depth, since, *shares))
    return out


def test_excursions_equal_a_look_back(spark):
    rng = np.random.default_rng(63)
    value = 0.5 + np.cumsum(rng.normal(0, 0.35, 300)) % 2.4 - 0.9
    position = [None if rng.random() < 0.04 else float(v) for v in value]
    f = features.excursion(frame(spark, {"bb_position": position}), cap=4, window=9).orderBy("ts")
    found = [tuple(r) for r in f.select("run_above", "run_below", "depth", "since_crossing", "frac_above", "frac_below").collect()]
    for a, b in zip(found, crossings(position, 4, 9)):
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b)), (a, b)


def test_trailing_z_and_rank_equal_loops_at_any_window(spark):
    rng = np.random.default_rng(64)
    x = np.round(np.cumsum(rng.normal(0, 1, 260)), 1) + 1e4
    x[100:140] = x[99]
    values = [None if i in (30, 31, 200) else float(v) for i, v in enumerate(x)]
    for window in (3, 20, 90):
        z = column(features.with_trailing_z(frame(spark, {"x": values}), F.col("x"), window, "z"), "z")
        rank = column(features.rolling_rank(frame(spark, {"x": values}), "x", window, "rank"), "rank")
        for i in range(260):
            seen = values[max(0, i - window + 1) : i + 1]
            if len(seen) < window or None in seen:
                assert z[i] is None and rank[i] is None
                continue
            sd = np.std(seen, ddof=1)
            assert (z[i] is None) if sd == 0 else abs(z[i] - (seen[-1] - np.mean(seen)) / sd) < 1e-6
            assert abs(rank[i] - (sum(v < seen[-1] for v in seen) + (sum(v == seen[-1] for v in seen) + 1) / 2) / window) < 1e-9


def test_bands_of_another_width(spark):
    rng = np.random.default_rng(65)
    f = features.bollinger(frame(spark, {"mid_close": rng.random(40)}), 10)
    narrow = features.rescale_bollinger(f, 0.5, "u", "l").where("bb_middle is not null").collect()
    assert len(narrow) == 31 and all(abs((r.u - r.bb_middle) - (r.bb_upper - r.bb_middle) / 4) < 1e-12 and abs(r.u + r.l - 2 * r.bb_middle) < 1e-12 for r in narrow)
    with pytest.raises(ValueError):
        features.rescale_bollinger(f, 0)


@pytest.mark.parametrize(
    "wall,label",
    [("2024-07-01 17:00:00", "2024-07-01 21:00:00"), ("2024-01-08 17:00:00", "2024-01-08 22:00:00")],
)
def test_session_labels_follow_the_clock_change(spark, wall, label):
    (r,) = spark.sql(f"select timestamp_ntz'{label}' t").select(calendar.session_label(calendar.session_key(F.col("t"), "daily")).alias("l"), calendar.to_wall(F.col("t")).alias("w")).collect()
    assert str(r.l) == label and str(r.w) == wall


@pytest.mark.parametrize("wall,hours", [("2024-03-09", 23), ("2024-11-02", 25), ("2024-07-01", 24)])
def test_session_length(spark, wall, hours):
    label = calendar.from_wall(F.expr(f"timestamp_ntz'{wall} 17:00:00'"))
    (r,) = spark.range(1).select((calendar.seconds_between(label, calendar.session_close(label, "daily")) / 3600).alias("h")).collect()
    assert r.h == hours


@pytest.mark.parametrize(
    "start,end,kind",
    [
        ("2024-01-05 21:59", "2024-01-07 22:00", "weekend"),
        ("2024-03-05 21:54", "2024-03-05 22:15", "daily_reset"),
        ("2024-03-13 20:54", "2024-03-13 21:15", "daily_reset"),
        ("2024-03-15 20:59", "2024-03-17 21:14", "weekend"),
        ("2024-03-04 09:29", "2024-03-04 10:00", "active"),
    ],
)
def test_gap_kinds(spark, start, end, kind):
    ntz = lambda t: F.expr(f"timestamp_ntz'{t}:00'")
    assert spark.range(1).select(calendar.gap_kind(ntz(start), ntz(end)).alias("k")).first().k == kind


def test_asof_sees_closed_bars_and_carries_nulls(spark):
    t = lambda s: dt.datetime.fromisoformat(f"2024-01-02 {s}")
    bars = spark.createDataFrame([("P", t("09:00"), 1.0), ("P", t("10:00"), None), ("P", t("11:00"), 3.0)], "pair string, ts timestamp_ntz, x double")
    target = spark.createDataFrame([("P", t(s)) for s in ("09:30", "09:59", "10:00", "10:37", "11:00", "12:00")], "pair string, ts timestamp_ntz")
    assert column(asof(target, bars, ["x"], "1 hour"), "x") == [None, None, 1.0, 1.0, None, 3.0]


def test_moments_are_of_finite_returns(spark):
    price = walk(np.random.default_rng(5), 90)[3]
    price[40] = 0.0
    found = features.moments(features.with_usual_step(frame(spark, {"mid_close": price})), (24,))
    returns = np.diff(np.log(price, where=price > 0, out=np.full(90, np.nan)), prepend=np.nan)
    down, skew = column(found, "semidev_down_24"), column(found, "ret_skew_24")
    for i in range(24, 90):
        own = returns[i - 23 : i + 1]
        own = own[~np.isnan(own)]
        assert down[i] == pytest.approx(1e4 * np.sqrt(np.mean(np.minimum(own, 0) ** 2))) and np.isfinite(skew[i])


def test_later_bars_change_nothing_before_them(spark):
    rng = np.random.default_rng(7)
    price = 1.1 * np.exp(np.cumsum(rng.normal(0, 1e-3, 160)))
    columns = {"mid_open": price, "mid_high": price * 1.001, "mid_low": price * 0.999, "mid_close": price, "spread_close": rng.random(160)}
    spoiled = {k: np.where(np.arange(160) >= 100, 9.99, v) for k, v in columns.items()}

    def build(c):
        f = frame(spark, c)
        for family in (features.returns, features.return_std, features.bollinger, lambda x: features.donchian(x, (60,)), features.spread_statistics, lambda x: features.moments(x, (24,))):
            f = family(f)
        return features.excursion(features.candles(features.recurrences(f)).withColumn("bb_position", features.band_position())).orderBy("ts").collect()

    a, b = build(columns), build(spoiled)
    assert a[:100] == b[:100] and a[100:] != b[100:]
