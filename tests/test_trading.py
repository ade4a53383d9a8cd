import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import bars, events, folds, labels, simulate, split, strategies
from tidewright.operators.simulate import AtrBarrier, Costs, Setup, simulate_arrays

START = dt.datetime(2024, 1, 2)


def market(rng, n):
    """Random bars with wicks and a spread."""
    close = 100 * np.exp(np.cumsum(rng.normal(0, 2e-3, n)))
    opened = np.concatenate([[100.0], close[:-1]]) * (1 + rng.normal(0, 1e-4, n))
    high = np.maximum(opened, close) * (1 + rng.random(n) * 2e-3)
    low = np.minimum(opened, close) * (1 - rng.random(n) * 2e-3)
    half = rng.random(n) * 0.02
    far = np.where(rng.random(n) < 0.1, np.nan, rng.random(n) * 0.6 - 0.05)
    return {"open_bid": opened - half, "open_ask": opened + half, "mid_open": opened, "mid_high": high, "mid_low": low, "mid_close": close, "profit": far, "stop": far * 0.7}


def replay(b, target, size, max_hold, costs):
    """The rules of the simulator once more, trade by trade, with a list of events for each bar."""
    trades, side, held_back, equity, cash = [], 0, None, [], 0.0

    def close(t, price, why):
        nonlocal side, cash
        fees = opened["fee"] + (costs.leg(price, size) if costs else 0)
        cash += side * (price - opened["price"]) * size - (costs.leg(price, size) if costs else 0)
        span = slice(opened["at"], max(t, opened["at"] + 1))
        low, high = b["mid_low"][span].min(), b["mid_high"][span].max()
        worst = max(0.0, opened["mid"] - low if side > 0 else high - opened["mid"])
        trades.append((side, opened["at"], opened["price"], t, price, side * (price - opened["price"]) * size, t - opened["at"], why, fees, worst))
        side = 0

    for t, wanted in enumerate(target):
        if held_back is not None and wanted != held_back:
            held_back = None
        goal = wanted if held_back is None else 0
        if side and goal != side:
            close(t, b["open_bid"][t] if side > 0 else b["open_ask"][t], "signal")
        if goal and not side:
            price = b["open_ask"][t] if goal > 0 else b["open_bid"][t]
            fee = costs.leg(price, size) if costs else 0
            cash -= fee
            side, opened = goal, {"at": t, "price": price, "mid": b["mid_open"][t], "fee": fee, "up": b["profit"][t], "down": b["stop"][t]}
        if side and max_hold is not None and t - opened["at"] >= max_hold:
            close(t, b["open_bid"][t] if side > 0 else b["open_ask"][t], "time_exit")
            held_back = wanted
        if side:
            half = (b["open_ask"][t] - b["open_bid"][t]) / 2
            against, along = (b["mid_low"][t], b["mid_high"][t]) if side > 0 else (b["mid_high"][t], b["mid_low"][t])
            stop, profit = opened["price"] - side * opened["down"], opened["price"] + side * opened["up"]
            if opened["down"] > 0 and side * (against - stop) <= 0:
                close(t, stop - side * half, "intrabar_sl")
                held_back = wanted
            elif opened["up"] > 0 and side * (along - profit) >= 0:
                close(t, profit - side * half, "intrabar_tp")
                held_back = wanted
        equity.append(cash + (side * (b["mid_close"][t] - opened["price"]) * size if side else 0.0))
    return equity, trades


@pytest.mark.parametrize("max_hold,costs,levels", [(None, None, False), (5, None, False), (None, Costs(), True), (4, Costs(), True)])
def test_simulator_equals_a_replay(max_hold, costs, levels):
    rng = np.random.default_rng(41)
    for _ in range(25):
        b = market(rng, 120)
        if not levels:
            b["profit"] = b["stop"] = np.full(120, np.nan)
        target = np.repeat(rng.integers(-1, 2, 40), 3)
        setup = Setup(notional=250.0, costs=costs, warmup=0, max_hold=max_hold)
        rows, trades = simulate_arrays(b, target, setup)
        equity, wanted = replay(b, target.tolist(), 250.0, max_hold, costs)
        assert np.allclose(rows[:, 0], equity)
        assert [(*t[:4], t[7]) for t in trades] == [(*w[:4], w[7]) for w in wanted]
        assert np.allclose([(t[4], t[5], t[9], t[10]) for t in trades], [(w[4], w[5], w[8], w[9]) for w in wanted])


def test_commission_is_a_rate_with_a_floor_and_a_cap():
    rng = np.random.default_rng(42)
    c = Costs(rate=3e-5, least=1.5, cap=0.001)
    for price, size in zip(rng.random(50) * 300 + 1e-3, 10 ** (rng.random(50) * 8)):
        value = price * size
        assert np.isclose(c.leg(price, size), min(0.001 * value, max(1.5, 3e-5 * value)))
    with pytest.raises(ValueError):
        c.leg(0, 1)


def test_level_policies_are_columns(spark):
    rng = np.random.default_rng(43)
    b = market(rng, 90)
    signal = np.repeat(rng.integers(-1, 2, 30), 3).tolist()
    rows = [("P", START + dt.timedelta(minutes=i), *(float(b[c][i]) for c in simulate._PRICES), int(signal[i]), float(0.1 + 0.1 * (i % 4))) for i in range(90)]
    frame = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in simulate._PRICES) + ", signal int, atr_decision double")
    setup = Setup(notional=10.0, costs=None, warmup=0, levels=AtrBarrier(1.5))
    found = simulate.simulate_trades(frame, setup).orderBy("exit_ts", "entry_ts").collect()
    b["profit"] = b["stop"] = 1.5 * np.array([0.1 + 0.1 * (i % 4) for i in range(90)])
    _, wanted = replay(b, [0, *signal[:-1]], 10.0, None, None)
    assert sorted((r.direction, r.exit_reason, round(r.pnl, 9)) for r in found) == sorted((w[0], w[7], round(w[5], 9)) for w in wanted)
    assert {"intrabar_sl", "intrabar_tp"} & {r.exit_reason for r in found}


def banded(spark, rng, n, pairs=("P", "Q")):
    rows = []
    for p in pairs:
        price = 50 + np.cumsum(rng.normal(0, 0.4, n))
        for i, x in enumerate(price):
            known = rng.random() > 0.05
            rows.append((p, START + dt.timedelta(minutes=i), float(x), *(float(v) if known else None for v in (51.0, 50.0, 49.0)), float(rng.random() * 100), int(rng.integers(0, 2))))
    return rows, spark.createDataFrame(rows, "pair string, ts timestamp_ntz, mid_close double, bb_upper double, bb_middle double, bb_lower double, rsi_14 double, regime_daily int")


def walk(rows, use_rsi, use_regime):
    """The band rule on one pair: what it holds after each bar."""
    holds, blocked, out = 0, 0, []
    for _, _, price, upper, middle, lower, rsi, regime in rows:
        if upper is None:
            holds = blocked = 0
        elif holds:
            if (price - middle) * holds >= 0:
                holds = blocked = 0
        else:
            touched = 1 if price <= lower else -1 if price >= upper else 0
            if not touched:
                blocked = 0
            elif touched != blocked and not (use_rsi and not (rsi <= 30 if touched > 0 else rsi >= 70)):
                if use_regime and regime == 0:
                    blocked = touched
                else:
                    holds = touched
        out.append(holds)
    return out


@pytest.mark.parametrize("use_rsi,use_regime", [(False, False), (True, False), (False, True), (True, True)])
def test_band_rule_equals_a_walk(spark, use_rsi, use_regime):
    rows, frame = banded(spark, np.random.default_rng(44), 400)
    rule = strategies.Reversion(use_rsi=use_rsi, use_regime=use_regime)
    found = {(r.pair, r.ts): r.signal for r in rule.generate_signals(frame).collect()}
    for p in ("P", "Q"):
        own = [r for r in rows if r[0] == p]
        assert [found[(p, r[1])] for r in own] == walk(own, use_rsi, use_regime)
    assert {-1, 0, 1} == set(found.values())


@pytest.mark.parametrize("rows", [50, 400])
def test_band_rule_over_pieces_of_time(spark, monkeypatch, rows):
    monkeypatch.setattr(folds, "PIECE_ROWS", rows)
    rng = np.random.default_rng(49)
    _, frame = banded(spark, rng, 1500)
    years = frame.withColumn("ts", F.expr("ts + make_dt_interval(cast(date_diff(minute, timestamp_ntz'2024-01-02', ts) as int) * 3)"))
    rule = strategies.Reversion(use_rsi=True, use_regime=True)
    one, several = ({(r.pair, r.ts): r.signal for r in strategies.reversion_signal(years, rule, pieces=p).collect()} for p in (False, True))
    assert one == several and folds.in_pieces(years, ("pair",), 0).select("_piece").distinct().count() > 3


def test_rules_out_of_order_are_refused():
    for wrong in ({"rsi_low": 80.0}, {"rsi_high": 120.0}, {"multiple": 0.0}, {"notional": -1.0}):
        with pytest.raises(ValueError):
            strategies.Reversion(**wrong)


def test_held_score_equals_a_loop(spark):
    rng = np.random.default_rng(45)
    score, valid = rng.normal(0, 1, 300), rng.random(300) > 0.2
    rows = [("P", START + dt.timedelta(minutes=i), float(score[i]), bool(valid[i])) for i in range(300)]
    frame = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, score double, valid boolean")
    found = [r.signal for r in strategies.HeldScore(1.2, 7).generate_signals(frame).orderBy("ts").collect()]
    wanted, until, sign = [], 0, 0
    for t in range(300):
        if t >= until and valid[t] and abs(score[t]) > 1.2:
            sign, until = int(np.sign(score[t])), t + 7
        wanted.append(sign if t < until else 0)
    assert found == wanted


def test_labels_equal_a_scan(spark):
    rng = np.random.default_rng(46)
    b = market(rng, 80)
    rows = [("P", START + dt.timedelta(minutes=i), *(float(b[f"mid_{c}"][i]) for c in ("open", "high", "low", "close")), None if i % 11 == 0 else float(0.2 + rng.random() * 0.4)) for i in range(80)]
    frame = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, mid_open double, mid_high double, mid_low double, mid_close double, atr double")
    found = labels.triple_barrier(frame, (1.5,), 6).orderBy("ts").collect()
    for i, r in enumerate(found):
        if i + 6 >= 80 or rows[i][6] is None:
            assert r.label_1_5 is None and not r.ambiguous_1_5
            continue
        anchor, far = rows[i + 1][2], 1.5 * rows[i][6]
        want = (0, 6, False)
        for k in range(1, 7):
            up, down = rows[i + k][3] >= anchor + far, rows[i + k][4] <= anchor - far
            if up or down:
                want = (-1 if down else 1, k, up and down)
                break
        assert (r.label_1_5, r.bars_1_5, r.ambiguous_1_5) == want


def test_spaced_samples_are_legal_and_evenly_drawn(spark):
    sizes = {k: 1 + k % 17 for k in range(400)}
    rows = [("P", START + dt.timedelta(minutes=1000 * k + i), k) for k, n in sizes.items() for i in range(n)]
    f = events.blocks(spark.createDataFrame(rows, "pair string, ts timestamp_ntz, key int"), "key")
    picked = {k: [] for k in sizes}
    for r in events.spaced_sample(f, 5).where("sampled_flag").collect():
        picked[r.key].append(r.event_offset)
    for k, n in sizes.items():
        assert len(picked[k]) == min(3, 1 + (n - 1) // 3) and all(0 <= o < n for o in picked[k])
        assert all(d >= 3 for d in np.diff(sorted(picked[k])))
    of_four = [picked[k][0] if len(picked[k]) == 1 else min(picked[k]) for k, n in sizes.items() if n == 5]
    assert len(set(of_four)) > 1


def test_purge_and_embargo_equal_a_scan(spark):
    rng = np.random.default_rng(47)
    chunk = np.sort(rng.integers(-1, 6, 120)).tolist()
    rows = [("P", START + dt.timedelta(minutes=i), c) for i, c in enumerate(chunk)]
    f = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, chunk_id int")
    found = [r.split for r in split.assign_splits(f, [1, 4], horizon=5, embargo=4).orderBy("ts").collect()]
    test = [c in (1, 4) for c in chunk]
    for i, c in enumerate(chunk):
        edge = any(chunk[j] >= 0 and chunk[j - 1] >= 0 and test[j] != test[j - 1] for j in range(max(1, i - 3), i + 1))
        want = "warmup" if c < 0 else "purged" if not test[i] and any(test[i + 1 : i + 6]) else "embargoed" if edge else "test" if test[i] else "train"
        assert found[i] == want


def test_chunks_drift_and_absorb():
    rng = np.random.default_rng(48)
    for _ in range(50):
        a = dt.datetime(2019, 1, 1) + dt.timedelta(days=int(rng.integers(0, 900)))
        z = a + dt.timedelta(days=int(rng.integers(100, 1500)))
        chunks = split.build_chunks(a, z, 3, 45)
        assert chunks[0][0] == a and chunks[-1][1] == z + dt.timedelta(minutes=1)
        assert all(x[1] == y[0] for x, y in zip(chunks, chunks[1:]))
        assert all(28 * 3 <= (y - x).days <= 93 for x, y in chunks[:-1]) and (z - chunks[-1][0]).days >= 45


@pytest.mark.parametrize("rows", [100_000, 40, 3])
def test_held_score_over_pieces_of_time(spark, monkeypatch, rows):
    """A hold that lasts over the end of a piece, or over whole pieces, is that of one walk."""
    monkeypatch.setattr(folds, "PIECE_ROWS", rows)
    rng = np.random.default_rng(31)
    data, wanted = [], {}
    for pair in "PQ":
        left, sign = 0, 0
        for i in range(260):
            ts = dt.datetime(2000, 1, 1) + dt.timedelta(days=23 * i)
            score, valid = (None if rng.random() < 0.05 else float(rng.normal())), bool(rng.random() < 0.9)
            if left == 0 and valid and score is not None and abs(score) > 1.2:
                left, sign = 16, int(np.sign(score))
            wanted[pair, ts] = sign if left else 0
            left = max(left - 1, 0)
            data.append((pair, ts, score, valid))
    frame = spark.createDataFrame(data, "pair string, ts timestamp_ntz, score double, valid boolean")
    found = {(r.pair, r.ts): r.signal for r in strategies.held_score_signal(frame, 1.2).collect()}
    assert found == wanted and {-1, 0, 1} == set(wanted.values())
    assert rows > 1000 or folds.in_pieces(frame, ("pair",), 0).select("_piece").distinct().count() > 4


def test_common_rows_and_numbers(spark):
    a = spark.createDataFrame([("P", 1), ("P", 2), ("P", 2), (None, 3)], "pair string, ts int")
    b = spark.createDataFrame([("P", 2, "1.5", True), (None, 3, "x", None), ("Q", 1, None, False)], "pair string, ts int, t string, f boolean")
    assert sorted(map(tuple, bars.common_rows([a, b]).collect()), key=str) == [("P", 2), (None, 3)] and bars.common_columns([b, a]) == ["pair", "ts"]
    assert [tuple(r)[2:] for r in bars.numeric_view(b, ["t", "f"]).orderBy(F.col("ts").desc()).collect()] == [(None, None), (1.5, 1.0), (None, 0.0)]
    with pytest.raises(KeyError):
        bars.numeric_view(a, ["t"])
