"""Causal feature families of a bar frame: each is DataFrame -> DataFrame, and an undefined value is null.

Families of pure windows share one partition and order, so they need one sort. Log returns
and their deviations follow the arithmetic of doubles: prices of 0 and below make them infinite or NaN.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import calendar
from tidewright.functions.rolling import bar_number, full, ordered, prev, prior, ratio, trailing
from tidewright.operators import folds
from tidewright.operators.bars import finite
from tidewright.operators.slices import previous

EMA_SPANS = (9, 21, 50, 99, 200)
RETURNS = (1, 5, 15, 60)
DONCHIAN = (60, 180, 240, 360, 720, 1440)


def _null_nan(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def recurrences(bars: DataFrame, ema_spans=EMA_SPANS, atr_period=14, rsi_periods=(14, 2), adx_period=14, pieces: bool = False) -> DataFrame:
    """EMA and distance to it, MACD, ATR, RSI and ADX, in one pass over each pair; over its pieces of time for long histories (``bars`` is read twice then)."""
    macd = lambda c: folds.ema(c, folds.span(12)) - folds.ema(c, folds.span(26))
    signal = lambda c: folds.ema(macd(c), folds.span(9))
    of_close = {f"ema_{n}": (lambda c, n=n: folds.ema(c, folds.span(n))) for n in ema_spans}
    of_close |= {f"dist_ema_{n}": (lambda c, n=n: (c - folds.ema(c, folds.span(n))) / folds.ema(c, folds.span(n))) for n in ema_spans}
    of_close |= {"macd": macd, "macd_signal": signal, "macd_hist": lambda c: macd(c) - signal(c)}
    of_close |= {f"rsi_{n}": (lambda c, n=n: folds.rsi(c, n)) for n in rsi_periods}
    outputs = {name: (lambda h, low, c, f=f: f(c)) for name, f in of_close.items()}
    outputs[f"atr_{atr_period}"] = lambda h, low, c: folds.atr(h, low, c, atr_period)
    for name in ("plus_di", "minus_di", "adx", "di_spread"):
        outputs[f"{name}_{adx_period}"] = lambda h, low, c, name=name: folds.adx(h, low, c, adx_period)[name]
    slowest = max(*ema_spans, 26 + 9, 2 * atr_period, 2 * max(rsi_periods), 4 * adx_period)  # one smoother on another adds up
    return _null_nan(folds.fold(bars, ["mid_high", "mid_low", "mid_close"], outputs, lookback=40 * slowest if pieces else None), list(outputs))


def _ln(x: Column) -> Column:
    """The logarithm of a double: -inf of 0 and NaN below, where Spark's own is null."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def log_return(k: int = 1) -> Column:
    """-inf into a price of 0, inf out of one, NaN between two of them and at a price below; null only where a price is."""
    x = _ln(F.col("mid_close"))
    return x - prev(x, k)


def returns(bars: DataFrame) -> DataFrame:
    return bars.withColumns({f"log_ret_{k}": log_return(k) for k in RETURNS})


def return_std(bars: DataFrame, windows=(15, 60)) -> DataFrame:
    own = bars.withColumn("_r", log_return())
    r = F.col("_r")
    return own.withColumns({f"ret_std_{w}": full(F.stddev_samp(r).over(trailing(w)), r, w, trailing(w)) for w in windows}).drop("_r")


def bollinger(bars: DataFrame, window: int = 20, k: float = 2.0) -> DataFrame:
    c, frame = F.col("mid_close"), trailing(window)
    mid, spread = full(F.avg(c).over(frame), c, window, frame), full(F.stddev_samp(c).over(frame), c, window, frame)
    out = bars.withColumns({"bb_middle": mid, "_sd": spread})
    out = out.withColumns({"bb_upper": F.col("bb_middle") + k * F.col("_sd"), "bb_lower": F.col("bb_middle") - k * F.col("_sd")})
    return out.withColumn("bb_pct_b", ratio(c - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"))).drop("_sd")


def rescale_bollinger(frame: DataFrame, k: float, upper: str = "bb_upper", lower: str = "bb_lower") -> DataFrame:
    """Bands of k instead of 2 standard deviations around the same middle."""
    if k <= 0:
        raise ValueError("a width above 0")
    sd = (F.col("bb_upper") - F.col("bb_middle")) / 2
    return frame.withColumn("_sd", sd).withColumns({upper: F.col("bb_middle") + k * F.col("_sd"), lower: F.col("bb_middle") - k * F.col("_sd")}).drop("_sd")


def donchian(bars: DataFrame, windows=DONCHIAN) -> DataFrame:
    """Highest high and lowest low of the w bars before this one; a row costs the same whatever the window."""
    if min(windows) < 1:
        raise ValueError("a window of one bar at least")
    high = {f"donchian_high_{w}": (lambda h, low, w=w: folds.trailing_extreme(h, w, True)) for w in windows}
    low = {f"donchian_low_{w}": (lambda h, low, w=w: folds.trailing_extreme(low, w, False)) for w in windows}
    outputs = {name: own[name] for pair in zip(high, low) for name, own in zip(pair, (high, low))}
    return _null_nan(folds.fold(bars, ["mid_high", "mid_low"], outputs), list(outputs))


def donchian_position(frame: DataFrame, windows=DONCHIAN, price: str = "mid_close") -> DataFrame:
    low = lambda w: F.col(f"donchian_low_{w}")
    return frame.withColumns({f"donchian_pos_{w}": ratio(F.col(price) - low(w), F.col(f"donchian_high_{w}") - low(w)) for w in windows})


def candles(bars: DataFrame, window: int = 20) -> DataFrame:
    """Body, wicks and range, as they are, as parts of the range, in ATR and against the mean wick of the bars before."""
    o, h, low, c = (F.col(f"mid_{x}") for x in ("open", "high", "low", "close"))
    zero = F.lit(0.0)
    out = bars.withColumns(
        {"body": F.abs(c - o), "upper_wick": F.greatest(h - F.greatest(o, c), zero), "lower_wick": F.greatest(F.least(o, c) - low, zero), "bar_range": h - low}
    )
    for part in ("body", "upper_wick", "lower_wick"):
        out = out.withColumn(f"{part}_frac", ratio(F.col(part), F.col("bar_range")))
    out = out.withColumn("wick_imbalance", ratio(F.col("upper_wick") - F.col("lower_wick"), F.col("bar_range")))
    wicks = F.col("upper_wick") + F.col("lower_wick")
    usual = full(F.avg(wicks).over(prior(window)), wicks, window, prior(window))
    out = out.withColumn("_usual", usual)
    for part in ("upper_wick", "lower_wick"):
        if "atr_14" in bars.columns:
            out = out.withColumn(f"{part}_atr", ratio(F.col(part), F.col("atr_14")))
        out = out.withColumn(f"{part}_rel", F.when(F.col("_usual") > 0, F.col(part) / F.col("_usual")))
    return out.drop("_usual")


def spread_statistics(bars: DataFrame) -> DataFrame:
    s, out = F.col("spread_close"), {}
    for w in (15, 60):
        out[f"spread_mean_{w}"] = full(F.avg(s).over(trailing(w)), s, w, trailing(w))
        out[f"spread_ratio_{w}"] = ratio(s, out[f"spread_mean_{w}"])
    out["spread_z_60"] = ratio(s - out["spread_mean_60"], full(F.stddev_samp(s).over(trailing(60)), s, 60, trailing(60)))
    return bars.withColumns(out)


def clock(bars: DataFrame) -> DataFrame:
    """Hour and weekday on the circle, and which of three markets is open."""

    def open_in(zone: str, start: int, end: int) -> Column:
        wall = calendar.to_wall(F.col("ts"), zone)
        return ((F.weekday(wall) < 5) & (F.hour(wall) >= start) & (F.hour(wall) < end)).cast("tinyint")

    circle = 2 * F.pi()
    hour, day = F.hour("ts") / 24.0, F.weekday(F.col("ts")) / 7.0
    out = {"hour_sin": F.sin(circle * hour), "hour_cos": F.cos(circle * hour), "dow_sin": F.sin(circle * day), "dow_cos": F.cos(circle * day)}
    out |= {"session_tokyo": open_in("Asia/Tokyo", 9, 18), "session_london": open_in("Europe/London", 8, 17), "session_ny": open_in(calendar.NEW_YORK, 8, 17)}
    bars = bars.withColumns(out)
    return bars.withColumn("session_overlap", (F.col("session_london") * F.col("session_ny")).cast("tinyint"))


def with_usual_step(bars: DataFrame) -> DataFrame:
    """``bars`` with ``_usual``, the most frequent number of seconds between an instrument's rows (the least of equals)."""
    steps = previous(bars.select("pair", "ts"), {"_was": F.col("ts")}).withColumn("_step", calendar.seconds_between(F.col("_was"), F.col("ts")))
    usual = steps.where("_step is not null").groupBy("pair").agg(F.mode("_step", True).alias("_usual"))
    # one row for each instrument
    return bars.join(F.broadcast(usual), "pair", "left")


def masked_return(bars: DataFrame, name: str = "r") -> DataFrame:
    """Log returns of single steps of the usual length; steps over a gap have none. ``_usual`` is found here if the frame lacks it."""
    own = bars if "_usual" in bars.columns else with_usual_step(bars)
    stepped = own.withColumn("_step", calendar.seconds_between(prev("ts"), F.col("ts")))
    return stepped.withColumn(name, F.when(F.col("_step") <= F.col("_usual"), log_return())).drop("_step", "_usual")


def moments(bars: DataFrame, windows=(96, 24), z_window: int | None = None) -> DataFrame:
    """Bias-corrected skew and kurtosis, their octile twins, semi-deviations; from half a window of finite returns on, after w rows.

    The octiles are a fold whose sorted window slides; the rest are windows.
    """
    out = masked_return(bars, "_r").withColumn("_r", F.when(finite(["_r"]), F.col("_r"))).withColumn("_row", bar_number())
    r = F.col("_r")
    half = lambda w: max(4, -(-w // 2))
    octiles = {f"_e{k}_{w}": (lambda x, k=k, w=w: folds.trailing_quantile(x, w, half(w), k / 8)) for w in windows for k in range(1, 8)}
    out = _null_nan(folds.fold(out, ["_r"], octiles), list(octiles))
    for w in windows:
        frame, least = trailing(w), half(w)
        n, sd = F.count(r).over(frame), F.stddev_samp(r).over(frame)
        ready = (F.col("_row") > w) & (n >= least)
        g1, g2 = F.skewness(r).over(frame), F.kurtosis(r).over(frame)
        out = out.withColumns(
            {
                f"ret_skew_{w}": F.when(ready & (sd > 0), g1 * F.sqrt(n * (n - 1.0)) / (n - 2)),
                f"ret_kurt_{w}": F.when(ready & (sd > 0), (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * g2 + 6)),
                f"semidev_down_{w}": F.when(ready, 1e4 * F.sqrt(F.avg(F.when(r.isNotNull(), F.pow(F.least(r, F.lit(0.0)), F.lit(2)))).over(frame))),
                f"semidev_up_{w}": F.when(ready, 1e4 * F.sqrt(F.avg(F.when(r.isNotNull(), F.pow(F.greatest(r, F.lit(0.0)), F.lit(2)))).over(frame))),
            }
        )
        e = lambda k, w=w: F.when(F.col("_row") > w, F.col(f"_e{k}_{w}"))
        iqr = F.when(F.abs(e(6) - e(2)) > 1e-12, e(6) - e(2))
        out = out.withColumns(
            {
                f"bowley_skew_{w}": (e(6) + e(2) - 2 * e(4)) / iqr,
                f"moors_kurt_{w}": ((e(7) - e(5)) + (e(3) - e(1))) / iqr,
                f"semidev_ratio_{w}": ratio(F.col(f"semidev_down_{w}"), F.col(f"semidev_up_{w}")),
            }
        )
    if z_window:
        for w in windows:
            for a, b, name in ((f"ret_skew_{w}", f"bowley_skew_{w}", "skew"), (f"ret_kurt_{w}", f"moors_kurt_{w}", "kurt")):
                out = with_trailing_z(with_trailing_z(out, F.col(a), z_window, "_za"), F.col(b), z_window, "_zb")
                out = out.withColumn(f"{name}_divergence_{w}", F.col("_za") - F.col("_zb")).drop("_za", "_zb")
    return out.drop("_r", "_row", *octiles)


def with_trailing_z(frame: DataFrame, x: Column, window: int, name: str) -> DataFrame:
    """x against mean and deviation of ``window`` rows; undefined where one of them is, or none differ.

    Sums of the window are differences of running sums, so a row costs the same
    whatever the window; values count from the first one on, which keeps digits. What
    is lost grows with the squared distance from there: a series that moves by more than
    a million of its deviations needs another reference.
    """
    path = ordered().rowsBetween(Window.unboundedPreceding, 0)
    out = frame.withColumn("_x", x)
    out = out.withColumns({"_own": F.col("_x") - F.first("_x", ignorenulls=True).over(path), "_moved": ~F.col("_x").eqNullSafe(F.lag("_x").over(ordered()))})
    own = F.coalesce("_own", F.lit(0.0))
    counted = {"_n": F.col("_x").isNotNull().cast("double"), "_s": own, "_q": own * own, "_m": F.col("_moved").cast("double")}
    out = out.withColumns({k: F.sum(v).over(path) for k, v in counted.items()})
    inside = lambda k, back=window: F.col(k) - F.coalesce(F.lag(k, back).over(ordered()), F.lit(0.0))
    out = out.withColumns({"_wn": inside("_n"), "_ws": inside("_s"), "_wq": inside("_q"), "_wm": inside("_m", window - 1)})
    mean = F.col("_ws") / window
    sd = F.sqrt(F.greatest(F.col("_wq") - F.col("_ws") * mean, F.lit(0.0)) / (window - 1))
    ready = (F.col("_wn") == window) & (F.col("_wm") > 0)
    z = F.when(ready, ratio(F.col("_own") - mean, sd))
    return out.withColumn(name, z).drop("_x", "_own", "_moved", *counted, "_wn", "_ws", "_wq", "_wm")


def rolling_rank(frame: DataFrame, x: str, window: int, name: str, pieces: bool = False) -> DataFrame:
    """``trailing_rank`` in one pass that keeps the window sorted: for windows of many thousand rows; ``pieces`` as in ``recurrences``."""
    if window < 2:
        raise ValueError("a window of two values at least")
    return _null_nan(folds.fold(frame, [x], {name: lambda v: pd.Series(v).rolling(window).rank(method="average", pct=True).to_numpy()}, lookback=window if pieces else None), [name])


def trailing_rank(x: Column, window: int, frame=None) -> Column:
    """Average-tie rank of the last of ``window`` values, as a share of them."""
    if window < 2:
        raise ValueError("a window of two values at least")
    frame = trailing(window) if frame is None else frame
    held = F.collect_list(x).over(frame)
    below, same = F.size(F.filter(held, lambda v: v < x)), F.size(F.filter(held, lambda v: v == x))
    return F.when((F.count(x).over(frame) == window) & x.isNotNull(), (below + (same + 1) / 2) / window)


def slot_rank(bars: DataFrame, weeks: int = 52, zone: str = calendar.NEW_YORK, name: str = "spread_pctile_slot") -> DataFrame:
    """Rank of the spread among those of the same minute of the week."""
    slotted = bars.withColumn("_slot", calendar.minute_of_week(F.col("ts"), zone))
    frame = Window.partitionBy("pair", "_slot").orderBy("ts").rowsBetween(1 - weeks, 0)
    return slotted.withColumn(name, trailing_rank(F.col("spread_close"), weeks, frame)).drop("_slot")


def band_position(price: Column | None = None) -> Column:
    return ratio((F.col("mid_close") if price is None else price) - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"))


def timeframe_block(frame: DataFrame) -> DataFrame:
    """What other timeframes see of this one, on its own bars: needs bands, atr_14 and rsi_14."""
    return frame.select(
        "pair",
        "ts",
        band_position().alias("bb_position"),
        ratio(F.col("bb_upper") - F.col("bb_lower"), F.col("atr_14")).alias("bb_width_atr"),
        "rsi_14",
        F.when(F.col("mid_close") > 0, F.col("atr_14") / F.col("mid_close") * 1e4).alias("atr_bps"),
    )


def stretch(positions: list[str]) -> dict[str, Column]:
    """How many timeframes are outside their bands and how far the farthest is; null unless all are defined."""
    far = [F.abs(F.col(p) - 0.5) for p in positions]
    all_known = reduce(lambda a, b: a & b, [x.isNotNull() for x in far])
    count = reduce(lambda a, b: a + b, [(x > 0.5).cast("int") for x in far])
    return {"tf_stretch_count": F.when(all_known, count), "tf_stretch_max": F.when(all_known, F.greatest(*far) if len(far) > 1 else far[0])}


def touch_side() -> Column:
    c = F.col("mid_close")
    return F.when(c <= F.col("bb_lower"), 1).when(c >= F.col("bb_upper"), -1).otherwise(0)


def rsi_confirms(side: Column, low: float = 30.0, high: float = 70.0, rsi: str = "rsi_14") -> Column:
    return F.coalesce(F.when(side == 1, F.col(rsi) <= low).when(side == -1, F.col(rsi) >= high), F.lit(False))


def commission(price: Column, notional: float, rate: float = 2e-5, least: float = 2.0, cap: float = 0.002) -> Column:
    """Of one leg: a rate with a minimum, and a cap as a share of the value."""
    value = price * notional
    return F.least(value * cap, F.greatest(F.lit(least), value * rate))


def pays_costs(notional: float = 100_000.0, multiple: float = 2.0) -> Column:
    cost = F.col("spread_close") * notional + 2 * commission(F.col("mid_close"), notional)
    return F.abs(F.col("bb_middle") - F.col("mid_close")) * notional >= multiple * cost


def gate_stack(spread_max: float | Column, low: float = 30.0, high: float = 70.0, notional: float = 100_000.0, multiple: float = 2.0) -> Column:
    side = touch_side()
    return F.coalesce((side != 0) & rsi_confirms(side, low, high) & pays_costs(notional, multiple) & (F.col("spread_close") < spread_max), F.lit(False))


def gate_cell_d(regime: str = "regime_daily") -> Column:
    side = touch_side()
    return F.coalesce((side != 0) & rsi_confirms(side) & (F.col(regime) != 0), F.lit(False))


def excursion(frame: DataFrame, position: str = "bb_position", cap: int = 6, window: int = 20) -> DataFrame:
    """Runs outside the bands, their depth, bars since the last crossing and the share of time outside.

    Islands of equal state between undefined positions: no recurrence is needed.
    """
    p = F.col(position)
    state = F.when(p > 1, 1).when(p < 0, -1).when(p.isNotNull(), 0)
    out = frame.withColumn("_s", state).withColumn("_n", bar_number())
    s = F.col("_s")
    out = out.withColumn("_seg", F.count_if(s.isNull()).over(ordered()))
    changed = ~s.eqNullSafe(F.lag(s).over(ordered()))
    out = out.withColumn("_run", F.count_if(changed).over(ordered()))
    run = Window.partitionBy("pair", "_seg", "_run", "_s").orderBy("ts")
    segment = Window.partitionBy("pair", "_seg").orderBy("ts")
    known = s.isNotNull()
    out = out.withColumns({"_len": F.least(F.row_number().over(run), F.lit(cap)), "_depth": F.max(F.abs(p - 0.5)).over(run), "_was": F.lag(s).over(segment)})
    # the row that opens a segment is the undefined one, so its state is no state before
    crossed = F.last(F.when((F.col("_was") == 0) & (s != 0), F.col("_n")), ignorenulls=True).over(segment)
    share = lambda side: full(F.avg(F.when(known, (s == side).cast("double"))).over(trailing(window)), s, window, trailing(window))
    out = out.withColumns(
        {
            "run_above": F.when(known, F.when(s == 1, F.col("_len")).otherwise(0)),
            "run_below": F.when(known, F.when(s == -1, F.col("_len")).otherwise(0)),
            "depth": F.when(known, F.when(s != 0, F.col("_depth")).otherwise(0.0)),
            "since_crossing": F.when(known, (F.col("_n") - crossed + 1).cast("int")),
            "frac_above": share(1),
            "frac_below": share(-1),
        }
    )
    return out.drop("_s", "_n", "_seg", "_run", "_len", "_depth", "_was")
