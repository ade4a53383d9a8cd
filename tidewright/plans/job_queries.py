"""Queries of checks, breakdowns, put-together features and jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewright.functions.rolling import following
from tidewright.operators import bars, features, labels, pipeline, simulate, stats, strategies
from tidewright.plans import frames, jobs
from tidewright.plans.frames import rounded

PT = ["pair", "ts"]
SIDE_PRICES = [f"{p}_{s}" for s in bars.SIDES for p in bars.PRICES]
MIDS = ["mid_open", "mid_high", "mid_low", "mid_close", "spread_close"]


def _clock_query(tf):
    def query(spark, d):
        return rounded(jobs.timeframe(frames.flat(spark, d), tf), [*PT, "n_minutes"], [*SIDE_PRICES, *MIDS], 9)

    return query


def clock_alignment(spark, d):
    return bars.clock_alignment(frames.hourly(spark, d), "1 hour")


def session_checks(spark, d):
    return rounded(bars.session_checks(frames.session(spark, d, "daily"), "daily"), ["pair", "labels_at_open", "unique_labels", "min_minutes", "max_minutes", "thin_bars"], ["median_minutes"])


def negative_spreads(spark, d):
    """Bars of shifted quotes: a third of the asks lies below the bid."""
    crossed = frames.hourly(spark, d).withColumn("close_ask", F.col("close_ask") - F.col("spread_close") * 2 * (F.hour("ts") % 3 == 0).cast("int"))
    return bars.negative_spreads(crossed)


def _edges(spark, d):
    first, last = frames.ticks(spark, d).agg(F.min("ts"), F.max("ts")).first()
    return first + dt.timedelta(days=3), last - dt.timedelta(days=2)


def window_slice(spark, d):
    return bars.slice_window(frames.hourly(spark, d), *_edges(spark, d)).groupBy("pair").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def active_gaps(spark, d):
    return rounded(bars.active_gap_samples(frames.hourly(spark, d), 60), ["pair", "nth", "start", "end"], ["minutes"])


def _technical(spark, d):
    return features.bollinger(frames.recurrent(frames.hourly(spark, d)))


def finite_rows(spark, d):
    own = _technical(spark, d).withColumn("ok", bars.finite(["bb_pct_b", "rsi_14", "adx_14", "atr_14"]))
    return own.groupBy("pair", "ok").agg(F.count("*").alias("n"))


def first_defined(spark, d):
    return stats.first_defined(_technical(spark, d), ["mid_close", "bb_pct_b", "rsi_14", "adx_14"])


def minutes_distribution(spark, d):
    return rounded(stats.value_counts(frames.hourly(spark, d), ["n_minutes"], [F.col("n_minutes")]), ["n_minutes", "n"], ["share", "cumulative_share"])


def macro_auc(spark, d):
    own = frames.recurrent(frames.hourly(spark, d)).withColumnRenamed("atr_14", "atr")
    own = labels.triple_barrier(own, (1.0,), 12).where("label_1_0 is not null")
    own = own.withColumns({"p_down": F.round("mid_close", 0), "p_flat": F.round("spread_close", 4), "p_up": -F.round("mid_close", 0)})
    return rounded(stats.macro_auc(own, "label_1_0", {-1: "p_down", 0: "p_flat", 1: "p_up"}, ["pair"]), ["pair", "classes"], ["macro_auc"])


def directional_statistics(spark, d):
    own = frames.recurrent(frames.hourly(spark, d)).withColumnRenamed("atr_14", "atr")
    own = labels.triple_barrier(own, (1.0,), 12).where("label_1_0 is not null").withColumn("down", F.col("mid_close") / 100).withColumn("upward", F.lit(0.4))
    return rounded(stats.directional_statistics(own, "label_1_0", "upward", "down", 4.0, ["pair"]), ["pair", "n"], ["accuracy", "base_rate", "n_eff", "se", "low", "high", "z_base"])


def spread_by_quarter(spark, d):
    keys = [F.year("ts").alias("year"), F.quarter("ts").alias("quarter")]
    return rounded(stats.grouped_spread(frames.hourly(spark, d), keys, "spread_close"), ["year", "quarter"], ["spread_close_mean", "spread_close_max", "spread_close_sd"], 9)


def widest_spreads(spark, d):
    """The ten widest hours of each instrument: a report."""
    return rounded(stats.top(frames.hourly(spark, d), "spread_close", 10, ["ts"], ["pair"]), PT, ["spread_close"], 9)


def spread_median(spark, d):
    """The frame's median spread, and how many bars lie under it."""
    own = frames.hourly(spark, d)
    limit = stats.frame_median(own, "spread_close")
    return own.agg(F.round(F.lit(limit), 9).alias("spread_max"), F.count_if(F.col("spread_close") < limit).alias("under"), F.count("*").alias("n"))


def session_counts(spark, d):
    return jobs.session_counts(frames.flat(spark, d), "4h")


def candle_atr(spark, d):
    own = features.candles(frames.recurrent(frames.hourly(spark, d)))
    return rounded(own, PT, ["upper_wick_atr", "lower_wick_atr", "upper_wick_rel", "lower_wick_rel"])


PIPELINE = ["ema_9", "macd_hist", "rsi_14", "adx_14", "log_ret_5", "ret_std_15", "bb_pct_b", "donchian_pos_60", "upper_wick_atr", "spread_z_60", "hour_sin"]


def feature_pipeline(spark, d):
    """Every family of one timeframe, put together."""
    return rounded(pipeline.apply_pipeline(frames.hourly(spark, d), (9, 21), (60,)), [*PT, "session_ny"], PIPELINE)


HTF = ["bb_position_2h", "bb_position_4h", "bb_width_atr_4h", "rsi_14_4h", "bb_pos_spread_2h", "bb_pos_spread_4h", "tf_stretch_max"]


def higher_timeframes(spark, d):
    """Blocks of other timeframes as of their closes, the regime and the gates, on hourly bars."""
    coarse = {tf: _block_frame(frames.session(spark, d, tf)) for tf in ("2h", "4h")}
    coarse["daily"] = strategies.reversion_signal(frames.bands(frames.recurrent(frames.session(spark, d, "daily")), 5))
    own = pipeline.with_higher_timeframes(_block_frame(frames.hourly(spark, d)), coarse, ["2h", "4h"], 0.02)
    return rounded(own, [*PT, "tf_stretch_count", "regime_daily", "gate_cell_d", "gate_stack"], HTF)


def _block_frame(frame):
    return features.bollinger(frames.recurrent(frame))


def excursions_4h(spark, d):
    """Excursions of 4-hour bars, counted on those bars and then seen from the hours."""
    coarse = frames.bands(frames.session(spark, d, "4h"))
    own = pipeline.with_excursions(frames.hourly(spark, d), {"4h": coarse}, ["4h"], 3, 24)
    return rounded(own, [*PT, "run_above_4h", "run_below_4h", "since_crossing_4h"], ["depth_4h", "frac_above_20_4h", "spread_pctile_slot", "spread_pctile"])


def decision_atr(spark, d):
    return rounded(jobs.decision_atr(frames.recurrent(frames.hourly(spark, d))), PT, ["atr_decision"])


def decision_bars(spark, d):
    """Trades with the close and the spread of the bar that each was decided on."""
    trades = simulate.simulate_trades(frames.signalled(spark, d), frames.SETUP)
    return rounded(jobs.at_decision(trades, frames.hourly(spark, d), ["mid_close", "spread_close"]), ["pair", "entry_ts", "decision_ts"], ["mid_close", "spread_close"])


def _labels_of(spark, d):
    own = frames.recurrent(frames.hourly(spark, d))
    return jobs.build_labels(frames.hourly(spark, d), own, (1.0,), 12, "1 hour")


def label_table(spark, d):
    """Labels whose ATR is that of the last closed bar, with the calendar of the entry."""
    own = _labels_of(spark, d).where("anchor_ts is not null")
    return rounded(own, [*PT, "label_1_0", "bars_1_0", "gap_type", "is_friday"], ["atr", "anchor", "touch_price_1_0"])


def label_ways(spark, d):
    """Label shares by gap class and by year."""
    own = _labels_of(spark, d)
    both = jobs.label_breakdown(own, [1.0], F.col("gap_type")).withColumn("by", F.lit("gap")).unionByName(jobs.label_breakdown(own, [1.0], F.year("anchor_ts")).withColumn("by", F.lit("year")))
    return rounded(both, ["by", "group", "n"], ["k", "up", "down", "none", "ambiguous", "bars"])


def wrong_anchors(spark, d):
    """Anchors that are not the next open: those that are moved here."""
    minute = frames.hourly(spark, d)
    own = minute.withColumn("anchor", following("mid_open") + F.when(F.hour("ts") == 3, 1e-9).otherwise(0.0))
    return jobs.wrong_anchors(own, minute).groupBy("pair").agg(F.count("*").alias("n"))


RULES = {"plain": strategies.Reversion(), "rsi": strategies.Reversion(use_rsi=True, rsi_low=45.0, rsi_high=55.0)}


def _rules(spark, d):
    trades = stats.trade_economics(jobs.rule_trades(frames.banded(spark, d), RULES, frames.SETUP), frames.SETUP.notional)
    edge = _period_edge(spark, d)
    return trades.withColumn("period", F.when(F.col("entry_ts") < F.lit(edge).cast("timestamp_ntz"), "train").otherwise("test")).withColumn("method", F.when(F.col("direction") > 0, "long").otherwise("short"))


def _period_edge(spark, d):
    first, last = frames.ticks(spark, d).agg(F.min("ts"), F.max("ts")).first()
    return (first + (last - first) / 2).replace(minute=0, second=0, microsecond=0)


METHODS = {"long": (["train"], "net_bps", 3), "short": (["train"], "t", 3)}


def _duel(spark, d):
    return jobs.head_to_head(_rules(spark, d), jobs.trading_days(frames.hourly(spark, d)), METHODS)


def rule_trades(spark, d):
    """Trades of two rules over all instruments, one plan."""
    return rounded(_rules(spark, d), ["pair", "rule", "direction", "entry_ts", "exit_ts", "period"], ["net_bps"])


def rule_selection(spark, d):
    """The rule that each method goes to the test with."""
    return rounded(_duel(spark, d)["chosen"], ["method", "rule", "trades"], ["net_bps", "t"])


def head_to_head(spark, d):
    return rounded(_duel(spark, d)["summary"], ["method", "trades"], ["net_bps", "t", "hit"])


def head_to_head_exits(spark, d):
    return rounded(_duel(spark, d)["exits"], ["method", "exit_reason", "n"], ["share"])


def head_to_head_quarters(spark, d):
    return rounded(_duel(spark, d)["quarters"], ["method", "year", "quarter", "trades"], ["net_bps"])


def head_to_head_paired(spark, d):
    return rounded(_duel(spark, d)["paired"], ["pair"], ["paired_t"])


def held_score(spark, d):
    """A score beyond a limit, held for five bars."""
    own = frames.hourly(spark, d).withColumn("score", F.col("mid_close") - F.col("mid_open")).withColumn("valid", F.hour("ts") < 20)
    return strategies.HeldScore(20.0, 5).generate_signals(own).select(*PT, F.col("signal").cast("int").alias("signal"))


def regime_rule(spark, d):
    """The band rule that enters only while the daily rule has a position."""
    rule = strategies.Reversion(use_regime=True)
    return rule.generate_signals(frames.regime(spark, d)).select(*PT, F.col("signal").cast("int").alias("signal"))


def moment_divergence(spark, d):
    own = features.moments(frames.hourly(spark, d), (24,), 60)
    return rounded(own, PT, ["skew_divergence_24", "kurt_divergence_24"])


def band_rescale(spark, d):
    own = features.rescale_bollinger(features.bollinger(frames.hourly(spark, d)), 1.5, "upper", "lower")
    return rounded(own, PT, ["upper", "lower"])


def side_bars(spark, d):
    return rounded(bars.side_bars(frames.hourly(spark, d), "ask"), ["pair", "timestamp"], ["open", "high", "low", "close", "volume"], 9)


def trade_excursions(spark, d):
    """The worst move against each trade."""
    return rounded(simulate.simulate_trades(frames.signalled(spark, d), frames.SETUP), ["pair", "entry_ts", "exit_ts"], ["mae_price"], 9)


QUERIES = {
    "bars_15min": _clock_query("15min"),
    "bars_30min": _clock_query("30min"),
    "clock_alignment": clock_alignment,
    "session_checks": session_checks,
    "negative_spreads": negative_spreads,
    "window_slice": window_slice,
    "active_gaps": active_gaps,
    "finite_rows": finite_rows,
    "first_defined": first_defined,
    "minutes_distribution": minutes_distribution,
    "macro_auc": macro_auc,
    "directional_statistics": directional_statistics,
    "spread_by_quarter": spread_by_quarter,
    "widest_spreads": widest_spreads,
    "spread_median": spread_median,
    "session_counts": session_counts,
    "candle_atr": candle_atr,
    "feature_pipeline": feature_pipeline,
    "higher_timeframes": higher_timeframes,
    "excursions_4h": excursions_4h,
    "decision_atr": decision_atr,
    "decision_bars": decision_bars,
    "label_table": label_table,
    "label_ways": label_ways,
    "wrong_anchors": wrong_anchors,
    "rule_trades": rule_trades,
    "rule_selection": rule_selection,
    "head_to_head": head_to_head,
    "head_to_head_exits": head_to_head_exits,
    "head_to_head_quarters": head_to_head_quarters,
    "head_to_head_paired": head_to_head_paired,
    "held_score": held_score,
    "regime_rule": regime_rule,
    "moment_divergence": moment_divergence,
    "band_rescale": band_rescale,
    "side_bars": side_bars,
    "trade_excursions": trade_excursions,
}
