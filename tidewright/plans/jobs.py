"""The jobs: bars to timeframes, labels, splits, training events, models, and the choice between rules.

Each is one plan over all instruments and rules; what a job returns is a frame or a
small dictionary of numbers, what it writes goes through the stores and sinks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import calendar
from tidewright.functions.rolling import following, prev
from tidewright.functions.workspace import once
from tidewright.operators import bars, features, labels, pipeline, simulate, split, stats, strategies, training
from tidewright.operators.asof import asof
from tidewright.operators.model import ThreeClassModel, permutation_importance, subset
from tidewright.operators.slices import Running, scan
from tidewright.sources import barstore, featurestore
from tidewright.sources.files import write_csv, write_json

CLOCK = {"15min": "15 minutes", "30min": "30 minutes", "1h": "1 hour"}
SESSIONS = ("2h", "4h", "daily", "weekly")


def width(tf: str) -> str:
    """A timeframe as the span that the as-of joins know."""
    return CLOCK.get(tf, tf)


def timeframe(minute: DataFrame, tf: str) -> DataFrame:
    """Bars of one timeframe out of finer ones."""
    return bars.clock_bars(minute, CLOCK[tf]) if tf in CLOCK else bars.session_bars(minute, tf)


def conservation(minute: DataFrame, coarse: DataFrame) -> DataFrame:
    """(pair, rows_in, rows_held, kept): whether the buckets hold every row that went in."""
    held = coarse.groupBy("pair").agg(F.sum("n_minutes").alias("rows_held"))
    rows = minute.groupBy("pair").agg(F.count("*").alias("rows_in")).join(held, "pair", "left")
    return rows.withColumn("kept", F.col("rows_in").eqNullSafe(F.col("rows_held")))


def load_pairs(spark: SparkSession, root: str, pairs: list[str], start=None, end=None) -> DataFrame:
    """Bid and ask bars of the pairs, joined one to one, with mids, from start to end."""
    out = None
    for p in pairs:
        bid, ask = (barstore.BarStore(spark, root, p, s).read_all().select(F.lit(p.upper()).alias("pair"), F.col("timestamp").alias("ts"), *bars.PRICES) for s in bars.SIDES)
        both = bars.merge_sides(bid, ask)
        out = both if out is None else out.unionByName(both)
    return bars.slice_window(out, start, end)


def resample_job(spark: SparkSession, root: str, tf: str, pairs: list[str] | None = None, keep_sides: bool = True) -> DataFrame:
    """One timeframe of every stored pair: sides into the store of that timeframe, features of its own bars into the feature store. Returns the conservation check."""
    pairs = pairs or barstore.stored_pairs(spark, f"{root}/1min")
    minute = load_pairs(spark, f"{root}/1min", pairs)
    coarse = timeframe(minute, tf)
    if keep_sides:
        for p in pairs:
            for s in bars.SIDES:
                barstore.BarStore(spark, f"{root}/{tf}", p, s).append(bars.side_bars(coarse.where(F.col("pair") == p), s).drop("pair"))
    featurestore.write_features(pipeline.apply_pipeline(coarse), root, tf)
    return conservation(minute, coarse)


def atr_at_entry(frame: DataFrame, atr_bars: DataFrame, tf: str = "15 minutes", name: str = "atr") -> DataFrame:
    """``frame`` with the atr_14 of the last bar of ``atr_bars`` that has closed."""
    return asof(frame, atr_bars.select("pair", "ts", F.col("atr_14").alias(name)), [name], tf)


def build_labels(minute: DataFrame, atr_bars: DataFrame, widths=(1.0, 2.0), horizon: int = 240, tf: str = "15 minutes") -> DataFrame:
    """Anchor, entry ATR, the columns of each width, the return at the time barrier, and the calendar of the time of entry."""
    own = labels.triple_barrier(atr_at_entry(minute, atr_bars, tf), widths, horizon)
    return labels.with_calendar(own, horizon)


def wrong_anchors(labelled: DataFrame, minute: DataFrame) -> DataFrame:
    """Rows whose anchor is not the next bar's open, to the last bit."""
    raw = minute.select("pair", "ts", following("mid_open").alias("_next"))
    return labelled.join(raw, ["pair", "ts"], "left").where(~F.col("anchor").eqNullSafe(F.col("_next"))).drop("_next")


def label_breakdown(labelled: DataFrame, widths: list[float], by: Column | None = None, name: str = "group") -> DataFrame:
    """(k, group, n, up, down, none, ambiguous, bars) of each width, in one pass; ``by`` may be a gap class, Friday or the year."""
    group = F.lit("all") if by is None else by.cast("string")
    cells = [F.struct(F.lit(k).alias("k"), *[F.col(f"{n}_{labels.tag(k)}").alias(n) for n in ("label", "bars", "ambiguous")]) for k in widths]
    long = labelled.select(group.alias(name), F.inline(F.array(*cells))).where("label is not null")
    share = lambda v: F.avg((F.col("label") == v).cast("double"))
    return long.groupBy("k", name).agg(
        F.count("*").alias("n"), share(1).alias("up"), share(-1).alias("down"), share(0).alias("none"), F.avg(F.col("ambiguous").cast("double")).alias("ambiguous"), F.avg("bars").alias("bars")
    )


def wrong_labels(labelled: DataFrame, minute: DataFrame, widths, horizon: int, events: int = 200, seed: int = 0, atr: str = "atr") -> DataFrame:
    """(pair, ts, k, label, bars, ambiguous and what a scan of the bars ahead gives) where the two differ, for ``events`` labelled rows drawn by a hash.

    The scan shares nothing with the fast way: the bars ahead of each drawn event are joined by their
    numbers and looked through one by one.
    """
    numbered = scan(minute.select("pair", "ts", "mid_high", "mid_low"), {"_n": Running(F.lit(1))})
    names = [f"{n}_{labels.tag(k)}" for k in widths for n in ("label", "bars", "ambiguous")]
    held = labelled.where(F.col(names[0]).isNotNull()).select("pair", "ts", "anchor", F.col(atr).alias("_atr"), *names)
    drawn = held.orderBy(F.xxhash64(F.lit(seed), "pair", "ts"), "pair", "ts").limit(events).join(numbered.select("pair", "ts", "_n"), ["pair", "ts"])
    ahead = drawn.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("_at", F.col("_n") + F.col("_step"))
    met = ahead.join(numbered.select("pair", F.col("_n").alias("_at"), "mid_high", "mid_low"), ["pair", "_at"])
    first = lambda hit: F.min(F.when(hit, F.col("_step")))
    cells = [
        F.struct(
            F.lit(float(k)).alias("k"), first(F.col("mid_high") >= F.col("anchor") + k * F.col("_atr")).alias("up"), first(F.col("mid_low") <= F.col("anchor") - k * F.col("_atr")).alias("down"),
            *[F.first(f"{n}_{labels.tag(k)}").alias(n) for n in ("label", "bars", "ambiguous")],
        )
        for k in widths
    ]
    each = met.groupBy("pair", "ts").agg(F.array(*cells).alias("cells")).select("pair", "ts", F.inline("cells"))
    want = F.when(F.col("down") <= F.coalesce("up", "down"), -1).when(F.col("up").isNotNull(), 1).otherwise(0)
    each = each.withColumn("scan_label", want).withColumn("scan_bars", F.coalesce(F.when(want == -1, F.col("down")).when(want == 1, F.col("up")), F.lit(horizon)))
    each = each.withColumn("scan_ambiguous", F.coalesce(F.col("up") == F.col("down"), F.lit(False))).drop("up", "down")
    return each.where("label <> scan_label or bars <> scan_bars or ambiguous <> scan_ambiguous")


def label_job(minute: DataFrame, atr_bars: DataFrame, folder: str, widths=(1.0, 2.0), horizon: int = 240, tf: str = "15 minutes", checked: int = 200) -> dict[str, DataFrame]:
    """Build, write, check the anchors and ``checked`` drawn labels (raises on a wrong one), and break down by width, gap, Friday and year."""
    labelled = build_labels(minute, atr_bars, widths, horizon, tf)
    labelled.write.mode("overwrite").partitionBy("pair").parquet(f"{folder}/labels")
    held = labelled.sparkSession.read.schema(labelled.schema).parquet(f"{folder}/labels")
    if (wrong := wrong_anchors(held, minute).first()) is not None:
        raise ValueError(f"the anchor of {wrong['pair']} at {wrong['ts']} is not the next open")
    if checked and (wrong := wrong_labels(held, minute, widths, horizon, checked).first()) is not None:
        raise ValueError(f"the label of {wrong['pair']} at {wrong['ts']} is not that of a scan: {wrong.asDict()}")
    ways = {"k": None, "gap": F.col("gap_type"), "friday": F.col("is_friday"), "year": F.year("anchor_ts")}
    return {name: label_breakdown(held, list(widths), by) for name, by in ways.items()}


def split_job(frame: DataFrame, label: str, volatility: str, spread: str, start: dt.datetime, end: dt.datetime, horizon: int, embargo: int, test_share: float = 0.2, draws: int = 200, months: int = 3, seed: int = 0, gates: DataFrame | None = None, gate_tf: str = "15 minutes") -> tuple[DataFrame, dict]:
    """The split table of the best balanced draw of test chunks, its gates' spread limit taken from the training rows alone, and what was chosen.

    With ``gates``, bars of ``gate_tf`` with bands, rsi_14 and spread_close, the table has ``gate_stack`` under that
    limit, as of those bars' closes, in the place of any gate that knew the test rows' spreads.
    """
    chunks = split.build_chunks(start, end, months)
    dealt = split.with_chunk(frame, chunks)
    candidates = split.draw_candidates(len(chunks), max(1, round(test_share * len(chunks))), draws, seed)
    ranked = split.rank_candidates(training.balance(dealt, candidates, label, volatility), training.BALANCE).first()
    held = sorted(ranked["held"])
    table = split.assign_splits(dealt, held, horizon, embargo)
    limit = stats.frame_median(table.where("split = 'train'"), spread)
    if gates is not None:
        gated = gates.select("pair", "ts", features.gate_stack(float("-inf") if limit is None else limit).alias("gate_stack"))
        table = asof(table.drop("gate_stack"), gated, ["gate_stack"], gate_tf).withColumn("gate_stack", F.coalesce("gate_stack", F.lit(False)))
    return table, {"chunks": len(chunks), "test": held, "rank_sum": ranked["rank_sum"], "spread_max": limit}


def assembly_job(labelled: DataFrame, base: DataFrame, coarse: dict[str, DataFrame], kept: list[str], folder: str, base_tf: str = "15 minutes", seed: int = 0, **how) -> dict[str, DataFrame]:
    """All events and the sampled ones, written; diagnostics of the blocks and the age of each timeframe's levels."""
    events = training.assemble(labelled, base, coarse, kept, base_tf, seed=seed, **how)
    featurestore.write_events(events, folder)
    held = labelled.sparkSession.read.schema(events.schema).parquet(f"{folder}/events")
    numbers = [c for c, kind in events.dtypes if kind == "double" and c not in kept]
    return {"blocks": training.block_diagnostics(held, numbers), "freshness": training.freshness(held, base, coarse, base_tf)}


def training_job(rows: DataFrame, columns: list[str], folder: str, names: list[str], per_trial: float = 1.0, repeats: int = 1, **settings) -> dict[str, dict]:
    """A model of each named subset of columns, fitted on is_fit, stopped early on is_val, scored on the test rows and saved.

    ``rows`` has label, split, is_fit and is_val. Numbers of each model: accuracy of
    direction with its z, macro AUC, rows, rounds, and the columns that matter most.
    ``settings`` are those of the booster.
    """
    out = {}
    for name in names:
        used = subset(columns, name)
        fitted = rows.where("is_fit or is_val").withColumn("_stop", F.col("is_val"))
        model = ThreeClassModel(used, **settings).fit(fitted, validation="_stop")
        model.save(rows.sparkSession, f"{folder}/{name}")
        scored = model.transform(rows.where("split = 'test' and label is not null"))
        found = stats.directional_statistics(scored, "label", "p_up", "p_down", per_trial, []).first()
        area = stats.macro_auc(scored, "label", {-1: "p_down", 0: "p_flat", 1: "p_up"}, []).first()
        out[name] = {"columns": used, "rounds": model.booster.best, **(found.asDict() if found else {}), "macro_auc": area["macro_auc"] if area else None}
        if repeats:
            accuracy = lambda frame: stats.accuracy(frame, "label", "predicted", ["variant"])
            matter = permutation_importance(model, rows.where("split = 'test' and label is not null"), accuracy, repeats)
            out[name]["importance"] = [tuple(r) for r in matter.orderBy(F.desc("drop"), "column").limit(15).collect()]
    write_json(rows.sparkSession, f"{folder}/models.json", {k: {n: v for n, v in m.items() if n != "importance"} for k, m in out.items()})
    return out


def decision_bars(frame: DataFrame) -> DataFrame:
    """(pair, entry_ts, decision_ts, and the bar's other columns): the bar before each entry bar, which is the one that was decided on."""
    carried = [c for c in frame.columns if c not in ("pair", "ts")]
    return frame.select("pair", F.col("ts").alias("entry_ts"), prev("ts").alias("decision_ts"), *[prev(c).alias(c) for c in carried])


def at_decision(trades: DataFrame, frame: DataFrame, columns: list[str]) -> DataFrame:
    """``trades`` with columns of the bar that each was decided on."""
    return trades.join(decision_bars(frame.select("pair", "ts", *columns)), ["pair", "entry_ts"], "left")


def rule_trades(frame: DataFrame, rules: dict[str, strategies.Strategy], setup: simulate.Setup) -> DataFrame:
    """(rule, pair, ...) trades of every rule over every pair: pair and rule are the groups of one plan over a frame that is written once."""
    frame, signals = once(frame, "rules"), None
    for name, rule in rules.items():
        part = rule.generate_signals(frame).withColumn("rule", F.lit(name))
        signals = part if signals is None else signals.unionByName(part)
    return simulate.simulate_trades(signals, setup, ("pair", "rule"))


def select_rule(trades: DataFrame, periods: list[str], metric: str, least: int) -> DataFrame:
    """The rule of the best ``metric`` (t or net_bps) over trades of the periods, among those with ``least`` trades or more; equals by name."""
    seen = trades.where(F.col("period").isin(periods))
    scored = seen.groupBy("rule").agg(F.count("*").alias("trades"), F.avg("net_bps").alias("net_bps"), stats.tstat(F.col("net_bps")).alias("t"))
    return stats.best_eligible(scored, metric, F.col("trades") >= least, ["rule"])


def head_to_head(trades: DataFrame, days: DataFrame, methods: dict[str, tuple[list[str], str, int]]) -> dict[str, DataFrame]:
    """Methods against each other on the test period, each by its one rule that was chosen before it.

    ``trades`` (method, rule, period, pair, ..., net_bps, exit_ts); ``methods`` says for
    each on which periods, by which metric and with how many trades its rule is chosen.
    Tables: chosen, summary of each method, exits, quarters, and the daily difference. The trades are
    written once.
    """
    trades, chosen = once(trades, "trades"), None
    for name, (periods, metric, least) in methods.items():
        best = select_rule(trades.where(F.col("method") == name), periods, metric, least).withColumn("method", F.lit(name))
        chosen = best if chosen is None else chosen.unionByName(best)
    # one row for each method
    tested = trades.join(F.broadcast(chosen.select("method", "rule")), ["method", "rule"], "left_semi").where("period = 'test'")
    each = tested.groupBy("method").agg(
        F.count("*").alias("trades"), F.avg("net_bps").alias("net_bps"), stats.tstat(F.col("net_bps")).alias("t"), F.avg((F.col("net_bps") > 0).cast("double")).alias("hit")
    )
    exits = stats.value_counts(tested, ["method", "exit_reason"])
    quarters = tested.groupBy("method", F.year("exit_ts").alias("year"), F.quarter("exit_ts").alias("quarter")).agg(F.count("*").alias("trades"), F.avg("net_bps").alias("net_bps"))
    names = list(methods)
    daily = None
    for name in names:
        part = stats.daily_returns(tested.where(F.col("method") == name), days).withColumn("method", F.lit(name))
        daily = part if daily is None else daily.unionByName(part)
    tables = {"chosen": chosen, "summary": each, "exits": exits, "quarters": quarters, "daily": daily}
    if len(names) == 2:
        tables["paired"] = stats.paired_t(daily, "method", *names)
    return tables


def write_tables(tables: dict[str, DataFrame], folder: str, digits: int = 4) -> None:
    """Small result tables as CSV, one file each, and their names as JSON."""
    for name, frame in tables.items():
        write_csv(frame, f"{folder}/{name}", digits)
        spark = frame.sparkSession
    write_json(spark, f"{folder}/tables.json", sorted(tables))


def trading_days(frame: DataFrame) -> DataFrame:
    """(pair, day) of every trading day with a bar."""
    return frame.select("pair", calendar.trading_day(F.col("ts")).alias("day")).distinct()


def decision_atr(frame: DataFrame, atr: str = "atr_14", name: str = "atr_decision") -> DataFrame:
    """The ATR that was known when the bar's trade was decided: that of the bar before."""
    return frame.withColumn(name, prev(atr))


def session_counts(minute: DataFrame, period: str) -> DataFrame:
    """(pair, sessions, days, usual_rows): distinct sessions and days, and the usual number of rows of a session."""
    per = minute.groupBy("pair", calendar.session_key(F.col("ts"), period).alias("session")).agg(F.count("*").alias("rows"), F.count_distinct(F.to_date("ts")).alias("days"))
    return per.groupBy("pair").agg(F.count("*").alias("sessions"), F.sum("days").alias("days"), F.mode("rows", True).alias("usual_rows"))


def gate_checks(frame: DataFrame) -> DataFrame:
    """(pair, n, stack, cell_d, outside): bars that pass each gate, and those that pass one although no band is touched."""
    untouched = features.touch_side() == 0
    return frame.groupBy("pair").agg(
        F.count("*").alias("n"), F.count_if("gate_stack").alias("stack"), F.count_if("gate_cell_d").alias("cell_d"), F.count_if(untouched & (F.col("gate_stack") | F.col("gate_cell_d"))).alias("outside")
    )


def close_convention(frame: DataFrame, period: str) -> DataFrame:
    """(pair, n, off_width, shortest, longest): sessions whose close is not their start and the period's width in UTC, and hours from start to close."""
    hours = calendar.seconds_between(F.col("ts"), calendar.session_close(F.col("ts"), period)) / 3600
    own = frame.select("pair", hours.alias("_hours"))
    return own.groupBy("pair").agg(
        F.count("*").alias("n"), F.count_if(F.col("_hours") != calendar.SPANS[period]).alias("off_width"), F.min("_hours").alias("shortest"), F.max("_hours").alias("longest")
    )


def clock_change_check(target: DataFrame, sessions: DataFrame, period: str, days: int = 3) -> DataFrame:
    """(pair, near, wrong): rows within ``days`` days of a New York clock change, and those that do not see the last session that has closed.

    What a row sees comes from the as-of join; what it should see from each session's close alone,
    joined by the two weeks that a row and a session may have in common.
    """
    shift = lambda ts: calendar.seconds_between(ts, calendar.to_wall(ts))
    span = F.make_dt_interval(days=F.lit(days))
    seen = asof(target.select("pair", "ts"), sessions.select("pair", "ts", F.col("ts").alias("label")), ["label"], period, "_seen")
    near = seen.where(shift(F.col("ts") - span) != shift(F.col("ts") + span))
    week = lambda ts: F.floor(F.unix_micros(ts.cast("timestamp")) / (7 * 86_400_000_000))
    closes = sessions.select("pair", F.col("ts").alias("_label"), calendar.session_close(F.col("ts"), period).alias("_close"))
    closes = closes.withColumn("_week", F.explode(F.array(week(F.col("_close")), week(F.col("_close")) + 1, week(F.col("_close")) + 2)))
    both = near.withColumn("_week", week(F.col("ts"))).join(closes, ["pair", "_week"]).where("_close <= ts")
    wanted = both.groupBy("pair", "ts").agg(F.max_by("_label", "_close").alias("wanted"))
    found = near.distinct().join(wanted, ["pair", "ts"], "left")
    return found.groupBy("pair").agg(F.count("*").alias("near"), F.count_if(F.col("wanted").isNotNull() & ~F.col("label_seen").eqNullSafe(F.col("wanted"))).alias("wrong"))
