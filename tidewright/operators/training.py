"""Training frames: levels frozen at each timeframe's own close, columns at the live price, assembly and its diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.calendar import seconds_between
from tidewright.functions.rolling import ratio
from tidewright.operators import bars, events, features
from tidewright.operators.asof import asof_many
from tidewright.operators.ranks import quantiles, set_medians

#: The timeframes over the base one, and those whose distance to it is a column.
HIGHER = ("30min", "1h", "2h", "4h", "daily", "weekly")
SPREADS = ("1h", "2h", "4h", "daily", "weekly")
KEYS = ("pair", "ts")


def price_units(ema_spans=features.EMA_SPANS, windows=features.DONCHIAN) -> set[str]:
    """Columns in units of the price, which a model pooled over instruments cannot use."""
    by_side = {f"{p}_{s}" for p in bars.PRICES for s in bars.SIDES} | {f"mid_{p}" for p in bars.PRICES}
    levels = {f"ema_{n}" for n in ema_spans} | {f"donchian_{s}_{w}" for s in ("high", "low") for w in windows}
    plain = {"macd", "macd_signal", "macd_hist", "atr_14", "bb_middle", "bb_upper", "bb_lower", "body", "upper_wick", "lower_wick", "bar_range"}
    return by_side | levels | plain | {"spread_close", "spread_mean_15", "spread_mean_60"}


def _levels(ema_spans, windows) -> list[str]:
    return ["bb_upper", "bb_lower", *[f"ema_{n}" for n in ema_spans], *[f"donchian_{s}_{w}" for w in windows for s in ("high", "low")]]


def _level_sources(base: DataFrame, coarse: dict[str, DataFrame], base_tf: str, ema_spans, windows, mark: str = ""):
    own = (base, _levels(ema_spans, windows), base_tf, mark)
    return [own, *[(frame, ["bb_upper", "bb_lower"], tf, f"_{tf}{mark}") for tf, frame in coarse.items()]]


def frozen_levels(
    target: DataFrame, base: DataFrame, coarse: dict[str, DataFrame], base_tf: str = "15 minutes", ema_spans=features.EMA_SPANS, windows=features.DONCHIAN
) -> DataFrame:
    """``target`` with the levels of the last closed base bar, and every coarser timeframe's bands as of their own close.

    Coarse bands do not pass through the base frame, which would delay them by up to one base bar.
    """
    return asof_many(target, _level_sources(base, coarse, base_tf, ema_spans, windows))


def live_columns(price: Column, tfs, spreads=SPREADS, ema_spans=features.EMA_SPANS, windows=features.DONCHIAN, mark: str = "") -> list[dict[str, Column]]:
    """Columns at the live price against levels (named with ``mark``), in three steps: each may use the one before."""
    level = lambda name: F.col(f"{name}{mark}")
    inside = lambda lo, hi: ratio(price - level(lo), level(hi) - level(lo))
    first = {"bb_pct_b": inside("bb_lower", "bb_upper")}
    first |= {f"bb_position_{tf}": inside(f"bb_lower_{tf}", f"bb_upper_{tf}") for tf in tfs}
    first |= {f"dist_ema_{n}": ratio(price - level(f"ema_{n}"), level(f"ema_{n}")) for n in ema_spans}
    first |= {f"donchian_pos_{w}": inside(f"donchian_low_{w}", f"donchian_high_{w}") for w in windows}
    apart = {f"bb_pos_spread_{tf}": F.col("bb_pct_b") - F.col(f"bb_position_{tf}") for tf in tfs if tf in spreads}
    return [first, apart, features.stretch(["bb_pct_b", *[f"bb_position_{tf}" for tf in tfs]])]


def assemble(
    labels: DataFrame,
    base: DataFrame,
    coarse: dict[str, DataFrame],
    kept_labels: list[str],
    base_tf: str = "15 minutes",
    anchor: str = "anchor",
    block_key: str = "atr",
    seed: int | None = None,
    drop_price_units: bool = True,
    ema_spans=features.EMA_SPANS,
    windows=features.DONCHIAN,
) -> DataFrame:
    """Events with block_id, event_offset, sampled_flag, features as of the last closed base bar (price columns live), and labels.

    Raises for columns that labels and features share. Columns in price units serve as
    levels and are pruned before the projection unless they are to be kept. Without a
    seed no row is marked as sampled.
    """
    both = (set(labels.columns) & set(base.columns)) - set(KEYS)
    if both:
        raise ValueError(f"columns of labels and of features: {sorted(both)}")
    absent = set(kept_labels) - set(labels.columns)
    if absent:
        raise ValueError(f"labels lack {sorted(absent)}")
    out_of = price_units(ema_spans, windows) if drop_price_units else set()
    kept = [c for c in base.columns if c not in out_of and c not in KEYS]
    own = events.blocks(labels, block_key)
    own = events.spaced_sample(own, seed) if seed is not None else own.withColumn("sampled_flag", F.lit(False))
    own = asof_many(own, [(base, kept, base_tf, ""), *_level_sources(base, coarse, base_tf, ema_spans, windows, "@")])
    made = []
    for step in live_columns(F.col(anchor), coarse, SPREADS, ema_spans, windows, "@"):
        own = own.withColumns(step)
        made += [c for c in step if c not in kept]
    return own.select(*KEYS, "block_id", "event_offset", "sampled_flag", *kept, *made, *kept_labels)


def freshness(target: DataFrame, base: DataFrame, coarse: dict[str, DataFrame], base_tf: str = "15 minutes") -> DataFrame:
    """(tf, n, stale, median_age, p95_age): rows whose coarse bar would be an older one by way of the base frame, and minutes since the newer one closed."""
    closes = {tf: frame.select("pair", "ts", bars.close_time(F.col("ts"), tf).alias("closed")) for tf, frame in coarse.items()}
    by_base = asof_many(base.select(*KEYS), [(f, ["closed"], tf, f"_{tf}") for tf, f in closes.items()])
    hops = (by_base, [f"closed_{tf}" for tf in coarse], base_tf, "_late")
    seen = asof_many(target.select(*KEYS), [*[(f, ["closed"], tf, f"_{tf}") for tf, f in closes.items()], hops])
    each = F.array(*[F.struct(F.lit(tf).alias("tf"), F.col(f"closed_{tf}").alias("now"), F.col(f"closed_{tf}_late").alias("late")) for tf in coarse])
    long = seen.select("ts", F.inline(each))
    differs = ~F.col("now").eqNullSafe(F.col("late"))
    age = F.when(differs & F.col("now").isNotNull(), seconds_between(F.col("now"), F.col("ts")) / 60)
    ages = quantiles(long.select("tf", age.alias("age")).where("age is not null"), ["tf"], "age", {"median_age": 0.5, "p95_age": 0.95})
    return long.groupBy("tf").agg(F.count("*").alias("n"), F.count_if(differs).alias("stale")).join(ages, "tf", "left")


def block_diagnostics(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, defined, first_valid, block_sd, varied_blocks, still_blocks): one pass by block, one over the blocks."""
    cells = [
        F.struct(F.lit(c).alias("feature"), F.count("*").alias("n"), F.count(c).alias("defined"), F.min(F.when(F.col(c).isNotNull(), F.col("ts"))).alias("first"), F.stddev_samp(c).alias("sd"))
        for c in columns
    ]
    per = frame.groupBy("pair", "block_id").agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return per.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("defined").alias("defined"), F.min("first").alias("first_valid"), F.avg("sd").alias("block_sd"),
        F.count("sd").alias("varied_blocks"), F.count_if(F.col("sd") == 0).alias("still_blocks"),
    )


def variance_share(frame: DataFrame, slot: Column, x: str, keys: list[str]) -> DataFrame:
    """Share of x's variance that lies between the means of its slots."""
    per = frame.where(F.col(x).isNotNull()).groupBy(*keys, slot.alias("_slot")).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    total, mean = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) / total - mean * mean
    within = F.sum(F.col("n") * F.col("v")) / total
    return per.groupBy(*keys).agg(F.try_divide(between, between + within).alias("share"))


def balance(frame: DataFrame, candidates: list[tuple[int, ...]], label: str, volatility: str) -> DataFrame:
    """The five balance criteria of every candidate set of test chunks; smaller is better.

    Rows are counted by chunk, quarter, year and label, and only those few counts meet the
    candidates, in a literal list; exact medians of all candidates come from counts by chunk and interval.
    """
    dated = frame.where("chunk_id >= 0")
    counts = dated.groupBy("chunk_id", F.quarter("ts").alias("q"), F.year("ts").alias("y"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    picks = F.array(*[F.struct(F.lit(i).alias("candidate"), F.array(*map(F.lit, held)).alias("held")) for i, held in enumerate(candidates)])
    dealt = counts.select("*", F.inline(picks)).withColumn("t", F.array_contains("held", F.col("chunk_id")))
    parts = lambda c: dealt.where("t").groupBy("candidate", c).agg(F.sum("n").alias("n")).groupBy("candidate")
    shares = [parts(c).agg((F.max("n") / F.sum("n")).alias(name)) for c, name in (("q", "quarter_max_share"), ("y", "year_max_share"))]
    side = lambda t, cond=F.lit(True): F.sum(F.when((F.col("t") == t) & F.col("label").isNotNull() & cond, F.col("n")))
    apart = [F.abs(F.coalesce(side(True, F.col("label") == k), F.lit(0)) / side(True) - F.coalesce(side(False, F.col("label") == k), F.lit(0)) / side(False)) for k in (-1, 0, 1)]
    labels = dealt.groupBy("candidate", "held").agg((F.greatest(*apart) * 100).alias("label_max_div_pp"))
    values = dated.groupBy("chunk_id", F.col(volatility).alias("vol")).agg(F.count("*").alias("n"))
    chunks = frozenset(r["chunk_id"] for r in counts.select("chunk_id").distinct().collect())
    sets = [frozenset(held) & chunks for held in candidates] + [chunks - frozenset(held) for held in candidates]
    medians = set_medians(values, "chunk_id", "vol", sets)
    # a row for each candidate
    rows = [(i, medians[i], medians[len(candidates) + i]) for i in range(len(candidates))]
    medians = frame.sparkSession.createDataFrame(rows, "candidate int, median_test double, median_train double")
    out = labels.join(medians, "candidate").withColumn("vol_rel_div", F.abs(F.col("median_test") - F.col("median_train")) / F.col("median_train"))
    for share in shares:
        out = out.join(share, "candidate")
    follow = F.expr("size(filter(array_sort(held), (x, i) -> i > 0 and x - array_sort(held)[i - 1] = 1))")
    return out.withColumn("adjacent_pairs", follow.cast("double"))


BALANCE = ["quarter_max_share", "year_max_share", "label_max_div_pp", "vol_rel_div", "adjacent_pairs"]


def live_agreement(live: DataFrame, carried: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): correlation of each live column with the one that was carried from the last closed bar."""
    both = live.select(*KEYS, *columns).join(carried.select(*KEYS, *[F.col(c).alias(f"{c}_carried") for c in columns]), list(KEYS))
    found = both.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.corr(c, f"{c}_carried").alias("r")) for c in columns]).alias("rows"))
    return found.select(F.inline("rows"))
