"""Statistics of trades, scores and frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import calendar
from tidewright.operators.ranks import quantiles, running
from tidewright.operators.slices import Running, scan


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def tstat(x: Column) -> Column:
    """mean / (s / sqrt n); null for fewer than two values or none that differ."""
    s = F.stddev_samp(x)
    return F.when((F.count(x) > 1) & (s > 0), F.avg(x) / (s / F.sqrt(F.count(x))))


def trade_economics(trades: DataFrame, notional: float) -> DataFrame:
    """net_bps, gross_bps and cost_bps of every trade, per value traded at entry."""
    value = F.col("entry_price") * notional
    out = trades.withColumns({"net_bps": (F.col("pnl") - F.col("commission")) / value * 1e4, "gross_bps": (F.col("pnl") + F.col("spread_cost")) / value * 1e4})
    return out.withColumn("cost_bps", F.col("gross_bps") - F.col("net_bps"))


def daily_returns(trades: DataFrame, days: DataFrame) -> DataFrame:
    """(pair, day, ret) on every day of ``days`` (pair, day): net bps of the trades that left on that trading day."""
    own = trades.groupBy("pair", calendar.trading_day(F.col("exit_ts")).alias("day")).agg((F.sum("net_bps") / 1e4).alias("ret"))
    return days.join(own, ["pair", "day"], "left").select("pair", "day", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def pooled(daily: DataFrame) -> DataFrame:
    """Equal weights over pairs, day by day."""
    return daily.groupBy("day").agg(F.avg("ret").alias("ret"))


def drawdown(frame: DataFrame, x: str, unit: str = "day") -> DataFrame:
    """``frame`` with ``cumulative``, the running sum of x, and ``drawdown``, how far that is below its largest value so far or 0; scans over units of time."""
    path = scan(frame, {"cumulative": Running(F.col(x))}, unit=unit)
    path = scan(path, {"_peak": Running(F.col("cumulative"), "max")}, unit=unit)
    return path.withColumn("drawdown", F.col("cumulative") - F.greatest("_peak", F.lit(0.0))).drop("_peak")


def summarize(trades: DataFrame, daily: DataFrame) -> DataFrame:
    """Trades, mean net bps, t, Sharpe, drawdown, total, hit rate, gross and cost per pair."""
    each = trades.groupBy("pair").agg(
        F.count("*").alias("trades"), F.avg("net_bps").alias("net_bps"), tstat(F.col("net_bps")).alias("t"), F.avg((F.col("net_bps") > 0).cast("double")).alias("hit"),
        F.avg("gross_bps").alias("gross_bps"), F.avg("cost_bps").alias("cost_bps"),
    )
    path = drawdown(daily.withColumn("ts", F.col("day").cast("timestamp_ntz")), "ret", "year").withColumnRenamed("drawdown", "_fall")
    sharpe = F.when(F.stddev_samp("ret") > 0, F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(252.0)))
    days = path.groupBy("pair").agg(sharpe.alias("sharpe"), F.min("_fall").alias("max_drawdown"), F.sum("ret").alias("total"))
    return days.join(each, "pair", "left")


def welch(frame: DataFrame, group: str, a: str, b: str, x: str, keys: list[str]) -> DataFrame:
    """Difference of two groups' means and its Welch z, per key."""
    side = lambda name: F.when(F.col(group) == name, F.col(x))
    agg = frame.groupBy(*keys).agg(
        *[f(side(n)).alias(f"{label}_{k}") for k, n in (("a", a), ("b", b)) for label, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    )
    error = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    return agg.select(*keys, (F.col("mean_a") - F.col("mean_b")).alias("diff"), F.when(error > 0, (F.col("mean_a") - F.col("mean_b")) / error).alias("z"))


def paired_t(daily: DataFrame, method: str, a: str, b: str) -> DataFrame:
    """t of the daily differences of two methods, per pair."""
    wide = daily.groupBy("pair", "day").agg(*[F.sum(F.when(F.col(method) == m, F.col("ret"))).alias(n) for n, m in (("x", a), ("y", b))])
    return wide.groupBy("pair").agg(tstat(F.col("x") - F.col("y")).alias("paired_t"))


def average_rank(x: str, keys: list[str]) -> Column:
    ties = F.count("*").over(Window.partitionBy(*keys, x))
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (ties - 1) / 2


def auc(frame: DataFrame, score: str, positive: Column, keys: list[str]) -> DataFrame:
    """Rank AUC with average ties, exact: counts of each distinct score, then running sums over ranges of the score."""
    counts = frame.groupBy(*keys, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    won = F.sum(F.col("p") * (F.col("upto_n") - F.col("n")) + F.col("p") * F.col("n") / 2)
    total = running(counts, keys, score, ["n"]).groupBy(*keys).agg(won.alias("_won"), F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    return total.select(*keys, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_won") / (F.col("_p") * F.col("_n"))).alias("auc"))


def directional(frame: DataFrame, label: str, up: str, down: str, keys: list[str]) -> DataFrame:
    """Accuracy of the larger of two probabilities on rows that touched a barrier, and the share of the larger class; ties say up."""
    touched = frame.where(F.col(label) != 0)
    right = (F.when(F.col(up) >= F.col(down), 1).otherwise(-1) == F.col(label)).cast("double")
    ups = F.avg((F.col(label) == 1).cast("double"))
    return touched.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.greatest(ups, 1 - ups).alias("base_rate"))


def predicted_class(probabilities: dict[int, str]) -> Column:
    """The class of the largest probability, the first of equals."""
    best = F.greatest(*[F.col(c) for c in probabilities.values()])
    out = None
    for label, c in probabilities.items():
        out = F.when(F.col(c) == best, label) if out is None else out.when(F.col(c) == best, label)
    return out


def confusion(frame: DataFrame, truth: str, predicted: str, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys, truth, predicted).agg(F.count("*").alias("n"))


def precision_recall(frame: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    hit = lambda k: F.count_if((F.col(truth) == k) & (F.col(predicted) == k))
    part = lambda k, c: F.when(F.count_if(F.col(c) == k) > 0, hit(k) / F.count_if(F.col(c) == k))
    rows = frame.agg(F.array(*[F.struct(F.lit(k).alias("class"), part(k, predicted).alias("precision"), part(k, truth).alias("recall")) for k in classes]).alias("r"))
    return rows.select(F.inline("r"))


def calibration(frame: DataFrame, probability: str, outcome: str, buckets: int = 10) -> DataFrame:
    """Mean probability and outcome in buckets of one width; empty buckets are kept."""
    cell = F.least(F.floor(F.col(probability) * buckets), F.lit(buckets - 1)).cast("int")
    found = frame.groupBy(cell.alias("bucket")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_probability"), F.avg(outcome).alias("observed"))
    every = frame.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(found, "bucket", "left").fillna(0, ["n"])


def binomial_se(p: float, n: float) -> float:
    if n <= 0:
        raise ValueError("an effective number above 0")
    return math.sqrt(p * (1 - p) / n)


def wald_interval(p: float, n: float, z: float = 1.96) -> tuple[float, float]:
    return p - z * binomial_se(p, n), p + z * binomial_se(p, n)


def z_against(p: float, base: float, n: float) -> float:
    """With the standard error at the base rate."""
    return (p - base) / binomial_se(base, n)


def null_sd(statistic: str, n: int) -> float:
    """Standard deviation of bias-corrected skew or excess kurtosis of n normal values."""
    skew = math.sqrt(6 * n * (n - 1) / ((n - 2) * (n + 1) * (n + 3)))
    return skew if statistic == "skew" else 2 * skew * math.sqrt((n * n - 1) / ((n - 3) * (n + 5)))


def class_weights(frame: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Inverse frequency of each class, scaled to a mean of 1 over the rows."""
    counts = frame.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counts.withColumn("weight", F.sum("n").over(own) / (F.col("n") * F.count("*").over(own)))


def correlations(frame: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns over the rows where both are defined, in one aggregate."""
    pairs = [(a, b) for a in left for b in right]
    row = frame.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("rows"))
    return row.select(F.inline("rows"))


QUANTILES = (1, 25, 50, 75, 99)


def describe(frame: DataFrame, columns: list[str], guards: dict[str, Column] | None = None) -> DataFrame:
    """Count, shares of nulls and of infinities, moments, extremes and five exact quantiles of each column's finite values.

    ``guards`` names, for a column, rows at which it is undefined by its own rule (a
    zero denominator, say); their share of all rows is ``guarded_share``. Quantiles come
    from counts of distinct values over ranges of the value, so no task holds a column.
    """
    guards = guards or {}
    x = F.col("cell.x")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), F.coalesce(guards.get(c, F.lit(False)), F.lit(False)).alias("guarded")) for c in columns])
    long = frame.select("ts", F.explode(cells).alias("cell")).select("ts", F.col("cell.feature").alias("feature"), x.alias("x"), F.col("cell.guarded").alias("guarded"))
    known = F.col("x").isNotNull() & ~F.isnan(F.coalesce("x", F.lit(0.0)))
    infinite = known & (F.abs("x") == float("inf"))
    value = F.when(known & ~infinite, F.col("x"))
    out = long.withColumn("value", value).groupBy("feature").agg(
        F.count_if(known).alias("n"), (1 - F.count_if(known) / F.count("*")).alias("null_share"), (F.count_if(infinite) / F.count("*")).alias("inf_share"),
        (F.count_if("guarded") / F.count("*")).alias("guarded_share"), F.min(F.when(known, F.col("ts"))).alias("first_valid"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return out.join(quantiles(long.where(value.isNotNull()).select("feature", value.alias("x")), ["feature"], "x", {f"p{q}": q / 100 for q in QUANTILES}), "feature", "left").select(
        "feature", "n", "null_share", "inf_share", "guarded_share", "first_valid", "mean", "sd", "min", *[f"p{q}" for q in QUANTILES], "max"
    )


def usable_start(frame: DataFrame, columns: list[str]) -> tuple:
    """The first time at which every column has been defined, and the column that came last; (None, column) where one never is."""
    row = frame.agg(*[F.min(F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    for i, c in enumerate(columns):
        if row[i] is None:
            return None, c
    return max((row[i], c) for i, c in enumerate(columns))


def first_defined(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, first_defined): null for a column without values."""
    cells = [F.struct(F.lit(c).alias("feature"), F.min(F.when(F.col(c).isNotNull(), F.col("ts"))).alias("first_defined")) for c in columns]
    return frame.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def value_counts(frame: DataFrame, columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of each combination of values, their share, and the share up to there, most frequent first (or in ``order``)."""
    counts = frame.groupBy(*columns).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over the distinct combinations, not the rows
    path = Window.partitionBy(F.lit(0)).orderBy(*(order or [F.col("n").desc(), *columns])).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumns({"share": F.col("n") / total, "cumulative_share": F.sum("n").over(path) / total})


def macro_auc(frame: DataFrame, label: str, probabilities: dict[int, str], keys: list[str]) -> DataFrame:
    """Mean over the classes of the rank AUC of each against the rest; classes without both sides count for nothing."""
    out = None
    for k, c in probabilities.items():
        part = auc(frame.where(F.col(c).isNotNull()), c, F.col(label) == k, keys).withColumn("_class", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys).agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("classes"))


def accuracy(frame: DataFrame, truth: str, predicted: str, keys: list[str]) -> DataFrame:
    """(keys, metric): the share of rows whose class is predicted."""
    return frame.groupBy(*keys).agg(F.avg((F.col(predicted) == F.col(truth)).cast("double")).alias("metric"))


def directional_statistics(frame: DataFrame, label: str, up: str, down: str, per_trial: float, keys: list[str], z: float = 1.96) -> DataFrame:
    """``directional`` with standard error, Wald interval and z against the base rate; one independent trial for each ``per_trial`` rows."""
    p, base = F.col("accuracy"), F.col("base_rate")
    n = F.col("n") / per_trial
    se = F.sqrt(p * (1 - p) / n)
    out = directional(frame, label, up, down, keys)
    return out.withColumns({"n_eff": n, "se": se, "low": p - z * se, "high": p + z * se, "z_base": (p - base) / F.when(base < 1, F.sqrt(base * (1 - base) / n))})


def grouped_spread(frame: DataFrame, keys: list[Column], x: str) -> DataFrame:
    """Mean, largest value and standard deviation of x in each group."""
    return frame.groupBy(*keys).agg(F.avg(x).alias(f"{x}_mean"), F.max(x).alias(f"{x}_max"), F.stddev_samp(x).alias(f"{x}_sd"))


def frame_median(frame: DataFrame, x: str) -> float | None:
    """The exact median of all defined values, as a number for a setup; from counts of the distinct values."""
    found = quantiles(frame.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x")), [], "x", {"median": 0.5}).first()
    return None if found is None else found["median"]


def top(frame: DataFrame, by: str, k: int, ties: list[str], keys: list[str] | None = None) -> DataFrame:
    """The k rows of the largest values, equals in the order of ``ties``; of each group where ``keys`` are given."""
    order = [F.col(by).desc_nulls_last(), *ties]
    if not keys:
        return frame.orderBy(*order).limit(k)
    ranked = frame.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_place") <= k).drop("_place")


def best_eligible(frame: DataFrame, by: str, eligible: Column, ties: list[str]) -> DataFrame:
    """The one row of the largest value among the eligible ones; none where none is."""
    return top(frame.where(eligible), by, 1, ties)
