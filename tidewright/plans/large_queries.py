"""Queries of what the engine does for long histories and large models: boosting, slices of time, scans, ranks over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import calendar
from tidewright.operators import bars, features, labels, ranks, slices
from tidewright.operators.asof import asof
from tidewright.operators.boosting import Settings, SoftmaxBooster
from tidewright.plans import frames, jobs

BOOST = Settings(depth=2, rounds=2, rate=0.3, penalty=1.0, gamma=0.1, least_hessian=5.0, bins=16, rows_share=1.0, columns_share=1.0)
BOOST_COLUMNS = ["discount", "tax", "quantity", "price"]


def _line_items(spark: SparkSession, d: str) -> DataFrame:
    """Which of a line's discount and tax is larger; each is unknown in some lines. Every fifth order is for validation."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    x = {c: F.col(f"l_{n}").cast("double") for c, n in (("discount", "discount"), ("tax", "tax"), ("quantity", "quantity"), ("price", "extendedprice"))}
    known = {"discount": F.col("l_linenumber") != 1, "tax": F.col("l_linenumber") % 3 != 2}
    label = F.signum(F.round((x["discount"] - x["tax"]) * 100)).cast("int")
    columns = [F.when(known.get(c, F.lit(True)), v).alias(c) for c, v in x.items()]
    return rows.select("l_orderkey", "l_linenumber", *columns, label.alias("label"), (F.col("l_orderkey") % 5 == 0).alias("held"))


def _booster(spark: SparkSession, d: str) -> SoftmaxBooster:
    return SoftmaxBooster(BOOST_COLUMNS, settings=BOOST).fit(_line_items(spark, d), validation="held", cuts="width")


def booster_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Splits and leaf values of the first rounds of a softmax booster, whose nulls are never filled in."""
    found = _booster(spark, d).tree_rows(_line_items(spark, d))
    return found.select("round", "class", "node", "feature", "null_left", *[(F.round(c, 6) + 0.0).alias(c) for c in ("cut", "gain", "value")])


def booster_losses(spark: SparkSession, d: str) -> DataFrame:
    """Mean losses before each round and after the last, of the rows learned from and of those held for validation."""
    found = [(n, *own) for n, own in enumerate(_booster(spark, d).losses)]
    rows = spark.createDataFrame(found, "rounds int, fit_loss double, validation_loss double")
    return rows.select("rounds", *[(F.round(c, 8) + 0.0).alias(c) for c in ("fit_loss", "validation_loss")])


WIDTHS, HORIZON = (1.0, 1.5, 2.0, 2.5, 3.0), 240


def triple_barrier_240(spark: SparkSession, d: str) -> DataFrame:
    """Labels of five widths over 240 bars, in slices of a few hundred rows."""
    own = frames.hourly(spark, d).withColumn("atr", F.lit(8.0) + F.col("spread_close"))
    found = labels.triple_barrier(own, WIDTHS, HORIZON, slice_rows=200)
    names = [f"{n}_{labels.tag(k)}" for k in WIDTHS for n in ("label", "bars", "ambiguous")]
    return frames.rounded(found, ["pair", "ts", *names], ["anchor", "time_barrier_bps"])


def asof_sliced(spark: SparkSession, d: str) -> DataFrame:
    """What each order date knows of the last closed week and the last closed day with an urgent order: few rows a day, carried over days without any."""
    rows = spark.read.parquet(f"{d}/orders.parquet")
    ts = F.to_date("o_orderdate").cast("timestamp_ntz") + calendar.hours(F.pmod("o_orderkey", F.lit(24)).cast("int"))
    target = rows.select(F.col("o_orderpriority").alias("pair"), ts.alias("ts")).distinct()
    priced = rows.where("o_totalprice > 300000").select(F.col("o_orderpriority").alias("pair"), ts.alias("at"), "o_totalprice")
    out = target
    for period in ("daily", "weekly"):
        label = calendar.session_label(calendar.session_key(F.col("at"), period))
        bars = priced.groupBy("pair", label.alias("ts")).agg(F.max("o_totalprice").cast("double").alias("dearest"), F.count("*").alias("n"))
        out = asof(out, bars, ["dearest", "n"], period, f"_{period}")
    return frames.rounded(out, ["pair", "ts", "n_daily", "n_weekly"], ["dearest_daily", "dearest_weekly"])


def windows_sliced(spark: SparkSession, d: str) -> DataFrame:
    """Bands, channels and returns of ticks, in slices of three hundred rows with halos."""
    own = frames.flat(spark, d).groupBy("pair", "ts").agg(*[F.max(f"{p}_{s}").alias(f"{p}_{s}") for s in bars.SIDES for p in bars.PRICES])
    own = bars.with_mids(own).select("pair", "ts", "mid_high", "mid_low", "mid_close")

    def build(f: DataFrame) -> DataFrame:
        # returns after the channels, whose fold hands NaN on as null
        return features.bollinger(features.donchian(f, (1, 240))).withColumn("r", features.log_return(5))

    found = slices.over_slices(own, build, 241, rows=300)
    return frames.rounded(found, ["pair", "ts"], ["r", "bb_middle", "bb_upper", "bb_lower", "donchian_high_1", "donchian_low_240", "donchian_high_240"])


def scans_sliced(spark: SparkSession, d: str) -> DataFrame:
    """Running sums, counts, largest falls and the change points of an order's status, over the days of each priority."""
    rows = spark.read.parquet(f"{d}/orders.parquet")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    own = rows.select(
        F.col("o_orderpriority").alias("pair"), F.to_date("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_orderkey", "o_orderstatus", (F.when(F.col("o_orderkey") % 2 == 0, cents).otherwise(-cents)).alias("x")
    )
    order = ["ts", "o_orderkey"]
    out = slices.scan(own, {"total": slices.Running(F.col("x")), "n": slices.Running(F.lit(1))}, order, "month")
    out = slices.scan(out, {"peak": slices.Running(F.col("total"), "max")}, order, "month")
    out = slices.previous(out, {"status_before": F.col("o_orderstatus")}, order, "month")
    changed = ~F.col("o_orderstatus").eqNullSafe(F.col("status_before"))
    out = slices.scan(out.withColumn("changed", changed.cast("long")), {"block": slices.Running(F.col("changed"))}, order, "month")
    return out.select("pair", "o_orderkey", "total", "n", (F.col("total") - F.col("peak")).alias("fall"), "status_before", "block")


def price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of line prices by return flag, over ranges of the price."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    found = ranks.quantiles(rows, ["l_returnflag"], "price", {"p01": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99})
    return frames.rounded(found, ["l_returnflag"], ["p01", "p25", "median", "p75", "p99"])


def _order_sessions(spark: SparkSession, d: str, period: str) -> DataFrame:
    ts = F.to_date("o_orderdate").cast("timestamp_ntz") + calendar.hours(F.pmod("o_orderkey", F.lit(24)).cast("int"))
    label = calendar.session_label(calendar.session_key(ts, period))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("pair"), label.alias("ts")).distinct()


def close_conventions(spark: SparkSession, d: str) -> DataFrame:
    """Hours from start to close of the sessions of order times, and those off their width, which a clock change makes."""
    out = None
    for period in ("2h", "4h", "daily", "weekly"):
        part = jobs.close_convention(_order_sessions(spark, d, period), period).withColumn("period", F.lit(period))
        out = part if out is None else out.unionByName(part)
    return frames.rounded(out, ["pair", "period", "n", "off_width"], ["shortest", "longest"])


def clock_changes(spark: SparkSession, d: str) -> DataFrame:
    """Order times near a clock change, and those that do not see the last closed daily session."""
    ts = F.to_date("o_orderdate").cast("timestamp_ntz") + calendar.hours(F.pmod("o_orderkey", F.lit(24)).cast("int"))
    target = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("pair"), ts.alias("ts"))
    return jobs.clock_change_check(target.distinct(), _order_sessions(spark, d, "daily"), "daily")


def common_hours(spark: SparkSession, d: str) -> DataFrame:
    """Times that hourly bars, two-hour sessions and four-hour sessions all have a bar at."""
    return bars.common_rows([frames.hourly(spark, d), frames.session(spark, d, "2h"), frames.session(spark, d, "4h")])


def numeric_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as numbers: a text that is a number or none, a flag, a date and a price."""
    rows = spark.read.parquet(f"{d}/orders.parquet")
    clerk = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 3 == 1, "none")
    own = rows.select("o_orderkey", clerk.alias("text"), (F.col("o_orderstatus") == "O").alias("open"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return bars.numeric_view(own, ["text", "open", "day", "o_totalprice"], ("o_orderkey",))


QUERIES = {
    "common_hours": common_hours,
    "numeric_orders": numeric_orders,
    "booster_rounds": booster_rounds,
    "booster_losses": booster_losses,
    "triple_barrier_240": triple_barrier_240,
    "asof_sliced": asof_sliced,
    "windows_sliced": windows_sliced,
    "scans_sliced": scans_sliced,
    "price_quantiles": price_quantiles,
    "close_conventions": close_conventions,
    "clock_changes": clock_changes,
}
