"""Three-class models of labels: boosted trees with class weights, chosen columns and rounds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import stats
from tidewright.operators.boosting import Settings, SoftmaxBooster
from tidewright.sources.files import read_json, write_json

CLASSES = (-1, 0, 1)
#: Of a hash that numbers rows; a power of two.
RANGES = 4096
PROBABILITIES = {-1: "p_down", 0: "p_flat", 1: "p_up"}

#: The clock's columns, the inputs of the two rules, and how names of band and excursion columns begin.
TIME = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "session_tokyo", "session_london", "session_ny", "session_overlap")
CORE = (
    "bb_pct_b", "bb_position_daily", "rsi_14", "rsi_14_daily", "regime_daily", "regime_daily_active", "gate_cell_d", "gate_stack",
    "spread_pctile_slot", "atr_bps_15m", "bb_width_atr_daily", "spread_ratio_60", "spread_z_60",
)
BANDS = ("bb_position_", "bb_width_atr_", "bb_pos_spread_", "tf_stretch_", "run_above", "run_below", "frac_above", "frac_below", "since_crossing", "depth")


def subset(features: list[str], name: str) -> list[str]:
    """A_all, B_strategy_core, C_mtf_bollinger or D_no_time. A frame without all of the core raises for B_strategy_core."""
    if name == "B_strategy_core":
        absent = [c for c in CORE if c not in features]
        if absent:
            raise KeyError(f"the frame lacks {absent}")
        return list(CORE)
    chosen = {"A_all": lambda c: True, "C_mtf_bollinger": lambda c: c == "bb_pct_b" or c.startswith(BANDS), "D_no_time": lambda c: c not in TIME}[name]
    return [c for c in features if chosen(c)]


class ThreeClassModel:
    """A softmax booster over the labels -1, 0 and 1, with the names that the jobs use."""

    def __init__(self, features: list[str], **settings):
        self.booster = SoftmaxBooster(list(features), CLASSES, Settings(**settings))

    @property
    def features(self) -> list[str]:
        return self.booster.features

    def fit(self, frame: DataFrame, label: str = "label", validation: str | None = None) -> ThreeClassModel:
        """``validation`` names a boolean column of rows that stop the boosting early."""
        self.booster.fit(frame, label, validation)
        return self

    def transform(self, frame: DataFrame) -> DataFrame:
        out = self.booster.with_probabilities(frame, list(PROBABILITIES.values()))
        return out.withColumn("predicted", stats.predicted_class(PROBABILITIES))

    def save(self, spark: SparkSession, path: str) -> None:
        write_json(spark, f"{path}/model.json", self.booster.to_json())

    @classmethod
    def load(cls, spark: SparkSession, path: str, features: list[str]) -> ThreeClassModel:
        """What ``save`` wrote; ``features`` are the columns that it was fitted on, in their order."""
        held = cls(features)
        held.booster = SoftmaxBooster.from_json(read_json(spark, f"{path}/model.json"))
        if held.features != list(features):
            raise ValueError(f"fitted on {held.features}")
        return held


def _numbered(frame: DataFrame, order: Column) -> DataFrame:
    """``frame`` with ``_to``, each row's place from 1 in the order of a hash: counts of RANGES ranges of the hash, then places inside each."""
    dealt = frame.withColumn("_hash", order).withColumn("_part", F.call_function("shiftright", F.col("_hash"), F.lit(64 - RANGES.bit_length() + 1)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # RANGES rows at most
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).select("_part", "_before")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_hash"))
    placed = dealt.withColumn("_in", inside).join(F.broadcast(starts), "_part")
    return placed.withColumn("_to", F.col("_before") + F.col("_in")).drop("_hash", "_part", "_in", "_before")


def permuted(place: Column, n: int, seed: int) -> Column:
    """Another place from 1 to n for each: a bijection by a factor without a common divisor with n and a shift, both drawn by the seed.

    Places come from a hash's order, so that neighbours have nothing in common. Exact up to n = 2^33.
    """
    rng = np.random.default_rng(seed)
    factor = next(a for a in (int(rng.integers(1, min(n, 1 << 30) + 1)) for _ in iter(int, 1)) if math.gcd(a, n) == 1)
    return F.pmod((place - 1) * F.lit(factor) + F.lit(int(rng.integers(0, n))), F.lit(n)) + 1


def shuffled(frame: DataFrame, column: str, key: list[str], seed: int) -> DataFrame:
    """``frame`` with one column's values dealt anew over the rows."""
    placed = _numbered(frame, F.xxhash64(F.lit(seed), *key))
    n = frame.count()
    if not n:
        return frame
    values = placed.select(permuted(F.col("_to"), n, seed).alias("_to"), F.col(column).alias("_dealt"))
    return placed.join(values, "_to").withColumn(column, F.col("_dealt")).select(*frame.columns)


def permutation_importance(model: ThreeClassModel, frame: DataFrame, metric, repeats: int = 3, seed: int = 11, key: tuple[str, ...] = ("pair", "ts")) -> DataFrame:
    """(column, drop, sd): by how much a metric falls when a column is dealt anew, its mean over the repeats and their deviation.

    ``metric`` makes (variant, metric) of scored rows with a column ``variant``. Rows are numbered once; each
    variant, a column and a repeat, has its own bijection of the numbers, so that one job deals, scores and
    measures them all.
    """
    n = frame.count()
    variants = [(c, r) for c in model.features for r in range(repeats)]
    placed = _numbered(frame, F.xxhash64(F.lit(seed), *key))
    own = placed.select(F.lit(-1).alias("variant"), F.lit(None).cast("double").alias("_dealt"), *frame.columns)
    if n and variants:
        cells = [F.struct(F.lit(v).alias("variant"), permuted(F.col("_to"), n, seed + 1 + v).alias("_at"), F.col(c).cast("double").alias("_dealt")) for v, (c, _) in enumerate(variants)]
        dealt = placed.select(F.inline(F.array(*cells)))
        long = dealt.join(placed, dealt["_at"] == placed["_to"]).select("variant", "_dealt", *frame.columns)
        number = {c: [v for v, (own, _) in enumerate(variants) if own == c] for c in model.features}
        own = own.unionByName(long.withColumns({c: F.when(F.col("variant").isin(vs), F.col("_dealt")).otherwise(F.col(c)) for c, vs in number.items()}), allowMissingColumns=False)
    measured = metric(model.transform(own.drop("_dealt")))
    names = frame.sparkSession.createDataFrame([(v, c) for v, (c, _) in enumerate(variants)], "variant int, column string")
    # a row for each variant
    base = F.max(F.when(F.col("variant") == -1, F.col("metric"))).over(Window.partitionBy(F.lit(0)))
    each = measured.withColumn("_drop", base - F.col("metric")).join(F.broadcast(names), "variant")
    return each.groupBy("column").agg(F.avg("_drop").alias("drop"), F.stddev_pop("_drop").alias("sd"))
