"""Trading rules as signals in {-1, 0, 1}. Their state depends on the path, so each is one grouped pass per pair (and configuration)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, StructField, StructType

from tidewright.functions.workspace import once
from tidewright.operators import folds
from tidewright.operators.features import commission


class Strategy(Protocol):
    """A rule: a frame of features in, the same frame with a causal ``signal`` in {-1, 0, 1} out."""

    def generate_signals(self, frame: DataFrame, keys: tuple[str, ...] = ("pair",)) -> DataFrame: ...


@dataclass(frozen=True)
class Reversion:
    """Enter at a band, leave at the middle; one move a bar. RSI failing waits, cost or regime failing skips the touch."""

    use_rsi: bool = False
    use_costs: bool = False
    use_regime: bool = False
    rsi_low: float = 30.0
    rsi_high: float = 70.0
    multiple: float = 2.0
    notional: float = 100_000.0
    rsi: str = "rsi_14"
    regime: str = "regime_daily"

    def __post_init__(self):
        if not 0 <= self.rsi_low < self.rsi_high <= 100 or self.multiple <= 0 or self.notional <= 0:
            raise ValueError("thresholds out of order or not positive")

    def generate_signals(self, frame: DataFrame, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
        return reversion_signal(frame, self, keys)

    def prepared(self, frame: DataFrame) -> DataFrame:
        """What a bar says whatever the state: where the price is, and whether an entry on that side waits, skips or goes."""
        c = F.col("mid_close")
        inputs = ["mid_close", "bb_upper", "bb_middle", "bb_lower", *[self.rsi] * self.use_rsi, *["spread_close"] * self.use_costs, *[self.regime] * self.use_regime]
        known = F.lit(True)
        for name in inputs:
            known = known & F.col(name).isNotNull()
        side = F.when(c <= F.col("bb_lower"), 1).when(c >= F.col("bb_upper"), -1).otherwise(0)
        confirmed = F.when(side == 1, F.col(self.rsi) <= self.rsi_low).otherwise(F.col(self.rsi) >= self.rsi_high) if self.use_rsi else F.lit(True)
        allowed = F.lit(True)
        if self.use_costs:
            cost = F.col("spread_close") * self.notional + 2 * commission(c, self.notional)
            allowed = F.abs(F.col("bb_middle") - c) * self.notional >= self.multiple * cost
        if self.use_regime:
            allowed = allowed & (F.col(self.regime) != 0)
        return frame.withColumns(
            {
                "_known": known,
                "_side": F.when(known, side).otherwise(0),
                "_act": F.when(known, F.when(~confirmed, "wait").when(~allowed, "skip").otherwise("go")).otherwise("wait"),
                "_against": F.when(known, F.when(c > F.col("bb_middle"), 1).when(c < F.col("bb_middle"), -1).otherwise(0)).otherwise(0),
            }
        )


def _reversion_path(known, side, act, against, state: int = 0, locked: int = 0) -> tuple[np.ndarray, int, int]:
    """What is held after each bar, and state and lock after the last."""
    out = np.zeros(len(side), np.int8)
    for t, (ok, touched, verdict, above) in enumerate(zip(known, side, act, against)):
        if not ok:
            state = locked = 0
        elif state:
            if above != -state:  # at or past the middle
                state = locked = 0
        elif not touched:
            locked = 0
        elif touched != locked:
            if verdict == "go":
                state = touched
            elif verdict == "skip":
                locked = touched
        out[t] = state
    return out, state, locked


_INPUTS = ["_known", "_side", "_act", "_against"]
_STARTS = [(s, k) for s in (-1, 0, 1) for k in (-1, 0, 1)]


def _ends(frame: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, _piece, _ends): for each of the nine states and locks a piece may start with, the one it ends with."""
    kinds = dict(frame.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_piece int", "_ends array<int>"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts", kind="stable")
        path = [group[c].tolist() for c in _INPUTS]
        ends, at, chunk = [(s, k) for s, k in _STARTS], 0, 256
        while at < len(group) and len(set(ends)) > 1:  # once all starts have met, one walk serves them all
            part = [p[at : at + chunk] for p in path]
            met = {e: _reversion_path(*part, *e)[1:] for e in set(ends)}
            ends, at = [met[e] for e in ends], at + chunk
        if at < len(group):
            ends = [_reversion_path(*(p[at:] for p in path), *ends[0])[1:]] * len(ends)
        first = {k: [group[k].iloc[0]] for k in (*keys, "_piece")}
        return pd.DataFrame({**first, "_ends": [[_STARTS.index(e) for e in ends]]})

    return frame.groupBy(*keys, "_piece").applyInPandas(run, schema)


def reversion_signal(frame: DataFrame, rule: Reversion = Reversion(), keys: tuple[str, ...] = ("pair",), name: str = "signal", pieces: bool = False) -> DataFrame:
    """``frame`` with the rule's signal, in one pass over each group; with ``pieces`` over pieces of its time, for long histories.

    Pieces are walked by themselves. What one starts with follows from those before it:
    each maps the nine states and locks to what they become, and the maps are applied
    one after the other, a few numbers for each piece. The pieces are written once and read twice then.
    """
    ready = rule.prepared(frame)
    schema = StructType([*frame.schema.fields, StructField(name, ByteType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts", kind="stable")
        start = _STARTS[int(group["_start"].iloc[0])] if pieces else (0, 0)
        group[name] = _reversion_path(*(group[c].tolist() for c in _INPUTS), *start)[0]
        return group[schema.names]

    if not pieces:
        return ready.groupBy(*keys).applyInPandas(run, schema)
    dealt = once(folds.in_pieces(ready, keys, 0).drop("_own"), "rule")
    path = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.collect_list("_ends").over(path), F.array())
    start = F.aggregate(before, F.lit(_STARTS.index((0, 0))), lambda at, ends: F.get(ends, at))
    starts = _ends(dealt.select(*keys, "_piece", "ts", *_INPUTS), keys).select(*keys, "_piece", start.alias("_start"))
    # one row for each piece
    return dealt.join(F.broadcast(starts), [*keys, "_piece"]).groupBy(*keys, "_piece").applyInPandas(run, schema)


@dataclass(frozen=True)
class HeldScore:
    """The sign of a model's score beyond theta, held for a number of bars."""

    theta: float
    hold: int = 16
    score: str = "score"
    valid: str = "valid"

    def generate_signals(self, frame: DataFrame, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
        return held_score_signal(frame, self.theta, self.hold, self.score, self.valid, keys)


def _held_ends(frame: DataFrame, hold: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, _piece, _ends): for each number of bars that a piece may have to go on holding at its start, bars and sign at its end (sign 0: the one it came with)."""
    kinds = dict(frame.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_piece int", "_ends array<struct<left: int, sign: int>>"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts", kind="stable")
        entry, n = group["_entry"].to_numpy(), len(group)
        entries = np.flatnonzero(entry)
        ends = []
        for left in range(hold):
            at, sign = left, 0
            while at < n and (k := np.searchsorted(entries, at)) < len(entries):
                at, sign = int(entries[k]) + hold, int(entry[entries[k]])
            ends.append((max(at - n, 0), sign))
        first = {k: [group[k].iloc[0]] for k in (*keys, "_piece")}
        return pd.DataFrame({**first, "_ends": [[{"left": a, "sign": b} for a, b in ends]]})

    return frame.groupBy(*keys, "_piece").applyInPandas(run, schema)


def held_score_signal(frame: DataFrame, theta: float, hold: int = 16, score: str = "score", valid: str = "valid", keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """When idle and the score's size passes theta, its sign is held for ``hold`` bars before the next look.

    In pieces of time: each maps the ``hold`` numbers of bars that it may have to go on holding to what it
    ends with, and the maps are applied one after the other. The pieces are written once and read twice.
    """
    schema = StructType([*frame.schema.fields, StructField("signal", ByteType())])
    sign = F.signum(F.col(score).cast("double")).cast("int")
    entry = F.when(F.coalesce(F.col(valid), F.lit(False)) & (F.abs(score) > theta), sign).otherwise(0)
    dealt = once(folds.in_pieces(frame.withColumn("_entry", entry), keys, 0).drop("_own"), "held")
    path = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.collect_list("_ends").over(path), F.array())
    state = lambda left, own: F.struct(left.cast("int").alias("left"), own.cast("int").alias("sign"))
    start = F.aggregate(
        before, state(F.lit(0), F.lit(0)), lambda s, ends: state(F.get(ends, s["left"])["left"], F.when(F.get(ends, s["left"])["sign"] == 0, s["sign"]).otherwise(F.get(ends, s["left"])["sign"]))
    )
    starts = _held_ends(dealt.select(*keys, "_piece", "ts", "_entry"), hold, keys).select(*keys, "_piece", start.alias("_start")).select(*keys, "_piece", "_start.left", "_start.sign")
    starts = starts.withColumnsRenamed({"left": "_left", "sign": "_sign"})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts", kind="stable")
        entry, out, at = group["_entry"].to_numpy(), np.zeros(len(group), np.int8), int(group["_left"].iloc[0])
        out[:at] = group["_sign"].iloc[0]
        entries = np.flatnonzero(entry)
        while (k := np.searchsorted(entries, at)) < len(entries):
            first = entries[k]
            out[first : first + hold] = entry[first]
            at = first + hold
        return group.assign(signal=out)[schema.names]

    # one row for each piece
    return dealt.join(F.broadcast(starts), [*keys, "_piece"]).groupBy(*keys, "_piece").applyInPandas(run, schema)
