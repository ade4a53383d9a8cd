"""Bar-by-bar trading simulator.

A signal at a bar's close is traded at the next bar's open: a long buys at the ask
and sells at the bid. On a bar, in this order: a changed target releases a held-back
one; the position goes to the target at the open; a position that is old enough is
closed at the open; levels are tested on the bar's mid range, the stop first, on the
bar of entry too; the rest is marked at the mid close. After a level or an age exit
the same target is held back until it changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.workspace import once
from tidewright.operators.ranks import quantiles


@dataclass(frozen=True)
class Costs:
    rate: float = 2e-5
    least: float = 2.0
    cap: float = 0.002

    def leg(self, price: float, notional: float) -> float:
        if price <= 0 or notional <= 0:
            raise ValueError("a price and a notional above 0")
        value = price * notional
        return min(self.cap * value, max(self.least, self.rate * value))


class ExitLevels(Protocol):
    """Where a trade takes its profit and where it stops: distances from the fill, as columns of the bar of entry."""

    def distances(self) -> tuple[Column, Column]:
        """Of the profit and of the stop; a null or a distance that is not above 0 sets no level."""


@dataclass(frozen=True)
class NoLevels:
    def distances(self) -> tuple[Column, Column]:
        none = F.lit(None).cast("double")
        return none, none


@dataclass(frozen=True)
class AtrBarrier:
    """Both so many ATR away."""

    k: float = 2.0
    atr: str = "atr_decision"

    def distances(self) -> tuple[Column, Column]:
        far = self.k * F.col(self.atr).cast("double")
        return far, far


@dataclass(frozen=True)
class Setup:
    notional: float = 100_000.0
    costs: Costs | None = Costs()
    warmup: int = 600
    max_hold: int | None = None
    levels: ExitLevels = NoLevels()


BARS = "equity double, position int, cum_spread_cost double, cum_commission double"
TRADES = (
    "direction int, entry_ts timestamp_ntz, entry_price double, exit_ts timestamp_ntz, exit_price double, pnl double, bars_held int, "
    "exit_reason string, spread_cost double, commission double, mae_price double"
)


def target_position(frame: DataFrame, setup: Setup, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """The signal of the bar before, 0 during the warm-up."""
    path = Window.partitionBy(*keys).orderBy("ts")
    return frame.withColumn("target", F.when(F.row_number().over(path) > setup.warmup, F.coalesce(F.lag("signal").over(path), F.lit(0))).otherwise(0).cast("int"))


class _Book:
    """Cash, the open trade and what it has cost."""

    def __init__(self, bars: dict[str, np.ndarray], setup: Setup):
        self.bars, self.setup = bars, setup
        self.cash = self.spread = self.fees = 0.0
        self.side, self.trades = 0, []

    def _fee(self, price: float) -> float:
        fee = self.setup.costs.leg(price, self.setup.notional) if self.setup.costs else 0.0
        self.cash -= fee
        self.fees += fee
        return fee

    def enter(self, t: int, side: int) -> None:
        b, size = self.bars, self.setup.notional
        self.side, self.at, self.price = side, t, b["open_ask" if side > 0 else "open_bid"][t]
        self.cost, self.fee = side * (self.price - b["mid_open"][t]) * size, self._fee(self.price)
        self.spread += self.cost
        self.mid, self.low, self.high = b["mid_open"][t], b["mid_low"][t], b["mid_high"][t]
        far = [d if np.isfinite(d) and d > 0 else np.inf for d in (b["profit"][t], b["stop"][t])]
        self.levels = (self.price + side * far[0], self.price - side * far[1]) if min(far) < np.inf else None

    def leave(self, t: int, price: float, cost: float, reason: str) -> None:
        gained = self.side * (price - self.price) * self.setup.notional
        self.cash += gained
        self.spread += cost
        fee = self._fee(price)
        worst = max(0.0, self.mid - self.low if self.side > 0 else self.high - self.mid)
        self.trades.append((self.side, self.at, self.price, t, price, gained, t - self.at, reason, self.cost + cost, self.fee + fee, worst))
        self.side = 0

    def leave_at_open(self, t: int, reason: str) -> None:
        price = self.bars["open_bid" if self.side > 0 else "open_ask"][t]
        self.leave(t, price, self.side * (self.bars["mid_open"][t] - price) * self.setup.notional, reason)

    def met_level(self, t: int) -> tuple[float, str] | None:
        if not self.side or self.levels is None:
            return None
        best, worst = (self.bars[k][t] for k in (("mid_high", "mid_low") if self.side > 0 else ("mid_low", "mid_high")))
        profit, stop = self.levels
        if self.side * (worst - stop) <= 0:
            return stop, "intrabar_sl"
        if self.side * (best - profit) >= 0:
            return profit, "intrabar_tp"
        return None


def simulate_arrays(bars: dict[str, np.ndarray], target: np.ndarray, setup: Setup):
    """Equity, position, running costs of every bar, and the closed trades by bar number."""
    book, held_back = _Book(bars, setup), None
    rows = np.zeros((len(target), 4))
    for t, wanted in enumerate(target.tolist()):
        if held_back is not None and wanted != held_back:
            held_back = None
        goal = 0 if held_back is not None else wanted
        if goal != book.side:
            if book.side:
                book.leave_at_open(t, "signal")
            if goal:
                book.enter(t, goal)
        if book.side and setup.max_hold is not None and t - book.at >= setup.max_hold:
            book.leave_at_open(t, "time_exit")
            held_back = wanted
        if (met := book.met_level(t)) is not None:
            level, reason = met
            half = (bars["open_ask"][t] - bars["open_bid"][t]) / 2
            book.leave(t, level - book.side * half, half * setup.notional, reason)
            held_back = wanted
        if book.side:
            book.low, book.high = min(book.low, bars["mid_low"][t]), max(book.high, bars["mid_high"][t])
        marked = book.side * (bars["mid_close"][t] - book.price) * setup.notional if book.side else 0.0
        rows[t] = book.cash + marked, book.side, book.spread, book.fees
    return rows, book.trades


_PRICES = ("open_bid", "open_ask", "mid_open", "mid_high", "mid_low", "mid_close")
_INPUTS = (*_PRICES, "profit", "stop")


def _grouped(frame: DataFrame, setup: Setup, keys: tuple[str, ...], schema: str, take) -> DataFrame:
    if missing := [c for c in (*_PRICES, "signal") if c not in frame.columns]:
        raise KeyError(f"missing columns: {missing}")
    kinds = dict(frame.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    profit, stop = setup.levels.distances()
    columns = [*keys, "ts", "target", *_PRICES, profit.alias("profit"), stop.alias("stop")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ts", kind="stable").reset_index(drop=True)
        rows, trades = simulate_arrays({c: group[c].to_numpy(float) for c in _INPUTS}, group["target"].to_numpy(), setup)
        out = take(group, rows, trades)
        for i, k in enumerate(keys):
            out.insert(i, k, group[k].iloc[0])
        return out

    return target_position(frame, setup, keys).select(columns).groupBy(*keys).applyInPandas(run, f"{named}, {schema}")


def simulate_bars(frame: DataFrame, setup: Setup = Setup(), keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """(pair, ts, equity, position, cum_spread_cost, cum_commission) of every bar."""

    def take(group, rows, trades):
        out = pd.DataFrame(rows, columns=["equity", "position", "cum_spread_cost", "cum_commission"]).astype({"position": int})
        out.insert(0, "ts", group["ts"])
        return out

    return _grouped(frame, setup, keys, f"ts timestamp_ntz, {BARS}", take)


def simulate_trades(frame: DataFrame, setup: Setup = Setup(), keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """One row for each closed trade; a position open at the end is no trade."""

    def take(group, rows, trades):
        names = [c.split()[0] for c in TRADES.split(", ")]
        out = pd.DataFrame(trades, columns=names)
        for c in ("entry_ts", "exit_ts"):
            out[c] = group["ts"].to_numpy()[out[c].to_numpy(int)]
        return out

    return _grouped(frame, setup, keys, TRADES, take)


def simulate(frame: DataFrame, setup: Setup = Setup(), keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Bars and trades of one pass: (keys, ts, mid_close, equity, ..., closed), the last an array of the trades that the bar closed."""

    def take(group, rows, trades):
        out = pd.DataFrame(rows, columns=["equity", "position", "cum_spread_cost", "cum_commission"]).astype({"position": int})
        out.insert(0, "ts", group["ts"])
        out.insert(1, "mid_close", group["mid_close"])
        closed: list[list[dict]] = [[] for _ in range(len(group))]
        for t in trades:
            closed[t[3]].append({"pnl": float(t[5]), "bars_held": int(t[6])})
        return out.assign(closed=closed)

    return _grouped(frame, setup, keys, f"ts timestamp_ntz, mid_close double, {BARS}, closed array<struct<pnl: double, bars_held: int>>", take)


def metrics(simulated: DataFrame, setup: Setup = Setup(), keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """One row of results for each group of ``simulate``'s rows, after the warm-up.

    The rows are written once, so a group passes through the simulator once; days are put
    together first, and the median trade comes from counts of values, not from a list of trades.
    """
    order = Window.partitionBy(*keys).orderBy("ts")
    live = simulated.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > setup.warmup)
    live = live.withColumn("_fall", F.col("equity") - F.max("equity").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    live = once(live, "metrics")
    of = lambda what: F.sum(F.aggregate("closed", F.lit(0.0), lambda a, t: a + what(t)))
    days = live.groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.max_by("equity", "ts").alias("last"), F.min_by("equity", "ts").alias("first"), F.max("ts").alias("_to"), F.min("ts").alias("_from"), F.sum("mid_close").alias("_prices"),
        F.count("mid_close").alias("_bars"), F.min("_fall").alias("_fall"), F.max_by("cum_spread_cost", "ts").alias("_spread"), F.max_by("cum_commission", "ts").alias("_fees"),
        F.sum(F.size("closed")).alias("_trades"), of(lambda t: t["pnl"]).alias("_pnl"), of(lambda t: t["bars_held"].cast("double")).alias("_held"),
        of(lambda t: (t["pnl"] > 0).cast("double")).alias("_won"),
    )
    days = days.withColumn("d", F.col("last") - F.lag("last").over(Window.partitionBy(*keys).orderBy("day")))
    out = days.groupBy(*keys).agg(
        (F.max_by("last", "day") - F.min_by("first", "day")).alias("total_pnl"),
        ((F.unix_micros(F.max("_to").cast("timestamp")) - F.unix_micros(F.min("_from").cast("timestamp"))) / 1e6 / (365.25 * 86400)).alias("_years"),
        (F.sum("_prices") / F.sum("_bars")).alias("avg_price"), F.min("_fall").alias("max_drawdown"), F.max_by("_spread", "day").alias("cum_spread_cost"), F.max_by("_fees", "day").alias("cum_commission"),
        F.avg("d").alias("_mean"), F.stddev_samp("d").alias("_sd"),
        *[F.sum(c).alias(c) for c in ("_trades", "_pnl", "_held", "_won")],
    )
    middle = quantiles(live.select(*keys, F.inline("closed")), list(keys), "pnl", {"_middle": 0.5})
    out = out.join(middle, list(keys), "left")
    n = F.col("_trades")
    mean = lambda x: F.when(n > 0, F.col(x) / n).otherwise(0.0)
    out = out.withColumns(
        {"n_trades": n.cast("long"), "win_rate": mean("_won"), "avg_trade_pnl": mean("_pnl"), "median_trade_pnl": F.coalesce("_middle", F.lit(0.0)), "avg_bars_held": mean("_held")}
    )
    value = setup.notional * F.col("avg_price")
    costs = F.col("cum_spread_cost") + F.col("cum_commission")
    gained = F.when(F.col("total_pnl") != 0, F.abs("total_pnl"))
    yearly = F.when(F.col("_years") > 0, F.col("total_pnl") / F.col("_years")).otherwise(0.0)
    return out.select(
        *keys, "total_pnl", yearly.alias("annualized_pnl"), "avg_price",
        (F.col("total_pnl") / value).alias("return_pct_of_notional"), (yearly / value).alias("annualized_return_pct"),
        F.coalesce(F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * F.sqrt(F.lit(252.0))), F.lit(0.0)).alias("sharpe"),
        "max_drawdown", (F.col("max_drawdown") / value).alias("max_drawdown_pct_of_notional"),
        "n_trades", "win_rate", "avg_trade_pnl", "median_trade_pnl", "avg_bars_held", "cum_spread_cost", "cum_commission",
        (F.col("cum_spread_cost") / gained).alias("spread_pct_abs"), (F.col("cum_commission") / gained).alias("commission_pct_abs"), (costs / gained).alias("costs_pct_abs"),
    )
