"""Results as text and pictures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row


def number(x, digits: int = 2) -> str:
    return "n/a" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:,.{digits}f}"


def percent(x, digits: int = 2) -> str:
    return "n/a" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{100 * x:.{digits}f} %"


def format_metrics(row: Row, title: str = "") -> str:
    """One row of ``simulate.metrics`` as a table of text."""
    lines = [
        ("total", f"{number(row['total_pnl'])} ({percent(row['return_pct_of_notional'])})"),
        ("a year", f"{number(row['annualized_pnl'])} ({percent(row['annualized_return_pct'])})"),
        ("Sharpe", number(row["sharpe"])),
        ("largest fall", f"{number(row['max_drawdown'])} ({percent(row['max_drawdown_pct_of_notional'])})"),
        ("trades", f"{row['n_trades']:,}, {percent(row['win_rate'], 1)} won, {number(row['avg_bars_held'], 1)} bars each"),
        ("a trade", f"mean {number(row['avg_trade_pnl'])}, median {number(row['median_trade_pnl'])}"),
        ("costs", f"spread {number(row['cum_spread_cost'])}, commission {number(row['cum_commission'])}, {percent(row['costs_pct_abs'], 1)} of the result"),
    ]
    return "\n".join([title or row["pair"], *(f"  {name:<14}{text}" for name, text in lines)])


def equity_curves(equity: DataFrame, path: str, points: int = 2000) -> None:
    """A picture of each pair's daily closing equity; needs matplotlib."""
    try:
        import matplotlib
    except ImportError as absent:
        raise RuntimeError("pictures need matplotlib") from absent
    matplotlib.use("Agg")
    import matplotlib.pyplot as plt
    from pyspark.sql import functions as F

    daily = equity.groupBy("pair", F.to_date("ts").alias("day")).agg(F.max_by("equity", "ts").alias("equity")).orderBy("pair", "day")
    shown, axis = plt.subplots(figsize=(9, 5))
    for pair, rows in daily.toPandas().groupby("pair"):
        step = max(1, len(rows) // points)
        axis.plot(rows["day"].iloc[::step], rows["equity"].iloc[::step], label=pair)
    axis.legend()
    shown.savefig(path)
    plt.close(shown)
