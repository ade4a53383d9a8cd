"""Triple-barrier labels: which of two levels around the next open is touched first within ``horizon`` traded bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import calendar
from tidewright.functions.rolling import following
from tidewright.operators import folds
from tidewright.operators.slices import over_slices


def tag(k: float) -> str:
    return str(float(k)).replace(".", "_")


def triple_barrier(bars: DataFrame, widths=(1.0, 1.5, 2.0, 2.5, 3.0), horizon: int = 240, atr: str = "atr", slice_rows: int | None = None) -> DataFrame:
    """Per width: label, bars, touch_price, ambiguous; needs mid prices and the entry ATR as a column.

    Both levels on one bar are a loss, marked ambiguous. The last ``horizon`` rows
    and rows without ATR have no label. First touches come from tables of the extremes of 1, 2, 4, ...
    bars, so that a row costs the logarithm of the horizon for each level; slices of time have the bars ahead as a halo.
    """
    touched = {}
    for k in widths:
        touched[f"_up_{tag(k)}"] = lambda high, low, anchor, width, k=k: folds.first_reach(high, anchor + k * width, horizon)
        touched[f"_down_{tag(k)}"] = lambda high, low, anchor, width, k=k: folds.first_reach(-low, k * width - anchor, horizon)

    def reached(frame: DataFrame) -> DataFrame:
        ahead = {
            "anchor": following("mid_open"),
            "anchor_ts": following("ts"),
            "time_barrier_bps": (following("mid_close", horizon) - following("mid_open")) / following("mid_open") * 1e4,
            "_whole": following("ts", horizon).isNotNull(),
        }
        return folds.fold(frame.withColumns(ahead), ["mid_high", "mid_low", "anchor", atr], touched)

    out = over_slices(bars, reached, 0, horizon, slice_rows)
    ok = F.col("_whole") & F.col(atr).isNotNull() & F.col("anchor").isNotNull()
    for k in widths:
        t = tag(k)
        up, down = F.col("anchor") + k * F.col(atr), F.col("anchor") - k * F.col(atr)
        u, d = (F.col(f"_{side}_{t}").cast("int") for side in ("up", "down"))
        label = F.when((d > 0) & ((u == 0) | (d <= u)), -1).when(u > 0, 1).otherwise(0)
        out = out.withColumns(
            {
                f"label_{t}": F.when(ok, label),
                f"bars_{t}": F.when(ok, F.when(label == -1, d).when(label == 1, u).otherwise(horizon).cast("int")),
                f"touch_price_{t}": F.when(ok, F.when(label == -1, down).when(label == 1, up)),
                f"ambiguous_{t}": ok & (u > 0) & (u == d),
            }
        )
    return out.drop("_whole", *touched)


def with_calendar(labels: DataFrame, horizon_minutes: int = 240) -> DataFrame:
    """Calendar columns of the time of entry."""
    return labels.withColumns(calendar.calendar_columns(F.col("anchor_ts"), horizon_minutes))
