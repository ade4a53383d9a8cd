"""Feature families put together: one timeframe's own columns, other timeframes' blocks, excursions; and the names of what comes out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import features
from tidewright.operators.asof import asof_many
from tidewright.operators.slices import over_slices

BLOCK = ("bb_position", "bb_width_atr", "rsi_14", "atr_bps")
EXCURSION = ("run_above", "run_below", "depth", "since_crossing")
SHARES = ("frac_above", "frac_below")
#: Windows of a column, in its name.
SHARE_WINDOW = 20


def apply_pipeline(bars: DataFrame, ema_spans=features.EMA_SPANS, windows=features.DONCHIAN) -> DataFrame:
    """Trend, volatility, momentum, direction, channels, candles, spread and clock of one bar frame, from its own rows only, over slices of its time."""
    steps = (
        features.returns,
        features.return_std,
        features.bollinger,
        lambda f: features.donchian_position(features.donchian(f, windows), windows),
        features.candles,
        features.spread_statistics,
        features.clock,
    )
    reach = max(*features.RETURNS, *windows, 60) + 1
    own = features.recurrences(bars, ema_spans, pieces=True)
    return over_slices(own, lambda f: reduce(lambda frame, step: frame.transform(step), steps, f), reach, counted=bars)


def column_name(stem: str, tf: str) -> str:
    """A column of another timeframe; shares of time carry their window."""
    return f"{stem}_{SHARE_WINDOW}_{tf}" if stem in SHARES else f"{stem}_{tf}"


def htf_columns(timeframes: list[str]) -> list[str]:
    own = [column_name(stem, tf) for tf in timeframes for stem in BLOCK]
    return [*own, *[f"bb_pos_spread_{tf}" for tf in timeframes], "tf_stretch_count", "tf_stretch_max", "regime_daily", "regime_daily_active", "gate_cell_d", "gate_stack"]


def excursion_columns(timeframes: list[str]) -> list[str]:
    return [*[column_name(stem, tf) for tf in timeframes for stem in (*EXCURSION, *SHARES)], "spread_pctile_slot", "spread_pctile"]


def moment_columns(windows=(96, 24), z_window: int | None = None) -> list[str]:
    names = ("ret_skew", "ret_kurt", "semidev_down", "semidev_up", "bowley_skew", "moors_kurt", "semidev_ratio")
    return [f"{n}_{w}" for w in windows for n in names] + [f"{n}_divergence_{w}" for w in windows for n in ("skew", "kurt") if z_window]


def label_columns(widths: list[float]) -> list[str]:
    from tidewright.operators.labels import tag

    return [f"{n}_{tag(k)}" for k in widths for n in ("label", "bars", "touch_price", "ambiguous")]


def _checked(frames: dict[str, DataFrame], wanted: tuple[str, ...], timeframes: list[str]) -> None:
    if absent := [tf for tf in timeframes if tf not in frames]:
        raise KeyError(f"no frame of {absent}")
    for tf in timeframes:
        if absent := [c for c in wanted if c not in frames[tf].columns]:
            raise KeyError(f"{tf} lacks {absent}")


def with_higher_timeframes(base: DataFrame, frames: dict[str, DataFrame], timeframes: list[str], spread_max: float, regime: str = "daily") -> DataFrame:
    """``base`` with each timeframe's block as of its last close, distances to it, how many are stretched, the regime and the gates.

    Every frame needs bands, atr_14 and rsi_14 of its own bars; that of ``regime`` needs
    its rule's signal as well. One union and one window serve all timeframes.
    """
    _checked(frames, ("bb_upper", "bb_lower", "bb_middle", "atr_14", "rsi_14", "mid_close"), timeframes)
    _checked(frames, ("signal",), [regime])
    sources = [(features.timeframe_block(frames[tf]), list(BLOCK), tf, f"_{tf}") for tf in timeframes]
    sources.append((frames[regime].withColumnRenamed("signal", "regime"), ["regime"], regime, "_daily"))
    out = asof_many(base, sources)
    own = features.band_position()
    out = out.withColumns({f"bb_pos_spread_{tf}": own - F.col(f"bb_position_{tf}") for tf in timeframes})
    out = out.withColumns(features.stretch([f"bb_position_{tf}" for tf in timeframes]))
    out = out.withColumn("regime_daily", F.coalesce("regime_daily", F.lit(0)).cast("int"))
    out = out.withColumn("regime_daily_active", F.col("regime_daily") != 0)
    return out.withColumns({"gate_cell_d": features.gate_cell_d(), "gate_stack": features.gate_stack(spread_max)})


def with_excursions(base: DataFrame, frames: dict[str, DataFrame], timeframes: list[str], weeks: int = 52, spread_window: int = 1000) -> DataFrame:
    """``base`` with each timeframe's excursions, counted on that timeframe's own bars and only then projected, and the ranks of its spread."""
    _checked(frames, ("bb_upper", "bb_lower", "mid_close"), timeframes)
    sources = []
    for tf in timeframes:
        own = features.excursion(frames[tf].withColumn("bb_position", features.band_position()), window=SHARE_WINDOW)
        named = own.select("pair", "ts", *[F.col(c).alias(column_name(c, tf)) for c in (*EXCURSION, *SHARES)])
        sources.append((named, [column_name(c, tf) for c in (*EXCURSION, *SHARES)], tf, ""))
    out = features.slot_rank(asof_many(base, sources), weeks)
    return features.rolling_rank(out, "spread_close", spread_window, "spread_pctile")
