"""New York session calendar as column expressions. Times are UTC wall times without a zone (TIMESTAMP_NTZ).

A session starts at 17:00 New York; everything is computed in New York wall time,
so it follows both clock changes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
SPANS = {"2h": 2, "4h": 4, "daily": 24, "weekly": 24 * 5}


def to_wall(ts: Column, zone: str = NEW_YORK) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def from_wall(wall: Column, zone: str = NEW_YORK) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def hours(n) -> Column:
    return F.make_dt_interval(hours=F.lit(n) if isinstance(n, int) else n)


def _day(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def monday_first(ts: Column) -> Column:
    return F.weekday(ts)


def session_key(ts: Column, period: str) -> Column:
    """The session's name: its New York start moved by 7 hours, so that 17:00 is the next midnight."""
    moved = to_wall(ts) + hours(7)
    if period == "daily":
        return _day(moved)
    if period == "weekly":
        return _day(F.date_sub(F.to_date(moved), F.weekday(moved)))
    if period in ("2h", "4h"):
        n = SPANS[period]
        return _day(moved) + F.make_dt_interval(hours=(F.floor(F.hour(moved) / n) * n).cast("int"))
    raise ValueError(f"no session period {period!r}")


def session_label(key: Column) -> Column:
    """UTC start of a session."""
    return from_wall(key - hours(7))


def session_close(label: Column, period: str) -> Column:
    """UTC close: the label and the period's span in wall time; a week closes on Friday."""
    return from_wall(to_wall(label) + hours(SPANS[period]))


def trading_day(ts: Column) -> Column:
    return F.to_date(to_wall(ts) + hours(7))


def next_close(ts: Column) -> Column:
    """The first 17:00 New York after ts."""
    wall = to_wall(ts)
    today = _day(wall) + hours(17)
    return from_wall(F.when(wall < today, today).otherwise(today + hours(24)))


def minute_of_week(ts: Column, zone: str = NEW_YORK) -> Column:
    wall = to_wall(ts, zone)
    return (F.weekday(wall) * 1440 + F.hour(wall) * 60 + F.minute(wall)).cast("int")


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds; the session time zone must be UTC."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def calendar_columns(ts: Column, horizon_minutes: int) -> dict[str, Column]:
    """Minutes to the next close and what that close is. No holidays by design."""
    minutes = F.floor(seconds_between(ts, next_close(ts)) / 60).cast("long")
    friday = F.weekday(to_wall(next_close(ts))) == 4
    return {
        "minutes_to_close": minutes,
        "bars_to_gap": minutes,
        "spans_gap": minutes < horizon_minutes,
        "is_friday": friday,
        "gap_type": F.when(minutes >= horizon_minutes, "none").when(friday, "weekend").otherwise("daily_reset"),
    }


def gap_kind(start: Column, end: Column, step_minutes: int = 1) -> Column:
    """weekend, daily_reset or active: what the bars missing between two neighbours are."""
    step = F.make_dt_interval(mins=F.lit(step_minutes))
    first, last = to_wall(start + step), to_wall(end - step)
    minutes = lambda n: F.make_dt_interval(mins=F.lit(n))
    back = F.pmod(F.weekday(first) - 4, F.lit(7))
    friday = _day(F.date_sub(F.to_date(first), back)) + hours(17)
    weekend = (seconds_between(start, end) >= 86400) & (first >= friday - minutes(5)) & (last <= friday + hours(48) + minutes(20))
    anchor = _day(first) + hours(17)
    reset = (F.weekday(first) <= 3) & (F.to_date(first) == F.to_date(last)) & (first >= anchor - minutes(5)) & (last <= anchor + minutes(20))
    return F.when(weekend, "weekend").when(reset, "daily_reset").otherwise("active")
