"""The queries as SQL for DuckDB, from their definitions: closed forms for recurrences, joins on row numbers for
frames, recursion for state machines, islands for trades."""

from __future__ import annotations

_NY = "America/New_York"


def _wall(ts: str, zone: str = _NY) -> str:
    return f"timezone('{zone}', timezone('UTC', {ts}))"


def _utc(wall: str) -> str:
    return f"timezone('UTC', timezone('{_NY}', {wall}))"


def _utc_first(wall: str) -> str:
    """Of an hour that comes twice, the first."""
    hour_before = f"({_utc(wall)} - interval 1 hour)"
    return f"case when {_wall(hour_before)} = {wall} then {hour_before} else {_utc(wall)} end"


def _r(names, digits: int = 6, **renamed) -> str:
    return ", ".join(f"round({x}, {digits}) + 0.0::double as {n}" for n, x in [*((n, n) for n in names), *renamed.items()])


_SIDES = [f"{p}_{s}" for s in ("bid", "ask") for p in ("open", "high", "low", "close")]
_MIDS = ["mid_open", "mid_high", "mid_low", "mid_close", "spread_close"]

_TICK = """
spreads as (select event_type as pair, ts, value as mid, value * (1 + cast(json_extract(props, '$.k') as int)) / 200000.0::double as half from events),
tick as (select pair, ts, mid, mid - half as bid, mid + half as ask from spreads),
bs as (select date_trunc('day', min(ts)) + interval 2 day as s from tick)"""


def _bars(name: str, label: str, source: str = "tick") -> str:
    sides = ", ".join(f"arg_min({s}, ts) as open_{s}, max({s}) as high_{s}, min({s}) as low_{s}, arg_max({s}, ts) as close_{s}" for s in ("bid", "ask"))
    mids = ", ".join(f"({p}_bid + {p}_ask) / 2 as mid_{p}" for p in ("open", "high", "low", "close"))
    return f"""
{name}_g as (select pair, {label} as label, {sides}, count(*) as n_minutes from {source} group by pair, label),
{name} as (select pair, label as ts, * exclude (pair, label), {mids}, greatest(close_ask - close_bid, 0) as spread_close,
  row_number() over (partition by pair order by label) as rn from {name}_g)"""


def _key(ts: str, period: str) -> str:
    moved = f"({_wall(ts)} + interval 7 hour)"
    if period == "daily":
        return f"date_trunc('day', {moved})"
    if period == "weekly":
        return f"date_trunc('week', {moved})"
    n = int(period[0])
    return f"(date_trunc('day', {moved}) + to_hours(cast(floor(hour({moved}) / {n}) * {n} as int)))"


def _label(ts: str, period: str) -> str:
    return _utc(f"({_key(ts, period)} - interval 7 hour)")


_SPAN = {"2h": "2 hour", "4h": "4 hour", "daily": "24 hour", "weekly": "120 hour"}


def _close(ts: str, period: str) -> str:
    return f"{ts} + interval 1 hour" if period == "1h" else _utc(f"({_wall(ts)} + interval {_SPAN[period]})")


_H = _TICK + "," + _bars("h", "time_bucket(interval '1 hour', ts)")


def _session(period: str, name: str = "s") -> str:
    return _bars(name, _label("ts", period))


def _with(*parts: str) -> str:
    return "with recursive " + ",".join(p.strip().strip(",") for p in parts)


_W = "partition by pair order by ts"


def _frame(n: int) -> str:
    return f"({_W} rows between {n - 1} preceding and current row)"


def _full(value: str, x: str, n: int, frame: str | None = None) -> str:
    frame = frame or _frame(n)
    return f"case when count({x}) over {frame} = {n} then {value} over {frame} end"


def _bands(name: str, source: str, window: int = 20, k: float = 2.0) -> str:
    mid, sd = _full("avg(mid_close)", "mid_close", window), _full("stddev_samp(mid_close)", "mid_close", window)
    return f"""
{name}_m as (select *, {mid} as bb_middle, {sd} as sd from {source}),
{name}_b as (select *, bb_middle + {k}::double * sd as bb_upper, bb_middle - {k}::double * sd as bb_lower from {name}_m),
{name} as (select *, (mid_close - bb_lower) / nullif(bb_upper - bb_lower, 0) as bb_pct_b from {name}_b)"""


def _ema(name: str, source: str, x: str, alpha: float) -> str:
    """Closed form of e0 = x0, e = a x + (1 - a) e."""
    a = f"{alpha!r}::double"
    return f"""
{name} as (select t.pair, t.rn, sum(o.{x} * case when o.rn = 1 then pow(1 - {a}, t.rn - 1) else {a} * pow(1 - {a}, t.rn - o.rn) end) as v
  from {source} t join {source} o on t.pair = o.pair and o.rn <= t.rn group by t.pair, t.rn)"""


def _rma(name: str, source: str, x: str, period: int, start: int) -> str:
    """Closed form of the smoother that a mean of ``period`` values seeds; rows count from 1, so the seed is row start + period."""
    a, seed = f"(1.0::double / {period})", start + period
    return f"""
{name} as (select t.pair, t.rn, sum(o.{x} * case when o.rn <= {seed} then pow(1 - {a}, t.rn - {seed}) / {period} else {a} * pow(1 - {a}, t.rn - o.rn) end) as v
  from {source} t join {source} o on t.pair = o.pair and o.rn <= t.rn and o.rn > {start} where t.rn >= {seed} group by t.pair, t.rn)"""


def _changes(name: str, source: str) -> str:
    before = lambda c: f"lag({c}) over ({_W})"
    return f"""
{name} as (select *, greatest(mid_high - mid_low, abs(mid_high - {before('mid_close')}), abs(mid_low - {before('mid_close')})) as tr,
  greatest(mid_close - {before('mid_close')}, 0.0::double) as gain, greatest({before('mid_close')} - mid_close, 0.0::double) as loss,
  coalesce(case when mid_high - {before('mid_high')} > {before('mid_low')} - mid_low and mid_high > {before('mid_high')} then mid_high - {before('mid_high')} end, 0.0::double) as up,
  coalesce(case when {before('mid_low')} - mid_low > mid_high - {before('mid_high')} and mid_low < {before('mid_low')} then {before('mid_low')} - mid_low end, 0.0::double) as dn
  from {source})"""


def _rsi(name: str, changes: str, period: int) -> str:
    return f"""{_rma(name + '_g', changes, 'gain', period, 1)}, {_rma(name + '_l', changes, 'loss', period, 1)},
{name} as (select g.pair, g.rn, case when l.v < 1e-300 then case when g.v < 1e-300 then 50.0 else 100.0 end else 100 - 100 / (1 + g.v / l.v) end as v
  from {name}_g g join {name}_l l using (pair, rn))"""


_CH = _changes("ch", "h")
_ATR = _ema("atr", "ch", "tr", 1 / 14)
_RSI = _rsi("rsi", "ch", 14)
SQL: dict[str, str] = {}


def _add(name: str, *parts: str, select: str) -> None:
    SQL[name] = f"{_with(*parts)}\n{select}"


_add("bars_1h", _H, select=f"select pair, ts, n_minutes, {_r([*_SIDES, *_MIDS], 9)} from h")
for _p in _SPAN:
    _add(f"bars_{_p}_session", _TICK, _session(_p), select=f"select pair, ts, {_close('ts', _p)} as close_ts, n_minutes, {_r([*_SIDES, *_MIDS], 9)} from s")


def _gaps(source: str, step: int) -> str:
    first, last = _wall(f"(a + interval {step} minute)"), _wall(f"(b - interval {step} minute)")
    friday = f"(date_trunc('day', {first}) - to_days(cast((isodow({first}) + 2) % 7 as int)) + interval 17 hour)"
    anchor = f"(date_trunc('day', {first}) + interval 17 hour)"
    return f"""
steps as (select pair, lag(ts) over ({_W}) as a, ts as b from {source}),
gap as (select *, (epoch_us(b) - epoch_us(a)) / 60000000.0::double as minutes from steps where epoch_us(b) - epoch_us(a) > {step * 60000000}),
gaps as (select pair, minutes, case
  when minutes >= 1440 and {first} >= {friday} - interval 5 minute and {last} <= {friday} + interval 48 hour + interval 20 minute then 'weekend'
  when isodow({first}) <= 4 and date_trunc('day', {first}) = date_trunc('day', {last}) and {first} >= {anchor} - interval 5 minute and {last} <= {anchor} + interval 20 minute then 'daily_reset'
  else 'active' end as kind from gap)"""


_add("gap_classes", _H, _gaps("h", 60), select="select pair, kind, count(*) as n, round(max(minutes), 6) as longest from gaps group by pair, kind")
_DAYS = f"days as (select distinct o_orderpriority as pair, {_utc('(cast(cast(o_orderdate as date) as timestamp) + interval 17 hour)')} as ts from orders)"
_add("gap_classes_orders", _DAYS, _gaps("days", 1440), select="select pair, kind, count(*) as n, round(sum(minutes), 6) as minutes from gaps group by pair, kind")
_add(
    "session_keys_orders",
    "o as (select cast(cast(o_orderdate as date) as timestamp) + to_hours(cast(o_orderkey % 24 as int)) as ts from orders)",
    f"l as (select {_label('ts', 'daily')} as label_daily, {_label('ts', 'weekly')} as label_weekly, {_utc_first(f"({_key('ts', '4h')} - interval 7 hour)")} as label_h4 from o)",
    select="select label_daily, label_weekly, label_h4, count(*) as n from l group by all",
)
_add(
    "quality_summary", _H, _gaps("h", 60),
    "r as (select pair, count(*) as n_rows, min(ts) as first_ts, max(ts) as last_ts from h group by pair)",
    "g as (select pair, count(*) filter (kind = 'weekend') as n_weekend, count(*) filter (kind = 'daily_reset') as n_daily_reset, count(*) filter (kind = 'active') as n_active, max(case when kind = 'active' then minutes end) as largest_active from gaps group by pair)",
    select="select r.pair, n_rows, first_ts, last_ts, coalesce(n_weekend, 0) as n_weekend, coalesce(n_daily_reset, 0) as n_daily_reset, coalesce(n_active, 0) as n_active, round(largest_active, 6) as largest_active from r left join g using (pair)",
)
_BOTH = "sides as (select pair, 'bid' as side, ts from tick union all select pair, 'ask', ts from tick)"
_add(
    "common_window", _TICK, _BOTH, "e as (select pair, side, min(ts) as a, max(ts) as b from sides group by all)",
    select="select greatest(max(a), min(b) - interval 5 year) as start, min(b) as \"end\" from e",
)
_add("discover_pairs", _TICK, _BOTH, select="select pair from sides group by pair having count(distinct side) = 2")
_add(
    "upsert_keep_last",
    "e as (select event_type as pair, date_trunc('hour', ts) as ts, value, event_id, user_id from events)",
    "a as (select pair, ts, value, event_id, 0 as batch from e union all select pair, ts, value + 1000, event_id, 1 from e where user_id % 2 = 0)",
    select="select pair, ts, arg_max(event_id, batch * 1000000000000 + event_id) as event_id, round(arg_max(value, batch * 1000000000000 + event_id), 6) as value from a group by pair, ts",
)
_FLAT = ", ".join(f"{s} as {p}_{s}" for s in ("bid", "ask") for p in ("open", "high", "low", "close"))
_FLAT_MIDS = ", ".join(f"(bid + ask) / 2 as mid_{p}" for p in ("open", "high", "low", "close"))
_add(
    "bid_ask_inner_join", _TICK,
    f"j as (select pair, ts, {_FLAT}, {_FLAT_MIDS}, greatest(ask - bid, 0) as spread_close from tick)",
    select=f"select pair, ts, {_r([*_SIDES, *_MIDS], 9)} from j",
)
_add("log_returns", _H, select="select pair, ts, " + ", ".join(f"round(ln(mid_close) - ln(lag(mid_close, {k}) over ({_W})), 9) as log_ret_{k}" for k in (1, 5, 15, 60)) + " from h")
_LR = f"lr as (select *, ln(mid_close) - ln(lag(mid_close) over ({_W})) as r from h)"
_add("ret_std", _H, _LR, select="select pair, ts, " + ", ".join(f"round({_full('stddev_samp(r)', 'r', w)}, 6) as ret_std_{w}" for w in (15, 60)) + " from lr")
_add(
    "bollinger", _H, _bands("b", "h"),
    select=f"select pair, ts, n_minutes, case when mid_close <= bb_lower then 1 when mid_close >= bb_upper then -1 else 0 end as side, {_r(['mid_close', 'bb_lower', 'bb_middle', 'bb_upper', 'bb_pct_b'])} from b",
)


def _channel(windows) -> str:
    prior = lambda w: f"({_W} rows between {w} preceding and 1 preceding)"
    cols = ", ".join(f"{_full('max(mid_high)', 'mid_high', w, prior(w))} as donchian_high_{w}, {_full('min(mid_low)', 'mid_low', w, prior(w))} as donchian_low_{w}" for w in windows)
    return f"dc as (select *, {cols} from h)"


_add(
    "donchian", _H, _channel((60, 180)),
    select="select pair, ts, " + ", ".join(f"round(donchian_high_{w}, 6) as donchian_high_{w}, round(donchian_low_{w}, 6) as donchian_low_{w}, round((mid_close - donchian_low_{w}) / nullif(donchian_high_{w} - donchian_low_{w}, 0), 6) as donchian_pos_{w}" for w in (60, 180)) + " from dc",
)
_CANDLE = """c as (select *, abs(mid_close - mid_open) as body, greatest(mid_high - greatest(mid_open, mid_close), 0) as upper_wick, greatest(least(mid_open, mid_close) - mid_low, 0) as lower_wick, mid_high - mid_low as bar_range from h)"""
_PRIOR20 = f"({_W} rows between 20 preceding and 1 preceding)"
_add(
    "wick", _H, _CANDLE, f"w as (select *, {_full('avg(upper_wick + lower_wick)', 'upper_wick', 20, _PRIOR20)} as usual from c)",
    select=f"select pair, ts, {_r(['body', 'upper_wick', 'lower_wick', 'bar_range'], body_frac='body / nullif(bar_range, 0)', upper_wick_frac='upper_wick / nullif(bar_range, 0)', lower_wick_frac='lower_wick / nullif(bar_range, 0)', wick_imbalance='(upper_wick - lower_wick) / nullif(bar_range, 0)', upper_wick_rel='case when usual > 0 then upper_wick / usual end', lower_wick_rel='case when usual > 0 then lower_wick / usual end')} from w",
)
_add(
    "spread_stats", _H,
    "m as (select *, " + ", ".join(f"{_full('avg(spread_close)', 'spread_close', w)} as m{w}" for w in (15, 60)) + f", {_full('stddev_samp(spread_close)', 'spread_close', 60)} as sd from h)",
    select=f"select pair, ts, {_r([], spread_mean_15='m15', spread_ratio_15='spread_close / nullif(m15, 0)', spread_mean_60='m60', spread_ratio_60='spread_close / nullif(m60, 0)', spread_z_60='(spread_close - m60) / nullif(sd, 0)')} from m",
)


def _open(zone: str, a: int, b: int) -> str:
    w = _wall("ts", zone)
    return f"cast(isodow({w}) <= 5 and hour({w}) >= {a} and hour({w}) < {b} as tinyint)"


_add(
    "time_features", _H,
    f"o as (select *, {_open('Asia/Tokyo', 9, 18)} as session_tokyo, {_open('Europe/London', 8, 17)} as session_london, {_open(_NY, 8, 17)} as session_ny from h)",
    select="select pair, ts, session_tokyo, session_london, session_ny, cast(session_london * session_ny as tinyint) as session_overlap, "
    + _r([], 9, hour_sin="sin(2 * pi() * hour(ts) / 24.0::double)", hour_cos="cos(2 * pi() * hour(ts) / 24.0::double)", dow_sin="sin(2 * pi() * (isodow(ts) - 1) / 7.0::double)", dow_cos="cos(2 * pi() * (isodow(ts) - 1) / 7.0::double)")
    + " from o",
)
_MASK = f"""st as (select *, epoch_us(ts) - epoch_us(lag(ts) over ({_W})) as step, ln(mid_close) - ln(lag(mid_close) over ({_W})) as lr from h),
sc as (select pair, step, count(*) as n from st where step is not null group by pair, step),
us as (select pair, arg_max(step, n * 1e15 - step) as usual from sc group by pair),
mr as (select st.*, case when step <= usual then lr end as r from st left join us using (pair))"""
_add("masked_returns", _H, _MASK, select="select pair, ts, round(r, 9) as r from mr")


def _moments(w: int) -> str:
    f, least = _frame(w), max(4, -(-w // 2))
    ready = f"rn > {w} and count(r) over {f} >= {least}"
    q = ", ".join(f"quantile_cont(r, {k / 8}) over {f} as e{k}" for k in range(1, 8))
    return f"""mo{w} as (select pair, ts, {ready} as ready, stddev_samp(r) over {f} as sd, skewness(r) over {f} as sk, kurtosis(r) over {f} as ku, {q},
  sqrt(avg(case when r is not null then pow(least(r, 0), 2) end) over {f}) * 1e4 as sd_down, sqrt(avg(case when r is not null then pow(greatest(r, 0), 2) end) over {f}) * 1e4 as sd_up from mr),
mx{w} as (select pair, ts, {_r([], **{f'ret_skew_{w}': 'case when ready and sd > 0 then sk end', f'ret_kurt_{w}': 'case when ready and sd > 0 then ku end', f'bowley_skew_{w}': 'case when ready and abs(e6 - e2) > 1e-12 then (e6 + e2 - 2 * e4) / (e6 - e2) end', f'moors_kurt_{w}': 'case when ready and abs(e6 - e2) > 1e-12 then ((e7 - e5) + (e3 - e1)) / (e6 - e2) end', f'semidev_down_{w}': 'case when ready then sd_down end', f'semidev_up_{w}': 'case when ready then sd_up end', f'semidev_ratio_{w}': 'case when ready then sd_down / nullif(sd_up, 0) end'})} from mo{w})"""


_add("moments", _H, _MASK, _moments(48), _moments(24), select="select * from mx48 join mx24 using (pair, ts)")


def _rank(source: str, part: str, n: int) -> str:
    return f"""rk as (select t.pair, t.ts, case when count(o.spread_close) = {n} then (count(*) filter (o.spread_close < t.spread_close) + (count(*) filter (o.spread_close = t.spread_close) + 1) / 2.0::double) / {n} end as v
  from {source} t join {source} o on t.pair = o.pair and {part} and o.k between t.k - {n - 1} and t.k group by t.pair, t.ts, t.spread_close)"""


_add("trailing_rank", _H, "nk as (select *, rn as k from h)", _rank("nk", "true", 24), select='select pair, ts, round(v, 6) as "rank" from rk')
_add("trailing_z", _H, select=f"select pair, ts, round((spread_close - {_full('avg(spread_close)', 'spread_close', 100)}) / nullif({_full('stddev_samp(spread_close)', 'spread_close', 100)}, 0), 6) as z from h")
_SLOT = f"((isodow({_wall('ts')}) - 1) * 1440 + hour({_wall('ts')}) * 60 + minute({_wall('ts')}))"
_add(
    "slot_rank", _H, f"sl as (select *, {_SLOT} as slot from h)", "nk as (select *, row_number() over (partition by pair, slot order by ts) as k from sl)",
    _rank("nk", "t.slot = o.slot", 3), select="select pair, ts, round(v, 6) as spread_pctile_slot from rk",
)
_add(
    "ema_macd", _H, *[_ema(f"e{n}", "h", "mid_close", 2 / (n + 1)) for n in (9, 21, 12, 26)],
    "md as (select pair, rn, e12.v - e26.v as m from e12 join e26 using (pair, rn))", _ema("sg", "md", "m", 0.2),
    select=f"select pair, ts, {_r([], ema_9='e9.v', dist_ema_9='(mid_close - e9.v) / e9.v', ema_21='e21.v', dist_ema_21='(mid_close - e21.v) / e21.v', macd='m', macd_signal='sg.v', macd_hist='m - sg.v')} from h join e9 using (pair, rn) join e21 using (pair, rn) join md using (pair, rn) join sg using (pair, rn)",
)
_add("atr", _H, _CH, _ATR, select="select pair, ts, round(v, 6) as atr_14 from h join atr using (pair, rn)")
_add("rsi", _H, _CH, _RSI, _rsi("rsj", "ch", 2), select="select pair, ts, round(rsi.v, 6) as rsi_14, round(rsj.v, 6) as rsi_2 from h left join rsi using (pair, rn) left join rsj using (pair, rn)")
_add(
    "adx", _H, _CH, _rma("ra", "ch", "tr", 14, 1), _rma("pu", "ch", "up", 14, 1), _rma("mi", "ch", "dn", 14, 1),
    "di as (select pair, rn, 100 * pu.v / ra.v as p, 100 * mi.v / ra.v as m from ra join pu using (pair, rn) join mi using (pair, rn))",
    "dx as (select pair, rn, coalesce(100 * abs(p - m) / nullif(p + m, 0), 0.0) as x from di)", _rma("ad", "dx", "x", 14, 14),
    select=f"select pair, ts, {_r([], plus_di_14='p', minus_di_14='m', adx_14='ad.v', di_spread_14='p - m')} from h left join di using (pair, rn) left join ad using (pair, rn)",
)


def _asof(target: str, source: str, columns: str, tf: str) -> str:
    return f"from {target} t asof left join (select pair, {_close('ts', tf)} as close_ts, {columns} from {source}) c on t.pair = c.pair and t.ts >= c.close_ts"


_add("asof_closed_bar", _H, select=f"select t.pair, t.ts, c.n_minutes as n_minutes_seen, round(c.mid_close, 6) as mid_close_seen {_asof('tick', 'h', 'n_minutes, mid_close', '1h')}")
_add("asof_weekly", _H, _session("weekly"), select=f"select t.pair, t.ts, round(c.mid_close, 6) as mid_close_seen {_asof('h', 's', 'mid_close', 'weekly')}")
_add(
    "htf_block", _H, _session("4h"), _bands("b", "s"), _changes("cs", "s"), _ema("sa", "cs", "tr", 1 / 14), _rsi("sr", "cs", 14),
    "blk as (select pair, ts, bb_pct_b as bb_position, (bb_upper - bb_lower) / nullif(sa.v, 0) as bb_width_atr, sr.v as rsi_14, case when mid_close > 0 then sa.v / mid_close * 1e4 end as atr_bps from b join sa using (pair, rn) left join sr using (pair, rn))",
    select=f"select t.pair, t.ts, {_r([], **{f'{c}_4h': f'c.{c}' for c in ('bb_position', 'bb_width_atr', 'rsi_14', 'atr_bps')})} {_asof('h', 'blk', 'bb_position, bb_width_atr, rsi_14, atr_bps', '4h')}",
)
_add(
    "tf_stretch", _H, _bands("b1", "h"), _session("2h", "s2"), _bands("b2", "s2"), _session("4h", "s4"), _bands("b4", "s4"),
    f"j2 as (select t.pair, t.ts, t.bb_pct_b as p1, c.bb_pct_b as p2 {_asof('b1', 'b2', 'bb_pct_b', '2h')})",
    f"j4 as (select t.*, c.bb_pct_b as p4 {_asof('j2', 'b4', 'bb_pct_b', '4h')})",
    "f as (select *, p1 is not null and p2 is not null and p4 is not null as ok, abs(p1 - 0.5) as f1, abs(p2 - 0.5) as f2, abs(p4 - 0.5) as f4 from j4)",
    select=f"select pair, ts, case when ok then cast(f1 > 0.5 as int) + cast(f2 > 0.5 as int) + cast(f4 > 0.5 as int) end as tf_stretch_count, {_r([], p_1h='p1', p_2h='p2', p_4h='p4', tf_stretch_max='case when ok then greatest(f1, f2, f4) end', spread_2h='p1 - p2')} from f",
)


def _machine(name: str, source: str, confirmed: str = "true", allowed: str = "true", known: str = "true") -> str:
    """State and lock of the band rule by recursion over row numbers."""
    side = "case when mid_close <= bb_lower then 1 when mid_close >= bb_upper then -1 else 0 end"
    return f"""
{name}_i as (select pair, rn, bb_middle is not null and {known} as ok, {side} as side, mid_close - bb_middle as off, {confirmed} as go, {allowed} as pay from {source}),
{name}_r(pair, rn, state, lock) as (
  select pair, cast(0 as bigint), 0, 0 from (select distinct pair from {name}_i)
  union all
  select i.pair, i.rn,
    case when not i.ok then 0
      when s.state = 1 then case when i.off >= 0 then 0 else 1 end
      when s.state = -1 then case when i.off <= 0 then 0 else -1 end
      when i.side <> 0 and i.side <> s.lock and i.go and i.pay then i.side else 0 end,
    case when not i.ok then 0
      when s.state = 1 then case when i.off >= 0 then 0 else s.lock end
      when s.state = -1 then case when i.off <= 0 then 0 else s.lock end
      when i.side = 0 then 0
      when i.side <> s.lock and i.go and not i.pay then i.side else s.lock end
  from {name}_r s join {name}_i i on i.pair = s.pair and i.rn = s.rn + 1),
{name} as (select pair, rn, state as signal from {name}_r where rn > 0)"""


_HB = _bands("hb", "h", 20, 0.8)
_REGIME = _TICK + "," + _bars("h", "time_bucket(interval '1 hour', ts)") + "," + _HB + "," + _session("daily", "sd") + "," + _bands("db", "sd", 5, 0.8) + "," + _machine("dm", "db") + f""",
dz as (select sd.pair, sd.ts, signal from sd join dm using (pair, rn)),
rg as (select t.*, coalesce(c.signal, 0) as regime_daily {_asof('hb', 'dz', 'signal', 'daily')})"""
_add("regime", _REGIME, select="select pair, ts, cast(regime_daily as int) as regime_daily, regime_daily <> 0 as regime_daily_active from rg")
_SIDE = "case when mid_close <= bb_lower then 1 when mid_close >= bb_upper then -1 else 0 end"
_add(
    "gate_cell_d", _REGIME, _CH, _RSI,
    select=f"select pair, ts, coalesce(case when {_SIDE} = 1 then rsi.v <= 30 when {_SIDE} = -1 then rsi.v >= 70 else false end and regime_daily <> 0, false) as gate_cell_d from rg left join rsi using (pair, rn)",
)


def _pays(notional: float, multiple: float) -> str:
    n = f"{notional}::double"
    leg = f"least(0.002::double * mid_close * {n}, greatest(2.0::double, 0.00002::double * mid_close * {n}))"
    return f"abs(bb_middle - mid_close) * {n} >= {multiple}::double * (spread_close * {n} + 2 * {leg})"


_add(
    "gate_stack", _H, _HB, _CH, _RSI,
    select=f"select pair, ts, coalesce(case when {_SIDE} = 1 then rsi.v <= 40 when {_SIDE} = -1 then rsi.v >= 60 else false end and {_pays(100000.0, 2.0)} and spread_close < 0.02, false) as gate_stack from hb left join rsi using (pair, rn)",
)
_SIGNAL = _H + "," + _HB + "," + _machine("sig", "hb")
_add("fsm_reversion", _SIGNAL, select="select pair, ts, signal from h join sig using (pair, rn)")
_add(
    "fsm_confluence", _H, _HB, _CH, _RSI, "hr as (select hb.*, rsi.v as rsi_14 from hb left join rsi using (pair, rn))",
    _machine("sig", "hr", f"case when {_SIDE} = 1 then rsi_14 <= 45 else rsi_14 >= 55 end", _pays(50.0, 1.0), "rsi_14 is not null"),
    select="select pair, ts, signal from h join sig using (pair, rn)",
)
# per row: walk back over equal states
_EXC = _H + "," + _HB + f""",
ex as (select pair, ts, rn, bb_pct_b as p, case when bb_pct_b > 1 then 1 when bb_pct_b < 0 then -1 when bb_pct_b is not null then 0 end as s from hb),
br as (select t.pair, t.rn, max(case when o.s is distinct from t.s then o.rn else 0 end) as lastdiff, max(case when o.s is null then o.rn else 0 end) as lastnull from ex t join ex o on t.pair = o.pair and o.rn <= t.rn group by t.pair, t.rn),
cr as (select pair, rn, case when s <> 0 and lag(s) over ({_W}) = 0 then rn end as crossing from ex),
ev as (select ex.*, lastdiff, lastnull, (select max(abs(o.p - 0.5)) from ex o where o.pair = ex.pair and o.rn > br.lastdiff and o.rn <= ex.rn) as deep,
  (select max(c.crossing) from cr c where c.pair = ex.pair and c.rn > br.lastnull and c.rn <= ex.rn) as crossed from ex join br using (pair, rn)),
er as (select pair, ts, case when s is null then null when s = 1 then least(rn - lastdiff, 6) else 0 end as run_above, case when s is null then null when s = -1 then least(rn - lastdiff, 6) else 0 end as run_below,
  case when s is null then null else rn - crossed + 1 end as since_crossing, case when s is null then null when s = 0 then 0.0 else deep end as depth,
  {_full("avg(cast(s = 1 as int))", 's', 20)} as frac_above, {_full("avg(cast(s = -1 as int))", 's', 20)} as frac_below from ev)"""
_add("excursion", _EXC, select=f"select pair, ts, cast(run_above as int) as run_above, cast(run_below as int) as run_below, cast(since_crossing as int) as since_crossing, {_r(['depth', 'frac_above', 'frac_below'])} from er")
_add("run_distribution", _EXC, select="select pair, cast(run_above as int) as run_above, cast(run_below as int) as run_below, count(*) as n from er where run_above > 0 or run_below > 0 group by all")


def _barrier(k: float, tag: str) -> str:
    return f"""
t{tag} as (select a.pair, a.rn, min(o.rn - a.rn) filter (o.mid_high >= a.anchor + {k}::double * a.atr) as u, min(o.rn - a.rn) filter (o.mid_low <= a.anchor - {k}::double * a.atr) as d, count(o.rn) as seen
  from an a left join h o on o.pair = a.pair and o.rn between a.rn + 1 and a.rn + 12 group by a.pair, a.rn),
l{tag} as (select t.pair, t.rn, case when seen < 12 or atr is null then null when d is not null and (u is null or d <= u) then -1 when u is not null then 1 else 0 end as label, u, d, seen = 12 and coalesce(u = d, false) as both,
  anchor + {k}::double * atr as up, anchor - {k}::double * atr as down from t{tag} t join an using (pair, rn))"""


_AN = f"an as (select h.pair, h.ts, h.rn, h.mid_close, lead(h.mid_open) over (partition by h.pair order by h.ts) as anchor, lead(h.ts) over (partition by h.pair order by h.ts) as anchor_ts, lead(h.mid_close, 12) over (partition by h.pair order by h.ts) as far, atr.v as atr from h join atr using (pair, rn))"
_LAB = _H + "," + _CH + "," + _ATR + "," + _AN + "," + _barrier(0.5, "a") + "," + _barrier(1.0, "b")


def _label_columns(tag: str, name: str) -> str:
    return f"{tag}.label as label_{name}, cast(case {tag}.label when -1 then {tag}.d when 1 then {tag}.u when 0 then 12 end as int) as bars_{name}, {tag}.both as ambiguous_{name}, round(case {tag}.label when -1 then {tag}.down when 1 then {tag}.up end, 6) as touch_price_{name}"


_add("triple_barrier", _LAB, select=f"select an.pair, an.ts, {_label_columns('la', '0_5')}, {_label_columns('lb', '1_0')}, round(anchor, 6) as anchor, round((far - anchor) / anchor * 1e4, 6) as time_barrier_bps from an join la using (pair, rn) join lb using (pair, rn)")
_TODAY = f"(date_trunc('day', {_wall('X')}) + interval 17 hour)"


def _next_close(ts: str) -> str:
    today = _TODAY.replace("X", ts)
    return _utc(f"(case when {_wall(ts)} < {today} then {today} else {today} + interval 24 hour end)")


def _calendar(ts: str) -> str:
    minutes = f"cast(floor((epoch_us({_next_close(ts)}) - epoch_us({ts})) / 60000000.0::double) as bigint)"
    friday = f"isodow({_key(ts, 'daily')}) = 5"
    return f"{minutes} as minutes_to_close, {minutes} as bars_to_gap, {minutes} < 240 as spans_gap, {friday} as is_friday, case when {minutes} >= 240 then 'none' when {friday} then 'weekend' else 'daily_reset' end as gap_type"


_add("calendar_cols", _TICK, select=f"select pair, ts, {_calendar('ts')} from tick")
_add("minute_of_week", _TICK, select=f"select pair, ts, cast({_SLOT} as int) as slot, cast({_key('ts', 'daily')} as date) as day from tick")
_share = lambda k: f"round(avg(cast(lb.label = {k} as int)), 6)"
_add(
    "label_breakdown", _LAB,
    select=f"select an.pair, isodow({_key('anchor_ts', 'daily')}) = 5 as is_friday, count(*) as n, {_share(1)} as up, {_share(-1)} as down, {_share(0)} as \"none\", round(avg(case lb.label when -1 then lb.d when 1 then lb.u else 12 end), 6) as bars from an join lb using (pair, rn) where lb.label is not null group by all",
)
_add(
    "block_id", _H, "kk as (select *, case when n_minutes < 5 then n_minutes end as k from h)",
    f"ch as (select *, case when k is not null and k = lag(k) over ({_W}) then 0 else 1 end as new from kk)", f"bl as (select *, sum(new) over ({_W}) - 1 as block_id from ch)",
    select="select pair, ts, cast(block_id as bigint) as block_id, row_number() over (partition by pair, block_id order by ts) - 1 as event_offset from bl",
)
_add(
    "live_recompute", _H, _HB, _channel((60,)), _ema("e9", "h", "mid_close", 0.2), _ema("e21", "h", "mid_close", 2 / 22),
    f"lv as (select hb.pair, hb.ts, bb_lower, bb_upper, e9.v as e9, e21.v as e21, lead(hb.mid_open) over (partition by hb.pair order by hb.ts) as a, dc.donchian_low_60 as lo, dc.donchian_high_60 as hi from hb join dc using (pair, rn) join e9 using (pair, rn) join e21 using (pair, rn))",
    select=f"select pair, ts, {_r([], bb_position='(a - bb_lower) / nullif(bb_upper - bb_lower, 0)', dist_ema_9='(a - e9) / e9', dist_ema_21='(a - e21) / e21', donchian_pos_60='(a - lo) / nullif(hi - lo, 0)')} from lv",
)
_add(
    "chunks", "b as (select cast(min(cast(o_orderdate as date)) as timestamp) as a, cast(max(cast(o_orderdate as date)) as timestamp) as z from orders)",
    "e(i, t) as (select 0, a from b union all select i + 1, t + interval 3 month from e, b where t + interval 3 month <= z)",
    "k as (select e.i, e.t from e, b where e.i = 0 or z - t >= interval 45 day)",
    select="select i as chunk_id, t as chunk_start, coalesce(lead(t) over (order by i), (select z + interval 1 minute from b)) as chunk_end from k",
)
_day = lambda n: f"(select s + interval {n} day from bs)"
_DAYS_OF_EDGES = (0, 6, 12, 18, 24, 28)
_CHUNK = "case " + " ".join(f"when ts >= {_day(a)} and ts < {_day(b)} then {i}" for i, (a, b) in enumerate(zip(_DAYS_OF_EDGES, _DAYS_OF_EDGES[1:]))) + " else -1 end"
_SPLIT = _H + f""",
ck as (select pair, ts, rn, {_CHUNK} as chunk_id from h),
fl as (select *, chunk_id in (1, 3) as t, chunk_id >= 0 and lag(chunk_id) over ({_W}) >= 0 and (chunk_id in (1, 3)) <> (lag(chunk_id) over ({_W}) in (1, 3)) as edge, (chunk_id in (1, 3)) <> (lag(chunk_id) over ({_W}) in (1, 3)) as any_edge from ck),
nr as (select a.pair, a.rn, bool_or(o.t and o.rn > a.rn and o.rn <= a.rn + 12) as reach, bool_or(coalesce(o.edge, false) and o.rn <= a.rn and o.rn > a.rn - 24) as after,
  bool_or(coalesce(o.any_edge, false) and o.rn > a.rn - 10 and o.rn <= a.rn + 10) as near from fl a join fl o on a.pair = o.pair and o.rn between a.rn - 24 and a.rn + 12 group by a.pair, a.rn),
sp as (select fl.*, near, case when chunk_id < 0 then 'warmup' when not t and reach then 'purged' when after then 'embargoed' when t then 'test' else 'train' end as split from fl join nr using (pair, rn))"""
_add("split_assign", _SPLIT, select="select pair, ts, chunk_id, split from sp")
_add("period_labels", _SPLIT, select=f"select pair, ts, case when near then 'embargo' when t then 'test' when ts < {_day(0)} then 'pre' when ts < {_day(21)} then 'train' else 'val' end as period from sp")
_add(
    "purged_validation", _SPLIT,
    f"vl as (select *, ts >= {_day(21)} as late, split = 'train' and ts >= {_day(21)} as v, count(*) filter (ts >= {_day(21)}) over ({_W}) as since from sp)",
    "vr as (select a.pair, a.rn, coalesce(bool_or(o.v), false) as reach from vl a left join vl o on a.pair = o.pair and o.rn between a.rn + 1 and a.rn + 12 group by a.pair, a.rn)",
    select="select pair, ts, split = 'train' and not late and not reach as is_fit, v and since > 10 as is_val from vl join vr using (pair, rn)",
)
_add(
    "split_scores", _LAB,
    f"ls as (select h.pair, {_CHUNK.replace('ts >=', 'h.ts >=').replace('ts <', 'h.ts <')} as c, lb.label, h.spread_close from h join lb using (pair, rn) where lb.label is not null)",
    "pc as (select c, count(*) as n, count(*) filter (label = 1) as ups, sum(spread_close) as sp from ls where c >= 0 group by c)",
    "tt as (select sum(n) as n, sum(ups) as ups, sum(sp) as sp from pc)",
    "cd as (select a.c as x, b.c as y, a.n + b.n as n, a.ups + b.ups as ups, a.sp + b.sp as sp from pc a join pc b on a.c < b.c)",
    "scs as (select x || ',' || y as held, round(abs(cd.ups::double / cd.n - (tt.ups - cd.ups)::double / (tt.n - cd.n)), 9) as label_gap, round(abs(cd.sp / cd.n - (tt.sp - cd.sp) / (tt.n - cd.n)), 9) as spread_gap from cd, tt)",
    select="select held, label_gap, spread_gap, rank() over (order by label_gap) + (count(*) over (partition by label_gap) - 1) / 2.0::double + rank() over (order by spread_gap) + (count(*) over (partition by spread_gap) - 1) / 2.0::double as rank_sum from scs",
)
_add(
    "split_balance", _LAB,
    f"ls as (select h.ts, {_CHUNK.replace('ts >=', 'h.ts >=').replace('ts <', 'h.ts <')} as c, lb.label, h.spread_close as v from h join lb using (pair, rn))",
    "pr as (select a.c as x, b.c as y from (select distinct c from ls where c >= 0) a join (select distinct c from ls where c >= 0) b on a.c < b.c)",
    "dl as (select x, y, ls.*, c in (x, y) as t from ls join pr on c >= 0)",
    "qs as (select x, y, max(n) / sum(n) as s from (select x, y, quarter(ts) as q, count(*) as n from dl where t group by all) group by x, y)",
    "ys as (select x, y, max(n) / sum(n) as s from (select x, y, year(ts) as q, count(*) as n from dl where t group by all) group by x, y)",
    "lm as (select x, y, " + ", ".join(f"avg(cast(label = {k} as int)) filter ({c}) as {n}_{i}" for i, k in enumerate((-1, 0, 1)) for n, c in (("a", "t"), ("b", "not t"))) + ", median(v) filter (t) as mt, median(v) filter (not t) as mr from dl group by x, y)",
    select="select x || ',' || y as held, round(qs.s, 6) as quarter_max_share, round(ys.s, 6) as year_max_share, round(100 * greatest(abs(a_0 - b_0), abs(a_1 - b_1), abs(a_2 - b_2)), 6) + 0.0::double as label_max_div_pp, round(abs(mt - mr) / mr, 6) + 0.0::double as vol_rel_div, cast(y - x = 1 as double) as adjacent_pairs from lm join qs using (x, y) join ys using (x, y)",
)
_LEVELS = ",".join(p.strip().strip(",") for p in (
    _H, _HB, _channel((60,)), _ema("e9", "h", "mid_close", 0.2), _ema("e21", "h", "mid_close", 2 / 22), _session("2h", "s2"), _bands("b2", "s2"), _session("4h", "s4"), _bands("b4", "s4"),
    "lv as (select hb.pair, hb.ts, hb.n_minutes, bb_upper, bb_lower, e9.v as ema_9, e21.v as ema_21, dc.donchian_high_60, dc.donchian_low_60 from hb join dc using (pair, rn) join e9 using (pair, rn) join e21 using (pair, rn))",
    f"v1 as (select t.pair, t.ts, t.mid, c.* exclude (pair, close_ts) {_asof('tick', 'lv', 'n_minutes, bb_upper, bb_lower, ema_9, ema_21, donchian_high_60, donchian_low_60', '1h')})",
    f"v2 as (select t.*, c.bb_upper as bb_upper_2h, c.bb_lower as bb_lower_2h {_asof('v1', 'b2', 'bb_upper, bb_lower', '2h')})",
    f"v4 as (select t.*, c.bb_upper as bb_upper_4h, c.bb_lower as bb_lower_4h {_asof('v2', 'b4', 'bb_upper, bb_lower', '4h')})",
))
_LEVEL_NAMES = ["bb_upper", "bb_lower", "ema_9", "ema_21", "donchian_high_60", "donchian_low_60", "bb_upper_2h", "bb_lower_2h", "bb_upper_4h", "bb_lower_4h"]
_add("frozen_levels", _LEVELS, select=f"select pair, ts, {_r(_LEVEL_NAMES)} from v4")
_inside = lambda lo, hi: f"(mid - {lo}) / nullif({hi} - {lo}, 0)"
_LIVE = _LEVELS + f""",
p4 as (select *, {_inside('bb_lower', 'bb_upper')} as bb_pct_b, {_inside('bb_lower_2h', 'bb_upper_2h')} as bb_position_2h, {_inside('bb_lower_4h', 'bb_upper_4h')} as bb_position_4h,
  (mid - ema_9) / ema_9 as dist_ema_9, (mid - ema_21) / ema_21 as dist_ema_21, {_inside('donchian_low_60', 'donchian_high_60')} as donchian_pos_60,
  dense_rank() over (partition by pair order by date_trunc('hour', ts)) - 1 as block_id from v4),
s4x as (select *, abs(bb_pct_b - 0.5) as f1, abs(bb_position_2h - 0.5) as f2, abs(bb_position_4h - 0.5) as f4, bb_pct_b is not null and bb_position_2h is not null and bb_position_4h is not null as ok from p4)"""
_SIX = ["bb_pct_b", "bb_position_2h", "bb_position_4h", "dist_ema_9", "dist_ema_21", "donchian_pos_60"]
_add(
    "training_events", _LIVE,
    select=f"select pair, ts, block_id, n_minutes, case when ok then cast(f1 > 0.5 as int) + cast(f2 > 0.5 as int) + cast(f4 > 0.5 as int) end as tf_stretch_count, {_r(_SIX, bb_pos_spread_2h='bb_pct_b - bb_position_2h', bb_pos_spread_4h='bb_pct_b - bb_position_4h', tf_stretch_max='case when ok then greatest(f1, f2, f4) end', anchor='mid')} from s4x",
)
_add(
    "block_diagnostics", _LIVE,
    "lo as (" + " union all ".join(f"select '{c}' as feature, pair, block_id, ts, {c} as x from s4x" for c in _SIX) + ")",
    "pb as (select feature, pair, block_id, count(*) as n, count(x) as defined, min(ts) filter (x is not null) as f, stddev_samp(x) as sd from lo group by all)",
    select="select feature, cast(sum(n) as bigint) as n, cast(sum(defined) as bigint) as defined, min(f) as first_valid, count(sd) as varied_blocks, round(avg(sd), 6) as block_sd from pb group by feature",
)
_add(
    "freshness", _LEVELS,
    *[p for tf, b in (("2h", "b2"), ("4h", "b4")) for p in (
        f"cl_{b} as (select pair, ts, {_close('ts', tf)} as closed from {b})",
        f"ho_{b} as (select t.pair, t.ts, c.closed {_asof('h', f'cl_{b}', 'closed', tf)})",
        f"dr_{b} as (select t.pair, t.ts, c.closed as now {_asof('tick', f'cl_{b}', 'closed', tf)})",
        f"lt_{b} as (select '{tf}' as tf, t.ts, t.now, c.closed as late {_asof(f'dr_{b}', f'ho_{b}', 'closed', '1h')})",
    )],
    "al as (select tf, now is distinct from late as stale, case when now is distinct from late and now is not null then (epoch_us(ts) - epoch_us(now)) / 60000000.0::double end as age from (select * from lt_b2 union all select * from lt_b4))",
    select="select tf, count(*) as n, count(*) filter (stale) as stale, round(quantile_cont(age, 0.5), 6) as median_age, round(quantile_cont(age, 0.95), 6) as p95_age from al group by tf",
)
_add(
    "variance_share", _H, "sm as (select pair, spread_close as x, avg(spread_close) over (partition by pair, hour(ts)) as m from h)",
    select="select pair, round(var_pop(m) / nullif(var_pop(x), 0), 6) + 0.0::double as share from sm group by pair",
)
# trades are islands of the target; entry at the island's first open, exit at the open after it
_LEG = "least(0.002::double * {p} * 1000, greatest(2.0::double, 0.00002::double * {p} * 1000))"
_TRADES = _SIGNAL + f""",
tg as (select h.*, case when h.rn > 30 then coalesce(lag(signal) over (partition by h.pair order by h.ts), 0) else 0 end as target from h join sig using (pair, rn)),
il as (select *, rn - row_number() over (partition by pair, target order by ts) as island from tg),
ir as (select pair, target as direction, min(rn) as a, max(rn) + 1 as z from il where target <> 0 group by pair, target, island),
op as (select ir.*, e.ts as entry_ts, x.ts as exit_ts, case when direction = 1 then e.open_ask else e.open_bid end as entry_price, case when direction = 1 then x.open_bid else x.open_ask end as exit_price, e.mid_open as mid_in, x.mid_open as mid_out
  from ir join h e on e.pair = ir.pair and e.rn = a left join h x on x.pair = ir.pair and x.rn = z),
fe as (select *, {_LEG.format(p='entry_price')} as fee_in, {_LEG.format(p='exit_price')} as fee_out, direction * (entry_price - mid_in) * 1000 as cost_in, direction * (mid_out - exit_price) * 1000 as cost_out, direction * (exit_price - entry_price) * 1000 as pnl from op),
td as (select *, z - a as bars_held, cost_in + cost_out as spread_cost, fee_in + fee_out as commission, (pnl - fee_in - fee_out) / (1000 * entry_price) * 1e4 as net_bps, (pnl + cost_in + cost_out) / (1000 * entry_price) * 1e4 as gross_bps from fe where exit_ts is not null)"""
_add("sim_trades", _TRADES, select=f"select pair, direction, entry_ts, exit_ts, cast(bars_held as int) as bars_held, 'signal' as exit_reason, {_r(['entry_price', 'exit_price'], 9)}, {_r(['pnl', 'spread_cost', 'commission'])} from td")
_EQUITY = _TRADES + """,
eq as (select t.pair, t.ts, t.rn, t.target as position, t.mid_close,
  coalesce(sum(case when f.exit_ts is not null and f.z <= t.rn then f.pnl - f.fee_in - f.fee_out when f.a <= t.rn then f.direction * (t.mid_close - f.entry_price) * 1000 - f.fee_in end), 0) as equity,
  coalesce(sum(case when f.a <= t.rn then f.cost_in else 0 end + case when f.exit_ts is not null and f.z <= t.rn then f.cost_out else 0 end), 0) as cum_spread_cost,
  coalesce(sum(case when f.a <= t.rn then f.fee_in else 0 end + case when f.exit_ts is not null and f.z <= t.rn then f.fee_out else 0 end), 0) as cum_commission
  from tg t left join fe f on f.pair = t.pair and f.a <= t.rn group by t.pair, t.ts, t.rn, t.target, t.mid_close)"""
_add("sim_equity", _EQUITY, select=f"select pair, ts, position, {_r(['equity', 'cum_spread_cost', 'cum_commission'], 6)} from eq")
_add(
    "metrics", _EQUITY, "lv as (select * from eq where rn > 30)",
    "tot as (select pair, arg_max(equity, ts) - arg_min(equity, ts) as total, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (365.25 * 86400) as years, avg(mid_close) as avg_price, arg_max(cum_spread_cost, ts) as cs, arg_max(cum_commission, ts) as cc, min(ts) as first from lv group by pair)",
    f"dd as (select pair, min(fall) as md from (select pair, equity - max(equity) over ({_W} rows unbounded preceding) as fall from lv) group by pair)",
    "dy as (select pair, cast(ts as date) as day, arg_max(equity, ts) as last from lv group by all)",
    "dc as (select pair, last - lag(last) over (partition by pair order by day) as d from dy)",
    "ds as (select pair, avg(d) as m, stddev_samp(d) as s from dc group by pair)",
    "te as (select td.pair, count(*) as n, avg(cast(pnl > 0 as int)) as win, avg(pnl) as ap, median(pnl) as mp, avg(bars_held) as bh from td join tot using (pair) where exit_ts >= first group by td.pair)",
    select="select pair, coalesce(n, 0) as n_trades, "
    + _r(["avg_price"], 6, total_pnl="total", annualized_pnl="total / years", return_pct_of_notional="total / (1000 * avg_price)", annualized_return_pct="total / years / (1000 * avg_price)", sharpe="coalesce(case when s > 0 then m / s * sqrt(252) end, 0.0)", max_drawdown="md", max_drawdown_pct_of_notional="md / (1000 * avg_price)", win_rate="coalesce(win, 0)", avg_trade_pnl="coalesce(ap, 0)", median_trade_pnl="coalesce(mp, 0)", avg_bars_held="coalesce(bh, 0)", cum_spread_cost="cs", cum_commission="cc", spread_pct_abs="cs / nullif(abs(total), 0)", commission_pct_abs="cc / nullif(abs(total), 0)", costs_pct_abs="(cs + cc) / nullif(abs(total), 0)")
    + " from tot join dd using (pair) join ds using (pair) left join te using (pair)",
)
_DAILY = _TRADES + f""",
dl as (select distinct pair, cast({_key('ts', 'daily')} as date) as day from h),
tr as (select pair, cast({_key('exit_ts', 'daily')} as date) as day, sum(net_bps) / 1e4 as ret from td group by all),
dr as (select pair, day, coalesce(ret, 0) as ret from dl left join tr using (pair, day))"""
_add("daily_returns", _DAILY, select="select pair, day, round(ret, 6) as ret from dr")
_add("pooled_returns", _DAILY, select="select day, round(avg(ret), 6) as ret from dr group by day")
_add(
    "trade_summary", _DAILY, "cu as (select *, sum(ret) over (partition by pair order by day rows unbounded preceding) as s from dr)",
    "fa as (select *, s - greatest(max(s) over (partition by pair order by day rows unbounded preceding), 0) as fall from cu)",
    "sd1 as (select pair, case when stddev_samp(ret) > 0 then avg(ret) / stddev_samp(ret) * sqrt(252) end as sharpe, min(fall) as max_drawdown, sum(ret) as total from fa group by pair)",
    "st1 as (select pair, count(*) as trades, avg(net_bps) as net_bps, avg(net_bps) / (stddev_samp(net_bps) / sqrt(count(*))) as t, avg(cast(net_bps > 0 as int)) as hit, avg(gross_bps) as gross_bps, avg(gross_bps - net_bps) as cost_bps from td group by pair)",
    select=f"select pair, trades, {_r(['sharpe', 'max_drawdown', 'total', 'net_bps', 't', 'hit', 'gross_bps', 'cost_bps'])} from sd1 left join st1 using (pair)",
)
_add("exit_reasons", _TRADES, select="select pair, 'signal' as exit_reason, direction, count(*) as n, round(avg(net_bps), 6) as net_bps, round(avg(bars_held), 6) as bars from td group by pair, direction")
_add(
    "welch", _TRADES,
    "g as (select pair, avg(net_bps) filter (direction = 1) as a, avg(net_bps) filter (direction = -1) as b, var_samp(net_bps) filter (direction = 1) / count(*) filter (direction = 1) as va, var_samp(net_bps) filter (direction = -1) / count(*) filter (direction = -1) as vb from td group by pair)",
    select="select pair, round(a - b, 6) as diff, round((a - b) / sqrt(va + vb), 6) as z from g",
)
_SCORES = _H + f""",
nx as (select *, lead(mid_close) over ({_W}) as nxt, round(mid_close, 0) as score from h),
scd as (select *, nxt > mid_close as up, score / (score + 40) as p from nx where nxt is not null)"""
_add(
    "auc", _SCORES, "x as (select a.pair, sum(case when a.score > b.score then 1.0::double when a.score = b.score then 0.5::double else 0 end) as won, count(*) as n from scd a join scd b on a.pair = b.pair and a.up and not b.up group by a.pair)",
    select="select pair, round(won / n, 6) as auc from x",
)
_add(
    "calibration", _SCORES, "b as (select least(cast(floor(p * 10) as int), 9) as bucket, p, up from scd)", "e as (select unnest(range(10)) as bucket)",
    select="select cast(e.bucket as int) as bucket, count(p) as n, round(avg(p), 6) as mean_probability, round(avg(cast(up as int)), 6) as observed from e left join b on e.bucket = b.bucket group by e.bucket",
)
_add("confusion", _SCORES, select="select pair, cast(up as int) as truth, cast(p < 0.5 as int) as predicted, count(*) as n from scd group by all")
_add(
    "directional", _LAB, "q as (select an.pair, lb.label as y, case when 0.4::double >= an.mid_close / 100 then 1 else -1 end as g from an join lb using (pair, rn) where lb.label is not null and lb.label <> 0)",
    select="select pair, count(*) as n, round(avg(cast(y = g as int)), 6) as accuracy, round(greatest(avg(cast(y = 1 as int)), 1 - avg(cast(y = 1 as int))), 6) as base_rate from q group by pair",
)
_add(
    "class_weights", _LAB, "q as (select an.pair, lb.label as y, count(*) as n from an join lb using (pair, rn) where lb.label is not null group by all)",
    select="select pair, y as label_1_0, n, round(sum(n) over (partition by pair)::double / (n * count(*) over (partition by pair)), 6) as weight from q",
)
_CR = _H + "," + _bands("b", "h") + f""",
cv as (select *, ln(mid_close) - ln(lag(mid_close) over ({_W})) as log_ret_1, ln(mid_close) - ln(lag(mid_close, 5) over ({_W})) as log_ret_5 from b)"""
_add("corr_long", _CR, select=" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from cv" for a in ("bb_pct_b", "log_ret_1") for b in ("mid_close", "spread_close", "log_ret_5")))
_q = lambda c, p: f"quantile_cont({c}, {p})"
_add(
    "describe", _H, _bands("b", "h"),
    select=" union all ".join(
        f"select '{c}' as feature, count({c}) as n, min(case when {c} is not null then ts end) as first_valid, "
        + _r([], null_share=f"1 - count({c}) / count(*)::double", inf_share="0.0::double", guarded_share="0.0::double", mean=f"avg({c})", sd=f"stddev_samp({c})", min=f"min({c})", p1=_q(c, 0.01), p25=_q(c, 0.25), p50=_q(c, 0.5), p75=_q(c, 0.75), p99=_q(c, 0.99), max=f"max({c})")
        + " from b"
        for c in ("mid_close", "spread_close", "bb_pct_b")
    ),
)
_add(
    "conservation", _H, _session("daily", "sd"), _session("weekly", "sw"),
    select=" union all ".join(f"select pair, cast(sum(n_minutes) as bigint) as rows_in, count(*) as buckets, '{g}' as grid from {t} group by pair" for g, t in (("1h", "h"), ("daily", "sd"), ("weekly", "sw"))),
)
