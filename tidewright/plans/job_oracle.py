"""SQL for DuckDB of the queries of checks, breakdowns, put-together features and jobs."""

from __future__ import annotations

import re

from tidewright.plans import oracle
from tidewright.plans.oracle import (
    _ATR, _AN, _CANDLE, _CH, _EXC, _H, _HB, _LAB, _LR, _MASK, _MIDS, _PRIOR20, _REGIME, _RSI, _SIDE, _SIDES, _SIGNAL, _SLOT, _TICK, _TRADES, _W,
    _asof, _bands, _barrier, _bars, _calendar, _changes, _channel, _ema, _frame, _full, _gaps, _key, _machine, _open, _pays, _r, _rank, _rma, _rsi, _session, _wall, _with,
)

SQL: dict[str, str] = {}


def _add(name: str, *parts: str, select: str) -> None:
    SQL[name] = f"{_with(*parts)}\n{select}"


for _tf, _width in (("15min", "15 minutes"), ("30min", "30 minutes")):
    _add(f"bars_{_tf}", _TICK, _bars("q", f"time_bucket(interval '{_width}', ts)"), select=f"select pair, ts, n_minutes, {_r([*_SIDES, *_MIDS], 9)} from q")
_add("clock_alignment", _H, select="select pair, bool_and(time_bucket(interval '1 hour', ts) = ts) as aligned from h group by pair")
_add(
    "session_checks", _TICK, _session("daily"), "md as (select pair, median(n_minutes) as m from s group by pair)",
    select=f"select pair, bool_and(hour({_wall('ts')}) = 17 and minute({_wall('ts')}) = 0) as labels_at_open, count(distinct ts) = count(ts) as unique_labels, min(n_minutes) as min_minutes, max(n_minutes) as max_minutes, count(*) filter (n_minutes < 0.25 * m) as thin_bars, round(max(m), 6) as median_minutes from s join md using (pair) group by pair",
)
_add("negative_spreads", _H, select="select pair, count(*) as n, count(*) filter (close_ask - spread_close * 2 * cast(hour(ts) % 3 = 0 as int) < close_bid) as clipped from h group by pair")
_add("window_slice", _H, "ed as (select min(ts) + interval 3 day as a, max(ts) - interval 2 day as z from tick)", select="select pair, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from h, ed where ts between a and z group by pair")
_add(
    "active_gaps", _H, _gaps("h", 60).replace("gaps as (select pair, minutes,", "gaps as (select pair, a, b, minutes,"),
    "nt as (select *, row_number() over (partition by pair order by a) as nth from gaps where kind = 'active')",
    select='select pair, cast(nth as int) as nth, a as "start", b as "end", round(minutes, 6) as minutes from nt where nth <= 5',
)
_ADX = (
    _rma("ra", "ch", "tr", 14, 1), _rma("pu", "ch", "up", 14, 1), _rma("mi", "ch", "dn", 14, 1),
    "di as (select pair, rn, 100 * pu.v / ra.v as p, 100 * mi.v / ra.v as m from ra join pu using (pair, rn) join mi using (pair, rn))",
    "dx as (select pair, rn, coalesce(100 * abs(p - m) / nullif(p + m, 0), 0.0) as x from di)", _rma("ad", "dx", "x", 14, 14),
)
_TECHNICAL = (_H, _bands("b", "h"), _CH, _ATR, _RSI, *_ADX, "te as (select b.pair, b.ts, b.mid_close, b.bb_pct_b, rsi.v as rsi_14, ad.v as adx_14, atr.v as atr_14 from b left join rsi using (pair, rn) left join ad using (pair, rn) left join atr using (pair, rn))")
_add("finite_rows", *_TECHNICAL, select="select pair, bb_pct_b is not null and rsi_14 is not null and adx_14 is not null and atr_14 is not null as ok, count(*) as n from te group by all")
_add("first_defined", *_TECHNICAL, select=" union all ".join(f"select '{c}' as feature, min(ts) filter ({c} is not null) as first_defined from te" for c in ("mid_close", "bb_pct_b", "rsi_14", "adx_14")))
_add(
    "minutes_distribution", _H, "k as (select n_minutes, count(*) as n from h group by n_minutes)",
    select="select n_minutes, n, round(n::double / sum(n) over (), 6) as share, round((sum(n) over (order by n_minutes rows unbounded preceding))::double / sum(n) over (), 6) as cumulative_share from k",
)
_add(
    "macro_auc", _LAB, "q as (select h.pair, lb.label as y, round(h.mid_close, 0) as d, round(h.spread_close, 4) as f from h join lb using (pair, rn) where lb.label is not null)",
    "au as (" + " union all ".join(f"select a.pair, {k} as k, avg(case when a.s > b.s then 1.0::double when a.s = b.s then 0.5::double else 0 end) as v from (select *, {s} as s from q) a join (select *, {s} as s from q) b on a.pair = b.pair and a.y = {k} and b.y <> {k} group by a.pair" for k, s in ((-1, "d"), (0, "f"), (1, "-d"))) + ")",
    select="select pair, count(*) as classes, round(avg(v), 6) as macro_auc from au group by pair",
)
_add(
    "directional_statistics", _LAB, "q as (select an.pair, lb.label as y, case when 0.4::double >= an.mid_close / 100 then 1 else -1 end as g from an join lb using (pair, rn) where lb.label is not null and lb.label <> 0)",
    "p as (select pair, count(*) as n, avg(cast(y = g as int)) as p, greatest(avg(cast(y = 1 as int)), 1 - avg(cast(y = 1 as int))) as b, count(*) / 4.0::double as e from q group by pair)",
    select=f"select pair, n, {_r([], accuracy='p', base_rate='b', n_eff='e', se='sqrt(p * (1 - p) / e)', low='p - 1.96::double * sqrt(p * (1 - p) / e)', high='p + 1.96::double * sqrt(p * (1 - p) / e)', z_base='case when b < 1 then (p - b) / sqrt(b * (1 - b) / e) end')} from p",
)
_add("spread_by_quarter", _H, select=f"select year(ts) as year, quarter(ts) as quarter, {_r([], 9, spread_close_mean='avg(spread_close)', spread_close_max='max(spread_close)', spread_close_sd='stddev_samp(spread_close)')} from h group by year(ts), quarter(ts)")
_add("widest_spreads", _H, "w as (select *, row_number() over (partition by pair order by spread_close desc, ts) as place from h)", select="select pair, ts, round(spread_close, 9) as spread_close from w where place <= 10")
_add("spread_median", _H, "m as (select median(spread_close) as m from h)", select="select round(max(m), 9) as spread_max, count(*) filter (spread_close < m) as under, count(*) as n from h, m")
_add(
    "session_counts", _TICK, f"se as (select pair, {_key('ts', '4h')} as k, count(*) as n, count(distinct cast(ts as date)) as days from tick group by all)",
    "mo as (select pair, n, count(*) as c from se group by all)", "us as (select pair, arg_max(n, c * 1000000000 - n) as usual_rows from mo group by pair)",
    select="select se.pair, count(*) as sessions, cast(sum(days) as bigint) as days, max(usual_rows) as usual_rows from se join us using (pair) group by se.pair",
)
_WICKS = f"w as (select *, {_full('avg(upper_wick + lower_wick)', 'upper_wick', 20, _PRIOR20)} as usual from c)"
_add(
    "candle_atr", _H, _CANDLE, _WICKS, _CH, _ATR,
    select=f"select w.pair, w.ts, {_r([], upper_wick_atr='upper_wick / nullif(atr.v, 0)', lower_wick_atr='lower_wick / nullif(atr.v, 0)', upper_wick_rel='case when usual > 0 then upper_wick / usual end', lower_wick_rel='case when usual > 0 then lower_wick / usual end')} from w join atr using (pair, rn)",
)
_add(
    "feature_pipeline", _H, _bands("b", "h"), _CH, _ATR, _RSI, *_ADX, *[_ema(f"e{n}", "h", "mid_close", 2 / (n + 1)) for n in (9, 12, 26)],
    "md as (select pair, rn, e12.v - e26.v as m from e12 join e26 using (pair, rn))", _ema("sg", "md", "m", 0.2), _channel((60,)), _CANDLE, _LR,
    f"ls as (select pair, rn, ln(mid_close) - ln(lag(mid_close, 5) over ({_W})) as r5, {_full('stddev_samp(r)', 'r', 15)} as sd15, {_full('avg(spread_close)', 'spread_close', 60)} as m60, {_full('stddev_samp(spread_close)', 'spread_close', 60)} as s60 from lr)",
    f"ss as (select pair, rn, {_open(oracle._NY, 8, 17)} as session_ny from h)",
    select="select b.pair, b.ts, ss.session_ny, "
    + _r([], ema_9="e9.v", macd_hist="md.m - sg.v", rsi_14="rsi.v", adx_14="ad.v", log_ret_5="r5", ret_std_15="sd15", bb_pct_b="bb_pct_b", donchian_pos_60="(b.mid_close - donchian_low_60) / nullif(donchian_high_60 - donchian_low_60, 0)", upper_wick_atr="c.upper_wick / nullif(atr.v, 0)", spread_z_60="(b.spread_close - m60) / nullif(s60, 0)", hour_sin="sin(2 * pi() * hour(b.ts) / 24.0::double)")
    + " from b join e9 using (pair, rn) join md using (pair, rn) join sg using (pair, rn) left join rsi using (pair, rn) left join ad using (pair, rn) join ls using (pair, rn) join dc using (pair, rn) join c using (pair, rn) join atr using (pair, rn) join ss using (pair, rn)",
)
_BLOCK = "bb_position, bb_width, rsi_14"


def _block(name: str, tf: str, n: str) -> tuple[str, ...]:
    own = f"{name} as (select pair, ts, bb_pct_b as bb_position, (bb_upper - bb_lower) / nullif(a{n}.v, 0) as bb_width, r{n}.v as rsi_14 from b{n} join a{n} using (pair, rn) left join r{n} using (pair, rn))"
    return _session(tf, f"s{n}"), _bands(f"b{n}", f"s{n}"), _changes(f"c{n}", f"s{n}"), _ema(f"a{n}", f"c{n}", "tr", 1 / 14), _rsi(f"r{n}", f"c{n}", 14), own


_add(
    "higher_timeframes", _H, _bands("b", "h"), _CH, _RSI, *_block("k2", "2h", "2"), *_block("k4", "4h", "4"), _session("daily", "sd"), _bands("db", "sd", 5, 0.8), _machine("dm", "db"),
    "dz as (select sd.pair, sd.ts, signal from sd join dm using (pair, rn))",
    f"j2 as (select t.*, c.bb_position as p2 {_asof('b', 'k2', _BLOCK, '2h')})",
    f"j4 as (select t.*, c.bb_position as p4, c.bb_width as w4, c.rsi_14 as r4x {_asof('j2', 'k4', _BLOCK, '4h')})",
    f"jd as (select t.*, coalesce(c.signal, 0) as regime {_asof('j4', 'dz', 'signal', 'daily')})",
    f"fx as (select jd.*, p2 is not null and p4 is not null as ok, abs(p2 - 0.5) as f2, abs(p4 - 0.5) as f4, case when {_SIDE} = 1 then rsi.v <= 30 when {_SIDE} = -1 then rsi.v >= 70 else false end as conf from jd left join rsi using (pair, rn))",
    select="select pair, ts, case when ok then cast(f2 > 0.5 as int) + cast(f4 > 0.5 as int) end as tf_stretch_count, cast(regime as int) as regime_daily, coalesce(conf and regime <> 0, false) as gate_cell_d, "
    + f"coalesce(conf and {_pays(100000.0, 2.0)} and spread_close < 0.02, false) as gate_stack, "
    + _r([], bb_position_2h="p2", bb_position_4h="p4", bb_width_atr_4h="w4", rsi_14_4h="r4x", bb_pos_spread_2h="bb_pct_b - p2", bb_pos_spread_4h="bb_pct_b - p4", tf_stretch_max="case when ok then greatest(f2, f4) end")
    + " from fx",
)
_EXCURSED = _EXC[len(_H + "," + _HB) :]
_add(
    "excursions_4h", _H, _session("4h"), _bands("hb", "s", 20, 0.8), _EXCURSED, f"sl as (select *, {_SLOT} as slot from h)", "nk as (select *, row_number() over (partition by pair, slot order by ts) as k from sl)",
    _rank("nk", "t.slot = o.slot", 3), "nh as (select *, rn as k from h)", _rank("nh", "true", 24).replace("rk as", "rk24 as"),
    f"jx as (select t.pair, t.ts, c.* exclude (pair, close_ts) {_asof('h', 'er', 'run_above, run_below, since_crossing, depth, frac_above', '4h')})",
    select=f"select jx.pair, jx.ts, cast(run_above as int) as run_above_4h, cast(run_below as int) as run_below_4h, cast(since_crossing as int) as since_crossing_4h, {_r([], depth_4h='depth', frac_above_20_4h='frac_above', spread_pctile_slot='rk.v', spread_pctile='rk24.v')} from jx join rk using (pair, ts) join rk24 using (pair, ts)",
)
_add("decision_atr", _H, _CH, _ATR, select="select h.pair, h.ts, round(lag(atr.v) over (partition by h.pair order by h.ts), 6) as atr_decision from h join atr using (pair, rn)")
_add("decision_bars", _TRADES, select="select td.pair, entry_ts, h.ts as decision_ts, round(h.mid_close, 6) as mid_close, round(h.spread_close, 6) as spread_close from td left join h on h.pair = td.pair and h.rn = td.a - 1")
_LATE = ",".join(p.strip().strip(",") for p in (
    _H, _CH, _ATR, _AN.replace("an as", "an0 as", 1), "at1 as (select pair, ts, atr.v as atr14 from h join atr using (pair, rn))",
    f"an as (select t.* exclude (atr), c.atr14 as atr {_asof('an0', 'at1', 'atr14', '1h')})", _barrier(1.0, "b"),
))
_WHEN = _calendar("anchor_ts").replace(" 240", " 12")
_add(
    "label_table", _LATE,
    select=f"select an.pair, an.ts, lb.label as label_1_0, cast(case lb.label when -1 then lb.d when 1 then lb.u when 0 then 12 end as int) as bars_1_0, gap_type, is_friday, {_r([], atr='atr', anchor='anchor', touch_price_1_0='case lb.label when -1 then lb.down when 1 then lb.up end')} from (select *, {_WHEN} from an) an join lb using (pair, rn) where anchor_ts is not null",
)
_WAYS = f"lw as (select {_WHEN}, cast(year(anchor_ts) as varchar) as y, lb.label, lb.both as clash, case lb.label when -1 then lb.d when 1 then lb.u else 12 end as bars from an join lb using (pair, rn) where lb.label is not null)"
_shares = _r([], k="1.0::double", up="avg(cast(label = 1 as int))", down="avg(cast(label = -1 as int))", none="avg(cast(label = 0 as int))", ambiguous="avg(cast(clash as int))", bars="avg(bars)").replace("as none", 'as "none"')
_add("label_ways", _LATE, _WAYS, select=f"select 'gap' as \"by\", gap_type as \"group\", count(*) as n, {_shares} from lw group by gap_type union all select 'year', y, count(*), {_shares} from lw group by y")
_add("wrong_anchors", _H, f"nx as (select pair, ts, lead(mid_open) over ({_W}) as nxt from h)", select="select pair, count(*) as n from nx where hour(ts) = 3 and nxt is not null group by pair")


def _second(text: str) -> str:
    """The trades again, of the signal ``sig2``."""
    return re.sub(r"\b(sig|tg|il|ir|op|fe|td)\b", r"\g<1>2", text)


def _two_rules(low: int, high: int) -> str:
    trades = _TRADES[len(_SIGNAL) :]
    confirmed = f"case when {_SIDE} = 1 then rsi_14 <= {low} else rsi_14 >= {high} end"
    other = _machine("sig2", "hr", confirmed, "true", "rsi_14 is not null")
    return ",".join(p.strip().strip(",") for p in (_SIGNAL, _CH, _RSI, "hr as (select hb.*, rsi.v as rsi_14 from hb left join rsi using (pair, rn))", other, trades, _second(trades)))


_DUEL = _two_rules(45, 55) + f""",
ed as (select date_trunc('hour', make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2)) as edge from tick),
al as (select 'plain' as rule, pair, direction, entry_ts, exit_ts, net_bps, pnl from td union all select 'rsi', pair, direction, entry_ts, exit_ts, net_bps, pnl from td2),
rt as (select al.*, case when entry_ts < edge then 'train' else 'test' end as period, case when direction > 0 then 'long' else 'short' end as method from al, ed),
sc as (select method, rule, count(*) as trades, avg(net_bps) as net_bps, case when count(*) > 1 and stddev_samp(net_bps) > 0 then avg(net_bps) / (stddev_samp(net_bps) / sqrt(count(*))) end as t from rt where period = 'train' group by all),
ch2 as (select *, row_number() over (partition by method order by case when method = 'long' then net_bps else t end desc nulls last, rule) as place from sc where trades >= 3),
chosen as (select * from ch2 where place = 1),
tested as (select rt.* from rt join chosen using (method, rule) where period = 'test')"""
_add("rule_trades", _DUEL, select="select pair, rule, direction, entry_ts, exit_ts, period, round(net_bps, 6) as net_bps from rt")
_add("rule_selection", _DUEL, select="select method, rule, trades, round(net_bps, 6) as net_bps, round(t, 6) as t from chosen")
_T = "case when count({x}) > 1 and stddev_samp({x}) > 0 then avg({x}) / (stddev_samp({x}) / sqrt(count({x}))) end"
_add("head_to_head", _DUEL, select=f"select method, count(*) as trades, round(avg(net_bps), 6) as net_bps, round({_T.format(x='net_bps')}, 6) as t, round(avg(cast(net_bps > 0 as int)), 6) as hit from tested group by method")
_add("head_to_head_exits", _DUEL, select="select method, 'signal' as exit_reason, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from tested group by method")
_add("head_to_head_quarters", _DUEL, select="select method, year(exit_ts) as year, quarter(exit_ts) as quarter, count(*) as trades, round(avg(net_bps), 6) as net_bps from tested group by all")
_add(
    "head_to_head_paired", _DUEL, f"dl as (select distinct pair, cast({_key('ts', 'daily')} as date) as day from h)",
    f"dt as (select pair, method, cast({_key('exit_ts', 'daily')} as date) as day, sum(net_bps) / 1e4 as ret from tested group by all)",
    "dw as (select dl.pair, coalesce(x.ret, 0) - coalesce(y.ret, 0) as d from dl left join dt x on x.pair = dl.pair and x.day = dl.day and x.method = 'long' left join dt y on y.pair = dl.pair and y.day = dl.day and y.method = 'short')",
    select=f"select pair, round({_T.format(x='d')}, 6) as paired_t from dw group by pair",
)
_add("sim_grid", _two_rules(40, 60), "al as (select 'plain' as rule, pair, pnl from td union all select 'rsi', pair, pnl from td2)", select="select pair || '/' || rule as pair, rule, count(*) as trades, cast(sum(cast(round(pnl, 6) as decimal(24, 6))) as double) as pnl from al group by pair, rule")
_add(
    "held_score", _H, "sx as (select pair, rn, mid_close - mid_open as score, hour(ts) < 20 as valid from h)",
    """hs(pair, rn, dir, more) as (
  select pair, cast(0 as bigint), 0, 0 from (select distinct pair from sx)
  union all
  select x.pair, x.rn, case when s.more > 0 then s.dir when x.valid and abs(x.score) > 20 then cast(sign(x.score) as int) else 0 end,
    case when s.more > 0 then s.more - 1 when x.valid and abs(x.score) > 20 then 4 else 0 end
  from hs s join sx x on x.pair = s.pair and x.rn = s.rn + 1)""",
    select="select h.pair, h.ts, cast(dir as int) as signal from h join hs using (pair, rn)",
)
_add("regime_rule", _REGIME, _machine("sig", "rg", allowed="regime_daily <> 0"), select="select pair, ts, signal from h join sig using (pair, rn)")
_f24 = _frame(24)
_add(
    "moment_divergence", _H, _MASK,
    f"mo as (select pair, ts, rn, rn > 24 and count(r) over {_f24} >= 12 as ready, stddev_samp(r) over {_f24} as sd, skewness(r) over {_f24} as sk, kurtosis(r) over {_f24} as ku, "
    + ", ".join(f"quantile_cont(r, {k / 8}) over {_f24} as e{k}" for k in range(1, 8)) + " from mr)",
    "mv as (select pair, ts, case when ready and sd > 0 then sk end as a, case when ready and sd > 0 then ku end as b, case when ready and abs(e6 - e2) > 1e-12 then (e6 + e2 - 2 * e4) / (e6 - e2) end as c, case when ready and abs(e6 - e2) > 1e-12 then ((e7 - e5) + (e3 - e1)) / (e6 - e2) end as d from mo)",
    "mz as (select pair, ts, " + ", ".join(f"({x} - {_full(f'avg({x})', x, 60)}) / nullif({_full(f'stddev_samp({x})', x, 60)}, 0) as z{x}" for x in "abcd") + " from mv)",
    select="select pair, ts, round(za - zc, 6) as skew_divergence_24, round(zb - zd, 6) as kurt_divergence_24 from mz",
)
_add("band_rescale", _H, _bands("b", "h"), select=f"select pair, ts, {_r([], upper='bb_middle + 1.5::double * sd', lower='bb_middle - 1.5::double * sd')} from b")
_add("side_bars", _H, select="select pair, ts as timestamp, " + ", ".join(f"round({p}_ask, 9) as {p}" for p in ("open", "high", "low", "close")) + ", -1.0::double as volume from h")
_add(
    "trade_excursions", _TRADES,
    "wx as (select td.pair, td.entry_ts, td.exit_ts, td.direction, max(td.mid_in) as m, min(h.mid_low) as lo, max(h.mid_high) as hi from td join h on h.pair = td.pair and h.rn between td.a and td.z - 1 group by all)",
    select="select pair, entry_ts, exit_ts, round(greatest(0, case when direction = 1 then m - lo else hi - m end), 9) as mae_price from wx",
)
# one state for each bar: the open position with its levels, the target that is held back, and the trades that the bar closed
_LEG = "least(0.002::double * {p} * 1000, greatest(2.0::double, 0.00002::double * {p} * 1000))"
_LEVELLED = _SIGNAL + "," + ",".join(p.strip().strip(",") for p in (
    _CH, _ATR,
    "li as (select h.*, case when h.rn > 30 then coalesce(lag(signal) over (partition by h.pair order by h.ts), 0) else 0 end as w, lag(atr.v) over (partition by h.pair order by h.ts) as ad from h join sig using (pair, rn) join atr using (pair, rn))",
    """lr(pair, rn, s, a, e, tp, sl, hb, r1, p1, s1, a1, e1, r2, p2, s2, a2, e2) as (
  select pair, cast(0 as bigint), 0, cast(0 as bigint), 0.0::double, 0.0::double, 0.0::double, cast(null as int), cast(null as varchar), 0.0::double, 0, cast(0 as bigint), 0.0::double, cast(null as varchar), 0.0::double, 0, cast(0 as bigint), 0.0::double from (select distinct pair from li)
  union all
  select pair, rn, case when hit is null then sc else 0 end, ac, ec, tpc, slc, case when hit is not null or aged then w else hbb end,
    case when left_ then 'signal' when aged then 'time_exit' end, case when sx = 1 then open_bid else open_ask end, sx, ax, ex,
    hit, case when hit = 'intrabar_sl' then slc else tpc end - sc * (open_ask - open_bid) / 2, sc, ac, ec
  from (select *, case when sc <> 0 and lv and sc * (case when sc = 1 then mid_low else mid_high end - slc) <= 0 then 'intrabar_sl' when sc <> 0 and lv and sc * (case when sc = 1 then mid_high else mid_low end - tpc) >= 0 then 'intrabar_tp' end as hit
  from (select *, case when aged then 0 else sb end as sc, ab as ac, eb as ec, tpb as tpc, slb as slc, coalesce(tpb <> slb, false) as lv, case when left_ then s else sb end as sx, case when left_ then a else ab end as ax, case when left_ then e else eb end as ex
  from (select *, sb <> 0 and rn - ab >= 8 as aged
  from (select *, s <> 0 and g <> s as left_, case when g <> s then g else s end as sb, case when g <> s then rn else a end as ab, case when g <> s then entry else e end as eb,
    case when g <> s then entry + g * 0.8::double * ad else tp end as tpb, case when g <> s then entry - g * 0.8::double * ad else sl end as slb
  from (select *, case when hbb is not null then 0 else w end as g, case when (case when hbb is not null then 0 else w end) = 1 then open_ask else open_bid end as entry
  from (select i.*, l.s, l.a, l.e, l.tp, l.sl, case when l.hb is not null and l.hb = i.w then l.hb end as hbb from lr l join li i on i.pair = l.pair and i.rn = l.rn + 1)))))))""",
    "lc as (select pair, rn as z, r1 as reason, p1 as price, s1 as side, a1 as a, e1 as e, false as inside from lr where r1 is not null union all select pair, rn, r2, p2, s2, a2, e2, true from lr where r2 is not null)",
    "lt as (select lc.*, i.ts as entry_ts, o.ts as exit_ts, side * (e - i.mid_open) * 1000 + case when inside then (o.open_ask - o.open_bid) / 2 * 1000 else side * (o.mid_open - price) * 1000 end as spread_cost from lc join h i on i.pair = lc.pair and i.rn = lc.a join h o on o.pair = lc.pair and o.rn = lc.z)",
))
_add(
    "sim_levels", _LEVELLED,
    select=f"select pair, side as direction, entry_ts, exit_ts, cast(z - a as int) as bars_held, reason as exit_reason, {_r([], 9, entry_price='e', exit_price='price')}, {_r([], pnl='side * (price - e) * 1000', spread_cost='spread_cost', commission=_LEG.format(p='e') + ' + ' + _LEG.format(p='price'))} from lt",
)
_add(
    "spaced_sample", _H, f"ch as (select pair, ts, case when cast(ts as date) = lag(cast(ts as date)) over ({_W}) then 0 else 1 end as new from h)",
    f"bl as (select pair, ts, cast(sum(new) over ({_W}) - 1 as bigint) as block_id from ch)",
    "ev as (select *, row_number() over (partition by pair, block_id order by ts) - 1 as o, count(*) over (partition by pair, block_id) as n from bl)",
    "em as (select *, least(3, (n - 1) // 3 + 1) as m from ev)", "sp as (select *, n - (m - 1) * 2 as span from em)",
    "dn as (select *, row_number() over (partition by pair, block_id order by md5(concat_ws('|', 5, pair, block_id, o))) as k from sp where o < span)",
    "pk as (select pair, block_id, o + 2 * (row_number() over (partition by pair, block_id order by o) - 1) as place from dn where k <= m)",
    select="select ev.pair, ev.ts, ev.block_id, ev.o as event_offset from ev join pk on pk.pair = ev.pair and pk.block_id = ev.block_id and pk.place = ev.o",
)
