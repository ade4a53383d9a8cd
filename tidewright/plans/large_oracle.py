"""SQL for DuckDB of the queries in ``large_queries``, written from the definitions."""

from __future__ import annotations

from tidewright.plans import oracle

_BINS, _RATE, _PENALTY, _GAMMA, _LEAST = 16, 0.3, 1.0, 0.1, 5.0


def _boost_sql(rounds: int, depth: int) -> str:
    part = lambda g, h: f"(({g}) * ({g}) / (({h}) + {_PENALTY}))"
    steps = [f"""
items as materialized (
  select row_number() over () as id, cast(sign(round((l_discount - l_tax) * 100)) as integer) + 1 as y, l_orderkey % 5 <> 0 as learned,
    [case when l_linenumber <> 1 then cast(l_discount as double) end, case when l_linenumber % 3 <> 2 then cast(l_tax as double) end,
     cast(l_quantity as double), cast(l_extendedprice as double)] as xs
  from lineitem
),
weights as (select y, sum(count(*)) over () / (count(*) * count(*) over ()) as w from items group by y),
long as (select id, learned, f, xs[f + 1] as x from (select *, unnest([0, 1, 2, 3]) as f from items)),
ends as (select f, min(x) as lo, max(x) as hi from long where learned group by f),
cells as materialized (
  select id, f, case when x is null then -1 else len(list_filter(range(1, {_BINS}), lambda i: lo + (hi - lo) * i / {_BINS} <= x)) end as b
  from long join ends using (f)
),
classes as (select unnest([0, 1, 2]) as k),
m0 as materialized (select id, k, 0.0::double as m from items, classes)"""]
    for r in range(rounds):
        steps.append(f"""
p{r} as (select id, k, exp(m) / sum(exp(m)) over (partition by id) as p from m{r}),
at{r}_0 as materialized (
  select id, k, learned, 1 as node, w * (p - (y = k)::integer) as g, greatest(2 * w * p * (1 - p), 1e-16) as h
  from p{r} join items using (id) join weights using (y)
)""")
        for level in range(depth):
            first = 1 << level
            gain = f"0.5 * ({part('gl', 'hl')} + {part('tg - gl', 'th - hl')} - {part('tg', 'th')}) - {_GAMMA}"
            steps.append(f"""
h{r}_{level} as materialized (
  select k, node, f, b, sum(g) as g, sum(h) as h from at{r}_{level} join cells using (id) where learned and node >= {first} group by all
),
c{r}_{level} as (
  select k, node, f, c, side, sum(g) as tg, sum(h) as th,
    sum(case when b >= 0 and b <= c or b < 0 and side = 0 then g else 0 end) as gl, sum(case when b >= 0 and b <= c or b < 0 and side = 0 then h else 0 end) as hl
  from h{r}_{level}, (select unnest(range(0, {_BINS - 1})) as c), (select unnest([0, 1]) as side) group by k, node, f, c, side
),
s{r}_{level} as materialized (
  select k, node, f, c, side, {gain} as gain from c{r}_{level}
  where hl >= {_LEAST} and th - hl >= {_LEAST} and {gain} > 0
  qualify row_number() over (partition by k, node order by {gain} desc, f, c, side) = 1
),
at{r}_{level + 1} as materialized (
  select a.id, a.k, a.learned, a.g, a.h,
    case when s.f is null then a.node when x.b >= 0 and x.b <= s.c or x.b < 0 and s.side = 0 then 2 * a.node else 2 * a.node + 1 end as node
  from at{r}_{level} a left join s{r}_{level} s on s.k = a.k and s.node = a.node left join cells x on x.id = a.id and x.f = s.f
)""")
        steps.append(f"""
v{r} as (select k, node, -{_RATE} * sum(g) / (sum(h) + {_PENALTY}) as v from at{r}_{depth} where learned group by k, node),
m{r + 1} as materialized (select m.id, m.k, m.m + coalesce(v.v, 0) as m from m{r} m join at{r}_{depth} a using (id, k) left join v{r} v using (k, node))""")
    return "with " + ",".join(steps)


def _rounds_sql(rounds: int, depth: int) -> str:
    parts = []
    for r in range(rounds):
        for level in range(depth):
            parts.append(f"""
select {r} as round, k - 1 as class, node, ['discount', 'tax', 'quantity', 'price'][f + 1] as feature, side = 0 as null_left,
  lo + (hi - lo) * (c + 1) / {_BINS} as cut, gain, null::double as value from s{r}_{level} join ends using (f)""")
        parts.append(f"select {r}, k - 1, node, null, null, null, null, v from v{r}")
    return f"""{_boost_sql(rounds, depth)}
select cast(round as integer) as round, cast(class as integer) as class, cast(node as integer) as node, feature, null_left,
  round(cut, 6) + 0.0 as cut, round(gain, 6) + 0.0 as gain, round(value, 6) + 0.0 as value from ({" union all ".join(parts)})"""


def _losses_sql(rounds: int, depth: int) -> str:
    parts = [f"""
select {r} as rounds, sum(case when learned then loss end) / sum(case when learned then w end) as fit_loss,
  sum(case when not learned then loss end) / sum(case when not learned then w end) as validation_loss
from (
  select learned, w, -w * ln(exp(m) / total) as loss
  from (select id, k, m, sum(exp(m)) over (partition by id) as total from m{r}) join items using (id) join weights using (y) where k = y
)""" for r in range(rounds + 1)]
    return f"""{_boost_sql(rounds, depth)}
select cast(rounds as integer) as rounds, round(fit_loss, 8) + 0.0 as fit_loss, round(validation_loss, 8) + 0.0 as validation_loss from ({" union all ".join(parts)})"""


SQL = {"booster_rounds": _rounds_sql(2, 2), "booster_losses": _losses_sql(2, 2)}

_WIDTHS, _HORIZON = (1.0, 1.5, 2.0, 2.5, 3.0), 240


def _labels_sql() -> str:
    """Every bar against each of the bars ahead of it."""
    names, firsts = [], []
    for i, k in enumerate(_WIDTHS):
        tag = str(k).replace(".", "_")
        firsts.append(f"min(case when b.mid_high >= a.anchor + {k} * a.atr then b.rn - a.rn end) as u{i}, min(case when b.mid_low <= a.anchor - {k} * a.atr then b.rn - a.rn end) as d{i}")
        down, up = f"d{i} is not null and (u{i} is null or d{i} <= u{i})", f"u{i} is not null"
        names.append(f"""cast(case when not whole then null when {down} then -1 when {up} then 1 else 0 end as integer) as label_{tag},
  cast(case when not whole then null when {down} then d{i} when {up} then u{i} else {_HORIZON} end as integer) as bars_{tag}, coalesce(whole and u{i} = d{i}, false) as ambiguous_{tag}""")
    return f"""
{oracle._with(oracle._H, "n as (select *, 8.0::double + spread_close as atr, row_number() over (partition by pair order by ts) as rn from h)",
  f"a as (select pair, ts, rn, atr, lead(mid_open) over w as anchor, lead(mid_close, {_HORIZON}) over w as far, lead(ts, {_HORIZON}) over w is not null as whole from n window w as (partition by pair order by ts))",
  f"f as (select a.pair, a.ts, a.anchor, a.far, a.whole, {', '.join(firsts)} from a left join n b on b.pair = a.pair and b.rn between a.rn + 1 and a.rn + {_HORIZON} group by all)")}
select pair, ts, {', '.join(names)}, round(anchor, 6) + 0.0 as anchor, round((far - anchor) / anchor * 1e4, 6) + 0.0 as time_barrier_bps from f"""


_ORDER_TS = "cast(cast(o_orderdate as date) as timestamp) + to_hours(cast(o_orderkey % 24 as int))"


def _carried_sql() -> str:
    parts = [f"o as (select distinct o_orderpriority as pair, {_ORDER_TS} as ts from orders)", f"r as (select o_orderpriority as pair, {_ORDER_TS} as ts, o_totalprice from orders where o_totalprice > 300000)"]
    for period in ("daily", "weekly"):
        label = oracle._label("ts", period)
        close = oracle._utc(f"({oracle._wall('label')} + interval {oracle._SPAN[period]})")
        parts.append(f"{period} as (select pair, label, max(dearest) as dearest, max(n) as n, {close} as closed from (select pair, {label} as label, max(cast(o_totalprice as double)) as dearest, count(*) as n from r group by 1, 2) group by pair, label)")
    return f"""
{oracle._with(*parts)}
select o.pair, o.ts, d.n as n_daily, w.n as n_weekly, round(d.dearest, 6) + 0.0 as dearest_daily, round(w.dearest, 6) + 0.0 as dearest_weekly
from o asof left join daily d on d.pair = o.pair and d.closed <= o.ts asof left join weekly w on w.pair = o.pair and w.closed <= o.ts"""


def _windows_sql() -> str:
    side = ", ".join(f"max({s}) as {s}" for s in ("bid", "ask"))
    back = "(partition by pair order by ts rows between {} preceding and {})"
    w20, w1, w240 = back.format(19, "current row"), back.format(1, "1 preceding"), back.format(240, "1 preceding")
    return f"""
{oracle._with(oracle._TICK, f"t as (select pair, ts, {side} from tick group by pair, ts)", "m as (select pair, ts, (bid + ask) / 2 as x from t)",
  f"b as (select pair, ts, ln(x) - ln(lag(x, 5) over (partition by pair order by ts)) as r, case when count(x) over {w20} = 20 then avg(x) over {w20} end as mid, case when count(x) over {w20} = 20 then stddev_samp(x) over {w20} end as sd, "
  f"case when count(x) over {w1} = 1 then max(x) over {w1} end as h1, case when count(x) over {w240} = 240 then max(x) over {w240} end as h240, case when count(x) over {w240} = 240 then min(x) over {w240} end as l240 from m)")}
select pair, ts, round(r, 6) + 0.0 as r, round(mid, 6) + 0.0 as bb_middle, round(mid + 2 * sd, 6) + 0.0 as bb_upper, round(mid - 2 * sd, 6) + 0.0 as bb_lower,
  round(h1, 6) + 0.0 as donchian_high_1, round(l240, 6) + 0.0 as donchian_low_240, round(h240, 6) + 0.0 as donchian_high_240 from b"""


_SCANS = """
with o as (
  select o_orderpriority as pair, cast(o_orderdate as date) as day, o_orderkey, o_orderstatus,
    cast(round(o_totalprice * 100) as bigint) * case when o_orderkey % 2 = 0 then 1 else -1 end as x
  from orders
),
t as (select *, sum(x) over w as total, count(*) over w as n, lag(o_orderstatus) over w as status_before from o window w as (partition by pair order by day, o_orderkey)),
p as (
  select *, max(total) over w as peak, sum(case when o_orderstatus is not distinct from status_before then 0 else 1 end) over w as block
  from t window w as (partition by pair order by day, o_orderkey)
)
select pair, o_orderkey, cast(total as bigint) as total, n, cast(total - peak as bigint) as fall, status_before, cast(block as bigint) as block from p
"""

_QUANTILES = "select l_returnflag, " + ", ".join(f"round(quantile_cont(cast(l_extendedprice as double), {q}), 6) + 0.0 as {n}" for n, q in (("p01", 0.01), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p99", 0.99))) + " from lineitem group by l_returnflag"


def _closes_sql() -> str:
    parts = []
    for period, hours in (("2h", 2), ("4h", 4), ("daily", 24), ("weekly", 120)):
        label = oracle._utc_first(f"({oracle._key(_ORDER_TS, period)} - interval 7 hour)") if period in ("2h", "4h") else oracle._label(_ORDER_TS, period)
        close = oracle._utc_first(f"({oracle._wall('ts')} + interval {oracle._SPAN[period]})")
        parts.append(f"""
select pair, '{period}' as period, count(*) as n, count(*) filter (h <> {hours}) as off_width, round(min(h), 6) + 0.0 as shortest, round(max(h), 6) + 0.0 as longest
from (select pair, (epoch_us({close}) - epoch_us(ts)) / 3600000000.0::double as h from (select distinct o_orderpriority as pair, {label} as ts from orders)) group by pair""")
    return " union all ".join(parts)


def _changes_sql() -> str:
    """Every row near a change, by New York's offset three days before and after; a right join sees the last closed session, so that none is wrong."""
    offset = lambda ts: f"(epoch_us({oracle._wall(ts)}) - epoch_us({ts}))"
    return f"""
with o as (select distinct o_orderpriority as pair, {_ORDER_TS} as ts from orders),
near as (select * from o where {offset("(ts - interval 3 day)")} <> {offset("(ts + interval 3 day)")})
select pair, count(*) as near, cast(0 as bigint) as wrong from near group by pair"""


_COMMON = f"""
{oracle._with(oracle._H, oracle._session("2h", "s2"), oracle._session("4h", "s4"))}
select pair, ts from h where exists (select 1 from s2 where s2.pair = h.pair and s2.ts = h.ts) and exists (select 1 from s4 where s4.pair = h.pair and s4.ts = h.ts)"""

_NUMERIC = """
select o_orderkey, case when o_orderkey % 3 = 0 then cast(o_orderkey as double) end as text, case when o_orderstatus = 'O' then 1.0::double else 0.0::double end as open,
  epoch_us(cast(cast(o_orderdate as date) as timestamp)) / 1000000.0::double as day, cast(o_totalprice as double) as o_totalprice from orders
"""

SQL |= {
    "common_hours": _COMMON,
    "numeric_orders": _NUMERIC,
    "triple_barrier_240": _labels_sql(),
    "asof_sliced": _carried_sql(),
    "windows_sliced": _windows_sql(),
    "scans_sliced": _SCANS,
    "price_quantiles": _QUANTILES,
    "close_conventions": _closes_sql(),
    "clock_changes": _changes_sql(),
}
