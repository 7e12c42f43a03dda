"""The same queries in DuckDB's SQL, written independently of the kernels: recursive averages and
the position state machine are recursive common table expressions."""

from __future__ import annotations


def r(x: str, digits: int = 6) -> str:
    """To the nearest decimal by the binary value: where the product falls on a tie, the halves of x tell
    which side of it x is on."""
    k = f"{10**digits}::double"
    half = "(v * 134217729::double - (v * 134217729::double - v))"
    lost = f"({half} * {k} - v * {k}) + (v - {half}) * {k}"
    return f"list_transform([cast({x} as double)], lambda v: (round_even(v * {k}, 0) + case when v * {k} - round_even(v * {k}, 0) = 0.5 and {lost} > 0 then 1.0::double when v * {k} - round_even(v * {k}, 0) = -0.5 and {lost} < 0 then -1.0::double else 0.0::double end) / {k})[1]"


def rs(names: str, digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} as {n}" for n in names.split())


EVENT_BARS = """bars as (select time_bucket(interval '15 minutes', ts) as date, event_type as symbol, arg_min(value, struct_pack(a := ts, b := event_id)) as open, max(value) as high,
min(value) as low, arg_max(value, struct_pack(a := ts, b := event_id)) as close, {V} as volume from events group by all)""".replace("{V}", r("sum(value)"))
ORDER_BARS = """bars as (select cast(o_orderdate as date) as date, o_orderpriority as symbol, arg_min(o_totalprice / 1000.0, struct_pack(a := o_orderdate, b := o_orderkey)) as open, max(o_totalprice / 1000.0) as high,
min(o_totalprice / 1000.0) as low, arg_max(o_totalprice / 1000.0, struct_pack(a := o_orderdate, b := o_orderkey)) as close, cast(count(*) as double) as volume from orders group by all)"""


def _mean(c: str, n: int) -> str:
    f = f"(partition by symbol order by date rows between {n - 1} preceding and current row)"
    return f"case when count({c}) over {f} = {n} then avg({c}) over {f} end"


_O = "over (partition by symbol order by date)"
WINDOWED = f"""wide as (select *, row_number() {_O} as rn, greatest(high - low, abs(high - lag(close) {_O}), abs(low - lag(close) {_O})) as true_range,
{_mean('close', 20)} as sma20, {_mean('close', 50)} as sma50, {_mean('volume', 20)} as avg_volume_20,
close / nullif(lag(close, 5) {_O}, 0) - 1 as momentum_5, close / nullif(lag(close, 20) {_O}, 0) - 1 as momentum_20,
case when count(close) over (partition by symbol order by date rows between 20 preceding and 1 preceding) = 20 then max(close) over (partition by symbol order by date rows between 20 preceding and 1 preceding) end as previous_high_20 from bars),
ratio as (select *, volume / nullif(avg_volume_20, 0) as volume_ratio, avg(true_range) over (partition by symbol order by date rows between 13 preceding and current row) as seed from wide)"""
RECURSIVE = """rec as (select symbol, rn, close as ema20, close as ema50, cast(null as double) as atr14 from ratio where rn = 1
union all select b.symbol, b.rn, e.ema20 * (1 - cast(2 as double) / 21) + b.close * (cast(2 as double) / 21), e.ema50 * (1 - cast(2 as double) / 51) + b.close * (cast(2 as double) / 51),
case when b.rn < 14 then null when b.rn = 14 then b.seed else e.atr14 * (1 - cast(1 as double) / 14) + b.true_range / 14 end from rec e join ratio b on b.symbol = e.symbol and b.rn = e.rn + 1),
feat as (select ratio.*, ema20, ema50, atr14 from ratio join rec using (symbol, rn)),
cond as (select *, coalesce(ema20 > ema50, false) as trend_condition, coalesce(close > ema20, false) as price_condition, coalesce(close > previous_high_20, false) as breakout_condition, coalesce(volume_ratio > 1.5, false) as volume_condition from feat),
sig as (select *, case when trend_condition and price_condition and breakout_condition and volume_condition then 'LONG' else 'NO_SIGNAL' end as signal from cond)"""

def _one(run_id: str, cap: float, risk: float, mult: float, slip: float, comm: float) -> str:
    return f"runs as (select '{run_id}' as run_id, {cap}::double as cap, {risk}::double as risk, {mult}::double as mult, {slip}::double as slip, {comm}::double as comm), ranged as (select sig.*, runs.* from sig, runs)"


FULL = _one("full", 100000.0, 0.01, 2.0, 0.0005, 0.0005)
OTHER = _one("other", 50000.0, 0.02, 3.0, 0.001, 0.002)
#: The grid of sensitivity runs.
GRID = """runs as (select 'risk_per_trade' as param_name, v::double as param_value, v = 0.01 as is_baseline, v::double as risk, 2.0::double as mult, 0.0005::double as comm from (values (0.005), (0.01), (0.015), (0.02)) t(v)
union all select 'atr_multiplier', v::double, v = 2.0, 0.01::double, v::double, 0.0005::double from (values (1.5), (2.0), (2.5), (3.0)) t(v)
union all select 'commission_rate', v::double, v = 0.0005, 0.01::double, 2.0::double, v::double from (values (0.0005), (0.001), (0.002)) t(v)),
ranged as (select sig.*, runs.param_name || '=' || param_value as run_id, param_name, param_value, is_baseline, 100000.0::double as cap, risk, mult, 0.0005::double as slip, comm from sig, runs)"""

MACHINE = """base as (select symbol, run_id, date, open, low, close, ema20, atr14, signal = 'LONG' as lng, cap, risk, mult, slip, comm, row_number() over k as rn, count(*) over (partition by symbol, run_id) as n,
lead(open) over k as nxt, lead(date) over k as nxt_date from ranged window k as (partition by symbol, run_id order by date)),
st as (select distinct symbol, run_id, cast(0 as bigint) as rn, cap as cash, false as held, cast(0 as double) as qty, cast(0 as double) as px, cast(0 as double) as ref, cast(0 as double) as stop, cast(0 as double) as atr, cast(0 as double) as budget,
 cast(null as varchar) as sdate, cast(null as varchar) as edate, false as leaving, cast(0 as bigint) as tid, cast(null as varchar) as x, cast(null as double) as x_ref, cast(null as double) as x_px, cast(null as double) as i_qty, cast(null as double) as i_px, cast(null as double) as i_ref,
 cast(null as double) as i_stop, cast(null as double) as i_atr, cast(null as double) as i_budget, cast(null as varchar) as i_sdate, cast(null as varchar) as i_edate, cast(null as varchar) as skip, cast(null as varchar) as date, cast(null as double) as worth, cast(null as double) as comm from base
union all
select symbol, run_id, rn, case when enter then cash1 - px1 * q1 - px1 * q1 * comm else cash1 end, enter or held1, case when enter then q1 when held1 then qty else 0 end, case when enter then px1 else px end, case when enter then nxt else ref end,
 case when enter then stop1 else stop end, case when enter then atr14 else atr end, case when enter then budget1 else budget end, case when enter then date else sdate end, case when enter then nxt_date else edate end, case when enter then false else leaving1 end, tid,
 x, x_ref, x_px, qty, px, ref, stop, atr, budget, sdate, edate, why, date, case when enter then q1 * close when held1 then qty * close else 0 end, comm
from (select *, coalesce(why is null and lng, false) as enter from (select *, case when not lng then null when held1 then 'SKIPPED_IN_POSITION' when rn = n then 'SKIPPED_NO_NEXT_DAY' when atr14 is null or atr14 <= 0 then 'SKIPPED_ZERO_ATR' when q1 <= 0 then 'SKIPPED_ZERO_QTY' end as why
from (select *, case when atr14 > 0 then least(floor(budget1 / (px1 - stop1)), floor(cash1 / px1)) end as q1 from (select *, nxt * (1 + slip) as px1, nxt * (1 + slip) - mult * atr14 as stop1, eq1 * risk as budget1
from (select *, case when held1 then cash + qty * close else cash1 end as eq1, case when held1 then leaving or coalesce(close < ema20, false) else false end as leaving1
from (select *, case when x is null then cash else cash + x_px * qty - x_px * qty * comm end as cash1, held and x is null as held1
from (select *, x_ref * (1 - slip) as x_px from (select *, case x when 'STOP_LOSS' then stop when 'END_OF_DATA' then close else case when x is not null then open end end as x_ref
from (select s.symbol, s.run_id, b.rn, b.n, s.cash, s.held, s.qty, s.px, s.ref, s.stop, s.atr, s.budget, s.sdate, s.edate, s.leaving, cast(b.date as varchar) as date, b.open, b.low, b.close, b.ema20, b.atr14, b.lng, b.risk, b.mult, b.slip, b.comm, b.nxt, cast(b.nxt_date as varchar) as nxt_date,
 case when s.held then case when b.open < s.stop then 'STOP_GAP' when b.low <= s.stop then 'STOP_LOSS' when s.leaving then 'TREND_EXIT' when b.rn = b.n then 'END_OF_DATA' end end as x,
 s.tid + case when s.held and (b.open < s.stop or b.low <= s.stop or s.leaving or b.rn = b.n) then 1 else 0 end as tid
 from st s join base b on b.symbol = s.symbol and b.run_id = s.run_id and b.rn = s.rn + 1)))))))))),
trade as (select *, (x_px - i_px) * i_qty as gross_pnl, i_px * i_qty * comm + x_px * i_qty * comm as transaction_cost, (x_px - i_px) * i_qty - (i_px * i_qty * comm + x_px * i_qty * comm) as net_pnl,
 greatest(0, date_diff('day', cast(cast(i_edate as timestamp) as date), cast(cast(date as timestamp) as date))) as holding_days from st where x is not null),
curve as (select symbol, run_id, rn, date, round(cash, 6) as cash, qty, round(worth, 6) as worth, round(cash + worth, 6) as equity from st where rn > 0),
down as (select *, max(equity) over (partition by symbol, run_id order by rn rows unbounded preceding) as peak from curve),
m1 as (select symbol, run_id, arg_max(equity, rn) as final_equity, 100.0 * count(*) filter (qty > 0) / count(*) as exposure_pct, 100.0 * min((equity - peak) / nullif(peak, 0)) as max_drawdown_pct from down group by all),
m2 as (select symbol, run_id, count(*) as num_trades, count(*) filter (net_pnl > 0) as num_wins, count(*) filter (net_pnl <= 0) as num_losses, avg(net_pnl) as avg_net_pnl, avg(net_pnl) filter (net_pnl > 0) as avg_win_pnl, avg(net_pnl) filter (net_pnl <= 0) as avg_loss_pnl,
 coalesce(sum(net_pnl) filter (net_pnl > 0), 0) / nullif(abs(sum(net_pnl) filter (net_pnl <= 0)), 0) as profit_factor, avg(holding_days) as avg_holding_days, max(net_pnl) as best_trade_net_pnl, min(net_pnl) as worst_trade_net_pnl from trade group by all),
m3 as (select symbol, run_id, count(*) as skipped from st where skip is not null group by all),
met as (select symbol, run_id, 100000.0::double as initial_capital, final_equity, final_equity - 100000 as total_net_pnl, (final_equity - 100000) / 100000 * 100 as total_return_pct, coalesce(num_trades, 0) + coalesce(skipped, 0) as num_signals_total, coalesce(num_trades, 0) as num_signals_executed,
 coalesce(skipped, 0) as num_signals_skipped, coalesce(num_trades, 0) as num_trades, coalesce(num_wins, 0) as num_wins, coalesce(num_losses, 0) as num_losses, num_wins / nullif(num_trades, 0)::double as win_rate, avg_net_pnl, avg_win_pnl, avg_loss_pnl, profit_factor, max_drawdown_pct, avg_holding_days, exposure_pct, best_trade_net_pnl, worst_trade_net_pnl
 from m1 left join m2 using (symbol, run_id) left join m3 using (symbol, run_id))"""
MET4 = "final_equity total_net_pnl total_return_pct win_rate avg_net_pnl avg_win_pnl avg_loss_pnl profit_factor max_drawdown_pct avg_holding_days exposure_pct best_trade_net_pnl worst_trade_net_pnl"

SPLITS = """ends as (select symbol, min(date) as first, max(date) as last from bars group by symbol),
cuts as (select symbol, 0 as window_index, cast(first + interval 36 months as date) as low, last from ends union all select symbol, window_index + 1, cast(low + interval 6 months as date), last from cuts where cast(low + interval 6 months as date) < last),
wins as (select symbol, window_index, low, least(cast(low + interval 6 months as date), last) as high from cuts where low < last),
spl as (select w.symbol, w.window_index, w.low, w.high, min(b.date) filter (b.date < w.low) as dev_start, max(b.date) filter (b.date < w.low) as dev_end, count(*) filter (b.date < w.low) as dev_rows, min(b.date) filter (b.date >= w.low) as test_start, max(b.date) filter (b.date >= w.low) as test_end, count(*) filter (b.date >= w.low) as test_rows,
 case when count(*) filter (b.date >= w.low) >= 50 then 'OK' else 'INSUFFICIENT_DATA' end as status from wins w join bars b on b.symbol = w.symbol and b.date <= w.high group by all)"""
#: The full run, the grid's and the windows'.
ALL_RUNS = GRID.replace("ranged as (", """ranged as (select sig.*, 'full' as run_id, null::varchar as param_name, null::double as param_value, null::boolean as is_baseline, 100000.0::double as cap, 0.01::double as risk, 2.0::double as mult, 0.0005::double as slip, 0.0005::double as comm from sig
union all select sig.*, 'window ' || window_index, null, null, null, 100000.0::double, 0.01::double, 2.0::double, 0.0005::double, 0.0005::double from sig join spl on spl.symbol = sig.symbol and sig.date between spl.low and spl.high where status = 'OK'
union all """)
WINDOW_RUNS = "ranged as (select sig.*, 'window ' || window_index as run_id, 100000.0::double as cap, 0.01::double as risk, 2.0::double as mult, 0.0005::double as slip, 0.0005::double as comm from sig join spl on spl.symbol = sig.symbol and sig.date between spl.low and spl.high where status = 'OK')"


def _hold(keys: str, source: str) -> str:
    """Buy-and-hold per key."""
    return f"""h1 as (select {keys}, min(date) as start_date, max(date) as end_date, arg_min(open, date) as fo, arg_max(close, date) as lc, count(*) as n from {source} group by all),
h2 as (select *, fo * (1 + 0.0005::double) as bought, lc * (1 - 0.0005::double) as sold from h1), h3 as (select *, case when n >= 2 and bought > 0 then floor(100000 / bought) else 0 end as quantity from h2),
h4 as (select *, quantity > 0 as held, bought * quantity * 0.0005::double + sold * quantity * 0.0005::double as costs, (sold - bought) * quantity - (bought * quantity * 0.0005::double + sold * quantity * 0.0005::double) as net from h3),
hold as (select {keys}, case when held then start_date end as start_date, case when held then end_date end as end_date, case when held then fo else 0 end as entry_reference_price, case when held then lc else 0 end as exit_reference_price, case when held then bought else 0 end as entry_price,
case when held then sold else 0 end as exit_price, cast(quantity as bigint) as quantity, 100000.0::double as initial_capital, 100000 + case when held then net else 0 end as final_equity, case when held then net else 0 end as total_net_pnl, case when held then net / 100000 * 100 else 0 end as total_return_pct,
case when held then costs else 0 end as transaction_cost, cast(case when held then n else 0 end as bigint) as num_trading_days from h4)"""


HOLD4 = "entry_reference_price exit_reference_price entry_price exit_price initial_capital final_equity total_net_pnl total_return_pct transaction_cost"
WALK = f"""hb as (select sig.symbol, window_index, date, open, close from sig join spl on spl.symbol = sig.symbol and sig.date between spl.low and spl.high where status = 'OK'), {_hold('symbol, window_index', 'hb')},
walk as (select spl.symbol, spl.window_index, dev_start, dev_end, dev_rows, test_start, test_end, test_rows, case when status <> 'OK' then status when coalesce(met.num_trades, 0) = 0 then 'ZERO_TRADES' else 'OK' end as status,
coalesce(met.num_trades, 0) as num_trades, {r('coalesce(met.total_return_pct, 0)', 4)} as total_return_pct, {r('win_rate', 4)} as win_rate, {r('profit_factor', 4)} as profit_factor, {r('coalesce(max_drawdown_pct, 0)', 4)} as max_drawdown_pct,
{r('coalesce(met.final_equity, 100000)', 4)} as final_equity, {r('coalesce(hold.total_return_pct, 0)', 4)} as bh_total_return_pct, {r('coalesce(hold.final_equity, 100000)', 4)} as bh_final_equity
from spl left join met on met.symbol = spl.symbol and met.run_id = 'window ' || spl.window_index left join hold on hold.symbol = spl.symbol and hold.window_index = spl.window_index)"""



def _gates(windows: str = "*", points: str = "*") -> str:
    """The gates over walk, the grid's points and the full run, with columns replaced before."""
    return f"""gf as (select symbol, num_trades as expected from met where run_id = 'full'),
gp as (select {points} from (select symbol, param_name, is_baseline, num_trades from met join (select distinct run_id, param_name, is_baseline from ranged where param_name is not null) using (run_id))),
gw as (select {windows} from walk),
gl as (select *, status <> 'INSUFFICIENT_DATA' as real, lag(test_start) over (partition by symbol, status <> 'INSUFFICIENT_DATA' order by window_index, test_start) as before from gw),
g1 as (select symbol, count(*) filter (real and dev_end >= test_start) as a, count(*) filter (real and test_start <= before) as b, count(*) filter (symbol is null or symbol not in (select symbol from gf)) as c,
 count(*) filter (real and (final_equity < 0 or coalesce(win_rate not between 0 and 1, false) or max_drawdown_pct > 0)) as d from gl group by symbol),
g2 as (select gf.symbol, case when count(*) filter (is_baseline) = 0 then 1 else count(*) filter (is_baseline and param_name = 'risk_per_trade' and num_trades <> expected) end as e from gf left join gp using (symbol) group by gf.symbol),
g3 as (select coalesce(g1.symbol, g2.symbol) as symbol, a, b, c, d, e from g1 full join g2 on g1.symbol = g2.symbol)
select symbol, gate, cast(coalesce(case gate when 'NO_OVERLAP' then a when 'CHRONOLOGICAL' then b when 'SYMBOL_ISOLATION' then c when 'VALID_METRICS' then d else e end, 0) as bigint) as violations
from g3, (values ('NO_OVERLAP'), ('CHRONOLOGICAL'), ('SYMBOL_ISOLATION'), ('VALID_METRICS'), ('SENSITIVITY_BASELINE')) g(gate)"""


BROKEN = """* replace (case when window_index % 6 = 1 then test_start else dev_end end as dev_end, case when window_index % 6 = 2 then date '1999-01-01' else test_start end as test_start,
case when window_index % 6 = 3 then null when window_index % 6 = 4 then 'OTHER' else symbol end as symbol, case when window_index % 6 = 5 then -1 else final_equity end as final_equity, case when window_index % 6 = 0 then 5 else max_drawdown_pct end as max_drawdown_pct)"""
BROKEN_POINTS = "* replace (is_baseline and symbol <> '1-URGENT' as is_baseline, num_trades + case when symbol = '2-HIGH' then 1 else 0 end as num_trades)"

_CENTS = "cast(cast(floor({0}) as bigint) // 100 as varchar) || '.' || lpad(cast(cast(floor({0}) as bigint) % 100 as varchar), 2, '0')"


def _cents(x: str) -> str:
    return _CENTS.format(f"({x})")


RAW = f"""ev as (select event_id as i, ts, event_type, value, abs(value) * 100 as v from events),
raw1 as (select event_type as symbol, i as _src_row, case when i % 97 = 0 then strftime(ts, '%Y-%m-%d') when i % 89 = 0 then '' else strftime(ts + to_days(cast(i % 4000 as integer)), '%m/%d/%Y') end as d,
case when i % 23 = 0 then '1,' || lpad({_cents('v % 100000')}, 6, '0') when i % 29 = 0 then 'bad' else {_cents('v')} end as p, {_cents('v')} as o, {_cents('v + i % 7')} as h, ' ' || {_cents('greatest(0.0, v - i % 5 + case when i % 61 = 0 then 40.0 else 0.0 end)')} as l,
case when i % 17 = 0 then '-' when i % 19 = 0 then 'N/A' when i % 31 = 0 then '1,234' else {_cents('v')} || ['K', 'M', 'B', ''][i % 4 + 1] end as vol,
case when i % 37 = 0 then '0.5' else case when i % 2 = 0 then '-' else '' end || {_cents('floor(floor(value) % 900)')} || '%' end as c from ev),
raw as (select * from raw1 union all select symbol, _src_row + 1000000000, d, p, o, h, l, vol, c from raw1 where _src_row % 50 = 0)"""
_NUM = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _price(c: str) -> str:
    t = f"replace(trim({c}), ',', '')"
    return f"case when regexp_matches({t}, '{_NUM}') then try_cast({t} as double) end"


_VOL = r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*([KMBkmb])?\s*$"
_PCT = r"^\s*([+-]?[0-9]+(?:\.[0-9]+)?)\s*%\s*$"
P_VOLUME = f"case when regexp_matches(vol, '{_VOL}') then try_cast(regexp_extract(vol, '{_VOL}', 1) as double) * case upper(regexp_extract(vol, '{_VOL}', 2)) when 'K' then 1e3 when 'M' then 1e6 when 'B' then 1e9 else 1 end end"
P_PCT = f"case when regexp_matches(c, '{_PCT}') then try_cast(regexp_extract(c, '{_PCT}', 1) as double) / 100 end"
P_DATE = "case when regexp_matches(trim(d), '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') then cast(try_strptime(trim(d), '%m/%d/%Y') as date) end"
CLEAN = f"""tr as (select symbol, _src_row, nullif(trim(d), '') as d, nullif(trim(p), '') as p, nullif(trim(o), '') as o, nullif(trim(h), '') as h, nullif(trim(l), '') as l, nullif(trim(vol), '') as vol, nullif(trim(c), '') as c from raw),
ex as (select *, row_number() over (partition by symbol, d, p, o, h, l, vol, c order by _src_row) as copy from tr),
pa as (select symbol, _src_row, d, p, vol, c, {P_DATE} as date, {_price('o')} as open, {_price('h')} as high, {_price('l')} as low, {_price('p')} as close, {P_VOLUME} as volume, {P_PCT} as change_pct_src from ex where copy = 1),
du as (select *, case when date is null then 1 else row_number() over (partition by symbol, date order by _src_row) end as nth, case when date is null then 1 else count(*) over (partition by symbol, date) end as of_date from pa),
cl as (select * from du where nth = 1),
oh as (select *, list_filter([case when high < low then 'high<low' end, case when high < open then 'high<open' end, case when high < close then 'high<close' end, case when low > open then 'low>open' end, case when low > close then 'low>close' end], lambda x: x is not null) as rules from cl where open is not null and high is not null and low is not null and close is not null),
ch as (select *, abs(computed - change_pct_src) as difference from (select *, close / nullif(lag(close) over (partition by symbol order by date nulls last, _src_row), 0) - 1 as computed from cl) where abs(computed - change_pct_src) > 0.005)"""


REPORT = """select symbol, rows, invalid_dates, date_min, date_max, missing, missing_close, zero, negative, coalesce(n_ohlc, 0) as n_ohlc, coalesce(n_change, 0) as n_change, case when coalesce(n_ohlc, 0) > 0 or zero > 0 or negative > 0 then 'FAIL' when missing > 0 or coalesce(n_change, 0) > 0 then 'WARNING' else 'PASS' end as status
from (select symbol, count(*) as rows, count(*) filter (date is null) as invalid_dates, cast(min(date) as varchar) as date_min, cast(max(date) as varchar) as date_max, count(*) filter (volume is null) as missing, count(*) filter (close is null) as missing_close, count(*) filter (volume = 0) as zero, count(*) filter (volume < 0) as negative from cl group by symbol)
left join (select symbol, count(*) as n_ohlc from oh where len(rules) > 0 group by symbol) using (symbol) left join (select symbol, count(*) as n_change from ch group by symbol) using (symbol)"""


def _with(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


#: Bars as vendor files give them back: four digits, names of letters and digits.
VENDOR_BARS = ORDER_BARS.replace("bars as (", "bars0 as (") + f""",
bars as (select date, regexp_replace(upper(symbol), '[^A-Z0-9]', '', 'g') as symbol, {r('open', 4)} as open, {r('high', 4)} as high, {r('low', 4)} as low, {r('close', 4)} as close, {r('volume', 4)} as volume from bars0)"""


def _files(cl: str, feature_names: str, every: str) -> dict[str, str]:
    """The queries over files, which give back what was written."""
    d, prices = "cast(date as varchar) as date", rs("open high low close volume")
    bars = _with(ORDER_BARS) + f"select {d}, symbol, {prices} from bars"
    table = _with(ORDER_BARS, WINDOWED, RECURSIVE) + f"select {d}, symbol, {rs('open high low close volume ' + feature_names, 8)}, trend_condition, price_condition, breakout_condition, volume_condition, signal from sig"
    summary = "select symbol, count(*) filter (signal = 'LONG') as n_long, count(*) filter (signal <> 'LONG') as n_none, cast(min(date) filter (signal = 'LONG') as varchar) as first_long, cast(max(date) filter (signal = 'LONG') as varchar) as last_long from sig group by symbol"
    text = lambda c: f"nullif(ltrim({c}), '')"
    own = (VENDOR_BARS, WINDOWED, RECURSIVE)
    run = _with(*own, FULL, MACHINE)
    first = "case when a > 0 then 'NO_OVERLAP' when b > 0 then 'CHRONOLOGICAL' when c > 0 then 'SYMBOL_ISOLATION' when d > 0 then 'VALID_METRICS' when e > 0 then 'SENSITIVITY_BASELINE' else 'PASSED' end"
    gates = _gates(BROKEN, BROKEN_POINTS)
    return {
        "scan_files": _with(RAW) + f"select upper(symbol) as symbol, count(*) as n, count({text('d')}) as n_dates, count({text('vol')}) as n_volumes, arg_min({text('p')}, _src_row) as first_price, arg_max({text('p')}, _src_row) as last_price from raw1 group by symbol",
        "scan_rows": _with(RAW) + f"select upper(symbol) as symbol, {text('d')} as raw_date, {text('p')} as raw_price, {text('o')} as raw_open, {text('h')} as raw_high, {text('l')} as raw_low, {text('vol')} as raw_volume, {text('c')} as raw_change from raw1",
        "scan_reports": _with(RAW) + "select upper(symbol) as symbol, count(*) as n_rows, 'unexpected column Note' as warnings, 'missing column High; missing column Vol.' as errors, true as unchanged from raw1 group by symbol",
        "vendor_source": _with(RAW.replace("raw as (select * from raw1 union all", "raw as (select * replace (upper(symbol) as symbol) from raw1 where symbol in ('click', 'purchase')), unread as ("), CLEAN) + "select symbol, original_rows, exact_duplicates, duplicate_dates, duplicate_date_rows, final_rows, original_rows - final_rows as removed_rows from (select symbol, count(*) as original_rows, count(*) filter (copy > 1) as exact_duplicates from ex group by symbol) join (select symbol, count(*) filter (nth = 1 and of_date > 1) as duplicate_dates, count(*) filter (nth > 1) as duplicate_date_rows, count(*) filter (nth = 1) as final_rows from du group by symbol) using (symbol)",
        "bars_csv": bars,
        "bars_parquet": bars,
        "features_csv": table,
        "features_parquet": table,
        "signals_csv": _with(ORDER_BARS, WINDOWED, RECURSIVE) + summary,
        "artifact_tolerant": _with(EVENT_BARS) + f"select symbol, count(*) as n_bars, {r('max(high)')} as high from bars where symbol <> 'click' group by symbol",
        "artifact_strict": _with(EVENT_BARS) + f"select symbol, count(*) as n_bars, {r('max(high)')} as high from bars group by symbol",
        "quality_json": cl + f"select symbol, status, rows, (select count(*) from ex where ex.symbol = x.symbol) as original_rows, (select count(*) from ex where ex.symbol = x.symbol) - rows as removed_rows, n_ohlc, n_change, date_min, date_max, missing_close from ({REPORT}) x",
        "gate_status": every + gates[: gates.index("\nselect symbol, gate")] + f"\nselect symbol, {first} as status from g3 where symbol is not null",
        "plan_bars": _with(VENDOR_BARS) + f"select {d}, symbol, {prices} from bars",
        "plan_signals": _with(*own) + summary,
        "plan_summary": run + f"select symbol, num_trades, {rs('final_equity total_return_pct win_rate', 4)}, num_trades as n_exits from met",
        "plan_trades": run + f"select symbol, tid as trade_id, x as exit_reason, {r('i_px', 4)} as entry_price, {r('net_pnl', 4)} as net_pnl, {r('net_pnl / (i_px * i_qty) * 100', 4)} as return_pct from trade",
        "plan_windows": _with(VENDOR_BARS, WINDOWED, RECURSIVE, SPLITS, WINDOW_RUNS, MACHINE, WALK) + "select symbol, cast(window_index as bigint) as window_index, cast(test_start as varchar) as test_start, cast(test_end as varchar) as test_end, test_rows, status, num_trades, final_equity, bh_final_equity from walk",
    }


def oracle_sql() -> dict[str, str]:
    e = (EVENT_BARS, WINDOWED, RECURSIVE)
    s, wide, bt = _with(*e), _with(EVENT_BARS, WINDOWED), _with(*e, FULL, MACHINE)
    raw, cl = _with(RAW), _with(RAW, CLEAN)
    wf = _with(ORDER_BARS, WINDOWED, RECURSIVE, SPLITS, WINDOW_RUNS, MACHINE, WALK)
    d = "cast(date as varchar) as date"
    window = lambda *c: wide + f"select symbol, {d}, {rs(' '.join(c))} from ratio"
    trade = f"""symbol, run_id, tid as trade_id, i_sdate as signal_date, i_edate as entry_date, {r('i_ref', 4)} as entry_reference_price, {r('i_px', 4)} as entry_price, {r('i_stop', 4)} as initial_stop, {r('i_atr', 4)} as atr_at_signal, cast(i_qty as bigint) as quantity, {r('i_budget', 4)} as risk_budget,
date as exit_date, {r('x_ref', 4)} as exit_reference_price, {r('x_px', 4)} as exit_price, x as exit_reason, {rs('gross_pnl transaction_cost net_pnl', 4)}, {r('net_pnl / (i_px * i_qty)', 4)} as return_pct, {r('net_pnl / i_budget', 4)} as r_multiple, cast(holding_days as bigint) as holding_days"""
    met = f"symbol, run_id, initial_capital, {rs(MET4, 4)}, num_signals_total, num_signals_executed, num_signals_skipped, num_trades, num_wins, num_losses"
    price_issue = lambda c, name, field: f"select symbol, _src_row as row_index, '{field}' as field, {c} as raw_value, 'unparseable' as reason, 'reported' as action from pa2 where {c} is not null and {name} is null"
    unread = " union all ".join(price_issue(*x) for x in (("d", "date", "Date"), ("p", "close", "Price"), ("o", "open", "Open"), ("h", "high", "High"), ("l", "low", "Low"), ("vol", "volume", "Vol."), ("c", "change_pct_src", "Change %")))
    issues = "select symbol, _src_row as row_index, 'row' as field, d as raw_value, 'exact duplicate' as reason, 'removed' as action from ex where copy > 1 union all select symbol, _src_row, 'row', cast(date as varchar), 'duplicate date', 'removed' from du where nth > 1"
    issues += " union all select symbol, null, 'Date', cast(date as varchar), 'date of ' || of_date || ' rows', 'removed' from du where nth = 1 and of_date > 1 union all select symbol, null, 'row', null, count(*) || ' exact duplicates', 'removed' from ex where copy > 1 group by symbol union all " + unread
    sampled = "select *, row_number() over (partition by symbol order by date) - 1 as k, count(*) over (partition by symbol) as n from bars"
    feature_names = "ema20 ema50 sma20 sma50 atr14 avg_volume_20 volume_ratio momentum_5 momentum_20"
    grid = _with(*e, GRID, MACHINE)
    every = _with(ORDER_BARS, WINDOWED, RECURSIVE, SPLITS, ALL_RUNS, MACHINE, WALK) + ", "
    # The metrics of MACHINE take a capital of 100,000 for granted.
    other = _with(*e, OTHER, MACHINE.replace("100000.0::double as initial_capital", "50000.0::double as initial_capital").replace("final_equity - 100000) / 100000", "final_equity - 50000) / 50000").replace("final_equity - 100000 as", "final_equity - 50000 as"))
    return _files(cl, feature_names, every) | {
        "breakouts": wide + f"select symbol, {d}, {rs('close sma20 previous_high_20 volume_ratio')} from ratio where close > previous_high_20 and volume_ratio > 1.5",
        "bars_events": _with(EVENT_BARS) + f"select {d}, symbol, {rs('open high low close volume')} from bars",
        "bars_orders": _with(ORDER_BARS) + f"select {d}, symbol, {rs('open high low close volume')} from bars",
        "parse_volume": raw + f"select _src_row, vol as raw, {r(P_VOLUME)} as volume from raw",
        "parse_pct": raw + f"select _src_row, c as raw, {r(P_PCT)} as change from raw",
        "parse_date": raw + f"select _src_row, d as raw, cast({P_DATE} as varchar) as date from raw",
        "parse_price": raw + f"select _src_row, p as raw, {r(_price('p'))} as price from raw",
        "dedup_exact": cl + "select symbol, _src_row from ex where copy = 1",
        "dedup_date": cl + f"select {d}, symbol, {rs('open high low close volume change_pct_src')}, _src_row from cl",
        "clean_counts": cl + "select symbol, original_rows, exact_duplicates, duplicate_dates, duplicate_date_rows, final_rows, original_rows - final_rows as removed_rows from (select symbol, count(*) as original_rows, count(*) filter (copy > 1) as exact_duplicates from ex group by symbol) join (select symbol, count(*) filter (nth = 1 and of_date > 1) as duplicate_dates, count(*) filter (nth > 1) as duplicate_date_rows, count(*) filter (nth = 1) as final_rows from du group by symbol) using (symbol)",
        "clean_issues": cl.rstrip() + ", pa2 as (select pa.*, ex.o, ex.h, ex.l from pa join ex using (_src_row))\n" + issues,
        "q_missing": cl + "select symbol, count(*) filter (date is null) as date, count(*) filter (open is null) as open, count(*) filter (high is null) as high, count(*) filter (low is null) as low, count(*) filter (close is null) as close, count(*) filter (volume is null) as volume from cl group by symbol",
        "q_ohlc": cl + "select symbol, _src_row, array_to_string(rules, ',') as rules from oh where len(rules) > 0",
        "q_volume": cl + "select symbol, count(*) filter (volume is null) as missing, count(*) filter (volume = 0) as zero, count(*) filter (volume < 0) as negative from cl group by symbol",
        "q_monotonic": raw + f"select symbol, count(*) filter (back) as n from (select symbol, date <= lag(date) over (partition by symbol order by _src_row) as back from (select symbol, _src_row, {P_DATE} as date from raw)) group by symbol",
        "q_change_pct": cl + f"select symbol, _src_row, {d}, {rs('computed difference')} from ch",
        "q_status": cl + f"select symbol, rows, invalid_dates, date_min, date_max, missing, zero, negative, n_ohlc, 0::bigint as n_backward, n_change, status from ({REPORT})",
        "q_change_spread": cl + f"select symbol, _src_row, {d}, {rs('computed difference')} from ch",
        "q_status_spread": cl + f"select symbol, rows, invalid_dates, date_min, date_max, missing, zero, negative, n_ohlc, 0::bigint as n_backward, n_change, status from ({REPORT})",
        "q_drift": _with(RAW, CLEAN.replace("nullif(trim(vol), '') as vol", "null::varchar as vol")) + f"select symbol, rows, rows as missing, '' as missing_columns, 'note' as unexpected_columns, 'no column Vol.: volume is null' as cleaning_warnings, '' as cleaning_errors, case when n_ohlc > 0 then 'FAIL' else 'WARNING' end as status from ({REPORT})",
        "q_lacking": cl + f"select symbol, rows, 'open; volume' as missing_columns, -1::bigint as missing_open, missing_close, -1::bigint as missing_volume, 0::bigint as n_ohlc, 'FAIL' as status from ({REPORT})",
        "q_report": cl.rstrip() + ", pa2 as (select pa.*, ex.o, ex.h, ex.l from pa join ex using (_src_row)), iss as (" + issues + """)
""" + f"""select symbol, (select count(*) from ex where ex.symbol = x.symbol) as original_row_count, rows as final_row_count, (select count(*) from ex where ex.symbol = x.symbol) - rows as removed_row_count, coalesce(date_min, '') as date_min, coalesce(date_max, '') as date_max,
missing_close, (select count(*) from ex where ex.symbol = x.symbol and copy > 1) as duplicate_exact_count, (select count(*) from du where du.symbol = x.symbol and nth = 1 and of_date > 1) as duplicate_date_count, n_ohlc as invalid_ohlc_count, missing as invalid_volume_count, zero as zero_volume_count, negative as negative_volume_count,
invalid_dates as invalid_date_count, 0::bigint as non_monotonic_date_count, n_change as change_pct_mismatch_count, (select count(*) from iss where iss.symbol = x.symbol) as cleaning_issue_count, status from ({REPORT}) x""",
        "sma": window("sma20", "sma50"),
        "true_range": window("true_range"),
        "avg_volume": window("avg_volume_20"),
        "volume_ratio": window("volume_ratio"),
        "momentum": window("momentum_5", "momentum_20"),
        "prev_high_20": window("previous_high_20"),
        "ema": s + f"select symbol, {d}, {rs('ema20 ema50')} from feat",
        "atr": s + f"select symbol, {d}, {rs('atr14')} from feat",
        "features": s + f"select symbol, {d}, {rs(feature_names)} from feat",
        "ema_spread": s + f"select symbol, {d}, {rs('ema20 ema50')} from feat",
        "atr_spread": s + f"select symbol, {d}, {rs('true_range atr14')} from feat",
        "windows_spread": window("sma20", "sma50", "avg_volume_20", "volume_ratio", "momentum_5", "momentum_20", "previous_high_20"),
        "drawdown_spread": bt + f"select symbol, date, {r('equity', 4)} as equity, {r('peak', 4)} as peak, {r('(equity - peak) / peak', 4)} as drawdown from down",
        "conditions": s + f"select symbol, {d}, trend_condition, price_condition, breakout_condition, volume_condition from cond",
        "signal": s + f"select symbol, {d}, {rs('close')}, signal from sig",
        "signal_summary": s + "select symbol, count(*) filter (signal = 'LONG') as n_long, count(*) filter (signal <> 'LONG') as n_none, cast(min(date) filter (signal = 'LONG') as varchar) as first_long, cast(max(date) filter (signal = 'LONG') as varchar) as last_long from sig group by symbol",
        "trades": bt + f"select {trade} from trade",
        "equity": bt + f"select symbol, run_id, date, {r('cash', 4)} as cash, cast(qty as bigint) as position_quantity, {r('worth', 4)} as position_market_value, {r('equity', 4)} as equity from curve",
        "trades_continued": bt + f"select {trade} from trade",
        "equity_continued": bt + f"select symbol, run_id, date, {r('cash', 4)} as cash, cast(qty as bigint) as position_quantity, {r('worth', 4)} as position_market_value, {r('equity', 4)} as equity from curve",
        "skips": bt + "select symbol, date as signal_date, skip as reason from st where skip is not null",
        "metrics": bt + f"select {met} from met",
        "metrics_spread": bt + f"select {met} from met",
        "drawdown": bt + f"select symbol, date, {r('equity', 4)} as equity, {r('peak', 4)} as peak, {r('(equity - peak) / peak', 4)} as drawdown from down",
        "exit_counts": bt + "select symbol, run_id, x as reason, count(*) as n from trade group by all",
        "skip_counts": bt + "select symbol, run_id, skip as reason, count(*) as n from st where skip is not null group by all",
        "buy_hold": _with(EVENT_BARS, _hold("symbol", "bars")) + f"select symbol, cast(start_date as varchar) as start_date, cast(end_date as varchar) as end_date, {rs(HOLD4, 4)}, quantity, num_trading_days from hold",
        "splits": _with(ORDER_BARS, SPLITS) + "select symbol, cast(window_index as bigint) as window_index, cast(dev_start as varchar) as dev_start, cast(dev_end as varchar) as dev_end, dev_rows, cast(test_start as varchar) as test_start, cast(test_end as varchar) as test_end, test_rows, status from spl",
        "walk_forward": wf + f"select symbol, cast(window_index as bigint) as window_index, cast(dev_start as varchar) as dev_start, cast(dev_end as varchar) as dev_end, dev_rows, cast(test_start as varchar) as test_start, cast(test_end as varchar) as test_end, test_rows, status, num_trades, total_return_pct, win_rate, profit_factor, max_drawdown_pct, final_equity, bh_total_return_pct, bh_final_equity, {r('total_return_pct - bh_total_return_pct', 4)} as excess_return_pct from walk",
        "wf_rollup": wf + f"select symbol, count(*) as total_windows, count(*) filter (status = 'OK') as ok_windows, count(*) filter (status = 'ZERO_TRADES') as zero_trade_windows, count(*) filter (status = 'INSUFFICIENT_DATA') as insufficient_data_windows, {r('''avg(total_return_pct) filter (status = 'OK')''', 4)} as avg_return_pct, {r('''avg(bh_total_return_pct) filter (status = 'OK')''', 4)} as avg_bh_return_pct, {r('''100.0 * count(*) filter (status = 'OK' and total_return_pct > 0) / nullif(count(*) filter (status = 'OK'), 0)''', 2)} as pct_profitable from walk group by symbol",
        "sensitivity": grid + f"select symbol, param_name, param_value, is_baseline, num_trades, {rs('total_return_pct win_rate profit_factor max_drawdown_pct final_equity', 4)} from met join (select distinct run_id, param_name, param_value, is_baseline from ranged) using (run_id)",
        "gates": every + _gates(),
        "gates_broken": every + _gates(BROKEN, BROKEN_POINTS),
        "metrics_other": other + f"select {met} from met",
        "config_echo": other + "select symbol, num_trades as n_exits, num_signals_skipped as n_skips, 'other' as run_id, 50000.0::double as initial_capital, 0.02::double as risk_per_trade, 3.0::double as atr_multiplier, 0.001::double as slippage_rate, 0.002::double as commission_rate from met",
        "grid": _with(EVENT_BARS) + "select symbol, p || '=' || v as run_id, p as param_name, v::double as param_value, b as is_baseline from (select distinct symbol from bars), (values ('risk_per_trade', '0.005', false), ('risk_per_trade', '0.01', true), ('risk_per_trade', '0.015', false), ('risk_per_trade', '0.02', false), ('atr_multiplier', '1.5', false), ('atr_multiplier', '2', true), ('atr_multiplier', '2.5', false), ('atr_multiplier', '3', false), ('commission_rate', '0.0005', true), ('commission_rate', '0.001', false), ('commission_rate', '0.002', false)) t(p, v, b)",
        "transaction_cost": bt + f"select symbol, tid as trade_id, {r('transaction_cost', 4)} as cost from trade",
        "holding": bt + "select symbol, tid as trade_id, cast(holding_days as bigint) as days from trade",
        "slice_dev": _with(ORDER_BARS) + f"select {d}, symbol, {rs('open high low close volume')} from bars where bars.date < date '1996-01-01'",
        "slice_test": _with(ORDER_BARS) + f"select {d}, symbol, {rs('open high low close volume')} from bars where bars.date between date '1996-01-01' and date '1996-06-30'",
        "catalog": _with(EVENT_BARS) + "select upper(symbol) as symbol, upper(symbol) || '.csv' as raw_file, 'bars of ' || upper(symbol) as description, count(*) as n_bars from bars group by symbol",
        "context_windows": wf + f"select symbol, total_windows, ok_windows, cast(window_index as bigint) as \"window\", concat_ws(' to ', cast(test_start as varchar), cast(test_end as varchar)) as test_range, status, total_return_pct as strategy_return_pct, bh_total_return_pct as bh_return_pct from walk join (select symbol, count(*) as total_windows, count(*) filter (status = 'OK') as ok_windows from walk group by symbol) using (symbol)",
        "context_sources": wf + "select symbol, 0::bigint as place, 'walk-forward summary' as source, 1::bigint as n from (select distinct symbol from walk) union all select symbol, 1, 'walk-forward windows', count(*) from walk group by symbol",
        "json_windows": wf + f"select symbol, total_windows, ok_windows, cast(window_index as bigint) as window_index, status, num_trades, total_return_pct, {r('total_return_pct - bh_total_return_pct', 4)} as excess_return_pct from walk join (select symbol, count(*) as total_windows, count(*) filter (status = 'OK') as ok_windows from walk group by symbol) using (symbol)",
        "json_splits": _with(ORDER_BARS, SPLITS) + "select symbol, count(*) over (partition by symbol) as total_windows, cast(window_index as bigint) as window_index, dev_rows, test_rows, status from spl",
        "json_sensitivity": grid + f"select symbol, param_name, param_value, is_baseline, num_trades, {rs('final_equity', 4)} from met join (select distinct run_id, param_name, param_value, is_baseline from ranged) using (run_id)",
        "report_lines": _with(ORDER_BARS, SPLITS) + "select symbol, count(*) + 12 as n from spl group by symbol",
        "sink_trades": bt + f"select symbol, tid as trade_id, {r('i_px', 4)} as entry_price, {r('i_stop', 4)} as initial_stop, {r('net_pnl', 4)} as net_pnl, {r('net_pnl / (i_px * i_qty) * 100', 4)} as return_pct from trade",
        "sink_equity": bt + f"select symbol, date, {r('cash', 4)} as cash, cast(qty as bigint) as position_quantity, {r('worth', 4)} as position_market_value, {r('equity', 4)} as equity from curve",
        "lookup": bt + f"select upper(symbol) as symbol, num_trades, {rs('final_equity', 4)} from met where symbol = 'click'",
        "ohlcv_range": _with(EVENT_BARS) + f"select {d}, {rs('open high low close volume')} from bars where symbol = 'click' and date >= timestamp '2024-01-05' and date <= timestamp '2024-01-20'",
        "features_range": s + f"select {d}, {rs('open high low close volume ' + feature_names)}, trend_condition, price_condition, breakout_condition, volume_condition, signal from sig where symbol = 'click' and date >= timestamp '2024-01-05' and date <= timestamp '2024-01-20'",
        "overview": bt + f"select symbol, date_min, date_max, rows, n_long, cast(21 as bigint) as n_columns, {rs('final_equity total_return_pct', 4)}, num_trades, {r('win_rate', 4)} as win_rate from (select symbol, cast(min(date) as varchar) as date_min, cast(max(date) as varchar) as date_max, count(*) as rows, count(*) filter (signal = 'LONG') as n_long from sig group by symbol) join met using (symbol)",
        "available_symbols": _with(EVENT_BARS) + "select symbol from (values ('click'), ('purchase'), ('nothing')) t(symbol) where symbol in (select symbol from bars) order by symbol",
        "trade_search": bt + "select symbol, tid as trade_id, date as exit_date, x as exit_reason from trade where x = 'STOP_LOSS' and (contains(i_sdate, '2024-01-1') or contains(i_edate, '2024-01-1') or contains(date, '2024-01-1') or contains(cast(tid as varchar), '2024-01-1'))",
        "trade_sort": bt + f"select symbol, tid as trade_id, {r('net_pnl', 4)} as net_pnl from trade order by trade.net_pnl desc, symbol, trade_id",
        "trade_page": bt + "select symbol, tid as trade_id, i_edate as entry_date from trade order by i_edate, symbol, tid offset 10 limit 10",
        "trade_next_page": bt + f"select symbol, tid as trade_id, {r('net_pnl', 4)} as net_pnl from trade order by trade.net_pnl desc, symbol, tid offset 20 limit 10",
        "distinct_exit": bt + "select distinct x as exit_reason from trade",
        "downsample": _with(EVENT_BARS) + f"select symbol, {d}, {rs('close')} from ({sampled}) where k % greatest(1, cast(ceil(n / 500) as bigint)) = 0 or k = n - 1",
        "downsample_spread": _with(EVENT_BARS) + f"select symbol, {d}, {rs('close')} from ({sampled}) where k % greatest(1, cast(ceil(n / 500) as bigint)) = 0 or k = n - 1",
        "downsample_volume": _with(EVENT_BARS) + f"select symbol, {d}, {rs('volume')} from ({sampled}) where k % greatest(1, cast(ceil(n / 400) as bigint)) = 0",
        "topk_signals": s + f"select symbol, cast(g.date as varchar) as date, {r('close')} as close from (select * from sig where signal = 'LONG' order by sig.date, symbol limit 100) g",
    }
