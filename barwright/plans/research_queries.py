"""Queries over signals, back-tests, searches, regimes, levels and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.operators import blocked, daily, events, selection, signals, stats, windows as wn
from barwright.plans.joins_queries import ema_sql
from barwright.plans.registry import query, rounded
from barwright.sources import views
from barwright.sources.views import sql

_H = "(partition by instrument order by bar_end)"
_SIGNALS = """sig as (select b.instrument, b.bar_end, b.open, b.close, cast(sign(e.ema_fast - e.ema_slow) as integer) as signal from ema e join bars_1h b using (instrument, bar_end)),
    pos as (select *, coalesce(lag(signal) over (partition by instrument order by bar_end), 0) as position from sig)"""
_BACKTEST = f"""bt as (select *, abs(position - coalesce(lag(position) over {_H}, 0)) as trades, coalesce(lead(open) over {_H}, close) - open as step, lead(bar_end) over {_H} is null as last from pos),
    pnl as (select *, trades * 0.05::double as fee, case when last then abs(position) * 0.05::double else 0 end as terminal_fee, position * step - trades * 0.05::double - case when last then abs(position) * 0.05::double else 0 end as pnl_bar from bt)"""
_DAYS = """days as (select instrument, cast(bar_end - interval '1 microsecond' as date) as day, sum(pnl_bar) as pnl_day, cast(sum(trades) as bigint) as trades_day from pnl group by all),
    cum as (select *, sum(pnl_day) over (partition by instrument order by day rows unbounded preceding) as cum_pnl from days),
    dd as (select *, cum_pnl - max(cum_pnl) over (partition by instrument order by day rows unbounded preceding) as drawdown from cum)"""


def _backtest(spark, sf_dir):
    p = signals.ema_positions(views.event_bars(spark, sf_dir).select("instrument", "bar_end", "open", "close"), ["instrument"], "bar_end", 5, 12)
    return signals.open_to_open(p, ["instrument"], "bar_end", 0.05)


def _days(spark, sf_dir):
    b = _backtest(spark, sf_dir).withColumn("day", signals.session_day("bar_end"))
    return signals.by_day(b, ["instrument"], "day")


@query(sql("bars_1h", f", {ema_sql(5, 12)}, {_SIGNALS}, {_BACKTEST} select instrument, bar_end, signal, position, trades, round(fee, 6) as fee, round(terminal_fee, 6) as terminal_fee, round(pnl_bar, 6) as pnl_bar from pnl", recursive=True))
def point_backtest(spark, sf_dir):
    """F1, F2 trend positions and open-to-open profit."""
    b = _backtest(spark, sf_dir)
    return rounded(b.select("instrument", "bar_end", "signal", "position", "trades", "fee", "terminal_fee", "pnl_bar"))


@query(sql("bars_1h", f", {ema_sql(5, 12)}, {_SIGNALS}, {_BACKTEST}, {_DAYS} select instrument, day, round(pnl_day, 5) as pnl_day, trades_day, round(cum_pnl, 5) as cum_pnl, round(drawdown, 5) as drawdown from dd", recursive=True))
def ema_backtest_day(spark, sf_dir):
    """F1, F2, C16, T14 the flagship: trend positions to day results."""
    return rounded(_days(spark, sf_dir), 5)


@query(sql("bars_1h", f""", {ema_sql(5, 12)}, {_SIGNALS}, {_BACKTEST}, {_DAYS} select instrument, count(*) as days, round(avg(pnl_day), 6) as mean_pnl, round(sum(pnl_day), 5) as total_pnl,
    round(avg(case when pnl_day > 0 then 1.0 else 0 end), 6) as win_rate, round(avg(case when abs(pnl_day) <= 1e-9 then 1.0 else 0 end), 6) as near_zero_rate, cast(sum(trades_day) as bigint) as trades, round(min(drawdown), 5) as max_drawdown from dd group by all""", recursive=True))
def segment_summary(spark, sf_dir):
    """C17 summary of a segment."""
    out = signals.segment(_days(spark, sf_dir), ["instrument"])
    return rounded(out.withColumn("total_pnl", F.round("total_pnl", 5)).withColumn("max_drawdown", F.round("max_drawdown", 5)))


@query(sql("bars_1h", f""", {ema_sql(5, 12)}, {_SIGNALS}, b as (select *, cast(bar_end - interval '1 microsecond' as date) as day, coalesce(abs(position - lag(position) over {_H}), 0) as trades, coalesce(close - lag(close) over {_H}, 0) as step from pos),
    p as (select *, position * step - trades * 0.05::double as pnl from b), e as (select *, sum(pnl) over (partition by instrument, day order by bar_end rows unbounded preceding) as equity from p),
    d as (select *, equity - max(equity) over (partition by instrument, day order by bar_end rows unbounded preceding) as drawdown from e)
    select instrument, day, round(sum(pnl), 5) as pnl_day, cast(sum(trades) as bigint) as num_trades_day, round(min(drawdown), 5) as max_dd_day, cast(sum(pnl) > 0 as integer) as edge_day from d group by all""", recursive=True))
def close_to_close_day(spark, sf_dir):
    """F3 close-to-close day results with drawdown within the day."""
    p = signals.ema_positions(views.event_bars(spark, sf_dir).select("instrument", "bar_end", "close"), ["instrument"], "bar_end", 5, 12)
    out = signals.close_to_close(p.withColumn("day", signals.session_day("bar_end")), ["instrument"], "bar_end", "day", 0.05)
    return rounded(out, 5)


@query(sql("bars_1h", f""", {ema_sql(3, 19)}, g as (select instrument, bar_end, ema_fast - ema_slow as gap, lag(ema_fast - ema_slow) over {_H} as before from ema)
    select instrument, bar_end, case when gap > 0 then 1 else -1 end as desired_position, case when gap > 0 then 'EMA_CROSS_UP' else 'EMA_CROSS_DOWN' end as signal_code, round(abs(gap), 6) as signal_strength
    from g where (gap > 0 and before <= 0) or (gap < 0 and before >= 0)""", recursive=True))
def ema_cross_events(spark, sf_dir):
    """F4 discrete cross signals."""
    from barwright.operators.recurrence import with_ema

    e = with_ema(views.event_bars(spark, sf_dir).select("instrument", "bar_end", "close"), ["instrument"], ["bar_end"], "close", {"f": 3, "s": 19})
    c = e.withColumn("x", wn.crossed("f", "s", "instrument", "bar_end")).where("x is not null")
    up = F.col("x") == "up"
    return rounded(c.select("instrument", "bar_end", F.when(up, 1).otherwise(-1).alias("desired_position"), F.when(up, "EMA_CROSS_UP").otherwise("EMA_CROSS_DOWN").alias("signal_code"), F.abs(F.col("f") - F.col("s")).alias("signal_strength")))


@query(sql("day_bars", """, r as (select *, close / lag(close) over w - 1 as ret from day_bars window w as (partition by instrument order by trade_date)),
    v as (select *, case when count(ret) over w >= 20 then stddev_samp(ret) over w end as vol from r window w as (partition by instrument order by trade_date rows 19 preceding)),
    s as (select *, case when ret <= -1.5 * vol then 1 when ret >= 1.5 * vol then -1 else 0 end as signal from v)
    select instrument, trade_date, signal, coalesce(lag(signal) over (partition by instrument order by trade_date), 0) as position from s"""))
def mr_threshold(spark, sf_dir):
    """F6 mean-reversion signals."""
    return signals.threshold_positions(views.day_bars(spark, sf_dir), "instrument", "trade_date", 20, 1.5).select("instrument", "trade_date", "signal", "position")


@query(sql("day_bars", """, z as (select instrument, trade_date, close, avg(close) over w as m, stddev_samp(close) over w as s, count(close) over w as n from day_bars window w as (partition by instrument order by trade_date rows 19 preceding))
    select instrument, trade_date, case when n >= 20 and close <= m - 2 * s then 'LONG' when n >= 20 and close >= m + 2 * s then 'SHORT' else 'FLAT' end as signal from z"""))
def zscore_signals(spark, sf_dir):
    """F7 bands around a mean."""
    k, o = "instrument", "trade_date"
    m, s = (wn.rolling(f, "close", k, o, 20) for f in (F.avg, F.stddev_samp))
    c = F.col("close")
    return views.day_bars(spark, sf_dir).select(k, o, F.when(c <= m - 2 * s, "LONG").when(c >= m + 2 * s, "SHORT").otherwise("FLAT").alias("signal"))


@query(sql("day_bars", """, p as (select instrument, trade_date, lag(open) over w as o, lag(high) over w as h, lag(low) over w as l, lag(close) over w as c, open, close from day_bars window w as (partition by instrument order by trade_date))
    select instrument, trade_date, -cast(sign(c - o) as integer) as side, round(-sign(c - o) * (close - open), 6) as pnl from p where abs(c - o) / nullif(h - l, 0) >= 0.6 and (h - l) / o >= 0.5 and c <> o"""))
def large_day_fade(spark, sf_dir):
    """F8 against a large day's direction."""
    w = wn.over("instrument", "trade_date")
    p = views.day_bars(spark, sf_dir).withColumns({f"p_{c}": F.lag(c).over(w) for c in ("open", "high", "low", "close")})
    move, span = F.col("p_close") - F.col("p_open"), F.col("p_high") - F.col("p_low")
    large = (F.try_divide(F.abs(move), span) >= 0.6) & (span / F.col("p_open") >= 0.5) & (move != 0)
    return rounded(p.where(large).select("instrument", "trade_date", (-F.signum(move).cast("int")).alias("side"), (-F.signum(move) * (F.col("close") - F.col("open"))).alias("pnl")))


SIGNAL_SQL = """, tt as (select *, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr, close / lag(close) over w - 1 as ret from day_bars window w as (partition by instrument order by trade_date)),
    ta as (select *, case when count(tr) over w >= 5 then avg(tr) over w end as atr from tt window w as (partition by instrument order by trade_date rows 13 preceding)),
    tv as (select *, case when count(ret) over w >= 20 then stddev_samp(ret) over w end as vol from ta window w as (partition by instrument order by trade_date rows 19 preceding)),
    ms as (select *, case when ret <= -1.5 * vol then 1 when ret >= 1.5 * vol then -1 else 0 end as signal from tv)"""
_GRID_K = [(0.5, 1.0), (1.0, 2.0), (1.5, 3.0)]


@query(sql("day_bars", f"""{SIGNAL_SQL}, n as (select m.*, lag(signal) over w as ps, lag(atr) over w as pa, row_number() over w as rn, lead(trade_date) over w is null as final from ms m window w as (partition by instrument order by trade_date)),
    g as (select n.*, stop_k, take_k from n, (values {', '.join(map(str, _GRID_K))}) as k(stop_k, take_k)),
    st(instrument, stop_k, take_k, rn, trade_date, side, price, stop, take, entry, kind, pnl, was) as (select instrument, stop_k, take_k, rn, trade_date, 0, 0::double, 0::double, 0::double, trade_date, null::varchar, null::double, 0 from g where rn = 1
        union all select g.instrument, g.stop_k, g.take_k, g.rn, g.trade_date, case when y.hit is not null then 0 else x.side end, x.price, x.stop, x.take, x.entry, y.hit,
            case y.hit when 'stop' then (x.stop - x.price) * x.side when 'target' then (x.take - x.price) * x.side when 'end' then (g.close - x.price) * x.side end, x.side
        from st s join g on g.instrument = s.instrument and g.stop_k = s.stop_k and g.take_k = s.take_k and g.rn = s.rn + 1,
        lateral (select case when s.side <> 0 then s.side when g.ps <> 0 and g.pa is not null then g.ps else 0 end as side, case when s.side <> 0 then s.price else g.open end as price,
            case when s.side <> 0 then s.stop else g.open - g.ps * g.stop_k * g.pa end as stop, case when s.side <> 0 then s.take else g.open + g.ps * g.take_k * g.pa end as take, case when s.side <> 0 then s.entry else g.trade_date end as entry) x,
        lateral (select case when x.side = 0 then null when (case when x.side > 0 then g.low else g.high end - x.stop) * x.side <= 0 then 'stop' when (case when x.side > 0 then g.high else g.low end - x.take) * x.side >= 0 then 'target' when g.final then 'end' end as hit) y)
    select instrument, cast(stop_k as double) as stop_k, cast(take_k as double) as take_k, entry, trade_date as exit, cast(was as integer) as side, round(pnl, 6) as pnl, kind as reason from st where kind is not null""", recursive=True))
def bracket_backtest(spark, sf_dir):
    """F9 entries with ATR stops and targets over a grid of both."""
    d = wn.with_atr(views.day_bars(spark, sf_dir), "instrument", "trade_date")
    return rounded(signals.brackets(signals.threshold_positions(d, "instrument", "trade_date", 20, 1.5), ["instrument"], "trade_date", _GRID_K))


@query(sql("day_bars", """, n as (select instrument, trade_date, close / lag(close) over w - 1 as ret, row_number() over w as rn from day_bars window w as (partition by instrument order by trade_date)),
    h(instrument, trade_date, ret, rn, position) as (select instrument, trade_date, ret, rn, 0 from n where rn = 1 union all
        select n.instrument, n.trade_date, n.ret, n.rn, case when n.ret is null then h.position when h.position = 0 and abs(n.ret) >= 0.5 then sign(n.ret) when h.position <> 0 and abs(n.ret) < 0.1 then 0 else h.position end from h join n on n.instrument = h.instrument and n.rn = h.rn + 1)
    select instrument, trade_date, round(ret, 6) as ret, cast(position as integer) as position from h""", recursive=True))
def hysteresis_positions(spark, sf_dir):
    """F12 two thresholds."""
    w = wn.over("instrument", "trade_date")
    d = views.day_bars(spark, sf_dir).select("instrument", "trade_date", wn.pct_change("close", w).alias("ret"))
    return rounded(signals.hysteresis(d, "instrument", "trade_date", "ret", 0.5, 0.1))


#: Order keys and trades of one block: some ten to a hundred thousand rows of a trade log each.
ORDERS_BLOCK, TRADES_BLOCK = 1 << 21, 1 << 17


@query("""with l as (select l_orderkey % 100 as trade_date, row_number() over (partition by l_orderkey % 100 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq, l_extendedprice as price,
        case row_number() over (partition by l_orderkey % 100 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) % 4 when 1 then 'OPEN_LONG' when 2 then 'REVERSE' when 3 then 'REVERSE' else 'CLOSE' end as action from lineitem),
    s as (select *, case seq % 4 when 1 then 1 when 2 then -1 when 3 then 1 else 0 end as side from l)
    select trade_date, seq, action, side, case when action in ('CLOSE', 'REVERSE') then round(coalesce(lag(side) over w * (price - lag(price) over w), 0), 6) end as closed_pnl from s window w as (partition by trade_date order by seq)""")
def realized_pnl(spark, sf_dir):
    """F13 closed profit of a trade log."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = views.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 100).alias("trade_date"), *order)
    li = blocked.scan(li, ["trade_date"], order, {"seq": ("row", None)}, F.floor(F.col("l_orderkey") / ORDERS_BLOCK))
    log = li.select("trade_date", "seq", F.col("l_extendedprice").alias("price"))
    k = F.col("seq") % 4
    log = log.withColumn("action", F.when(k == 1, "OPEN_LONG").when(k.isin(2, 3), "REVERSE").otherwise("CLOSE"))
    out = signals.realized(log, ["trade_date"], "seq", F.floor(F.col("seq") / TRADES_BLOCK))
    return rounded(out.select("trade_date", "seq", "action", "side", "closed_pnl"))


_PAIRS = signals.grid(range(3, 6), range(8, 13))


def _grid_days(spark, sf_dir):
    d = views.day_bars(spark, sf_dir)
    return signals.grid_search(d, "instrument", "trade_date", _PAIRS, 1.0, F.col("trade_date"))


def grid_sql(source: str, parts: str) -> str:
    """Rows days: day results of every pair, for each group of the parts of source(parts, trade_date, open, close)."""
    spans = sorted({s for p in _PAIRS for s in p})
    alpha = {s: f"(2.0::double / {s + 1})" for s in spans}
    cols = ", ".join(f"e{s}" for s in spans)
    step = ", ".join(f"{alpha[s]} * n.close + (1 - {alpha[s]}) * e.e{s}" for s in spans)
    first = ", ".join("close" for _ in spans)
    options = " union all ".join(f"select {parts}, trade_date, open, close, {f} as fast, {s} as slow, cast(sign(e{f} - e{s}) as integer) as signal from ema" for f, s in _PAIRS)
    w = f"(partition by {parts}, fast, slow order by trade_date)"
    same = " and ".join(f"n.{c.strip()} = e.{c.strip()}" for c in parts.split(","))
    mine = ", ".join(f"n.{c.strip()}" for c in parts.split(","))
    return f""", n as (select {parts}, trade_date, open, close, row_number() over (partition by {parts} order by trade_date) as rn from {source}),
    ema({parts}, rn, trade_date, open, close, {cols}) as (select {parts}, rn, trade_date, open, close, {first} from n where rn = 1 union all select {mine}, n.rn, n.trade_date, n.open, n.close, {step} from ema e join n on {same} and n.rn = e.rn + 1),
    o as ({options}), p as (select *, coalesce(lag(signal) over {w}, 0) as position from o),
    b as (select *, abs(position - coalesce(lag(position) over {w}, 0)) as trades, coalesce(lead(open) over {w}, close) - open as step, lead(trade_date) over {w} is null as last from p),
    days as (select {parts}, fast, slow, trade_date as day, position * step - trades * 1.0 - case when last then abs(position) * 1.0 else 0 end as pnl_day, trades as trades_day from b)"""


def _grid_sql() -> str:
    return grid_sql("day_bars", "instrument")


_SEG = "count(*) as days, avg(pnl_day) as mean_pnl, avg(case when pnl_day > 0 then 1.0 else 0 end) as win_rate, sum(pnl_day) as total_pnl"


@query(sql("day_bars", f"""{_grid_sql()}, c as (select *, sum(pnl_day) over (partition by instrument, fast, slow order by day rows unbounded preceding) as eq from days),
    d as (select *, eq - max(eq) over (partition by instrument, fast, slow order by day rows unbounded preceding) as dd from c),
    s as (select instrument, fast, slow, {_SEG}, min(dd) as max_drawdown from d group by all)
    select instrument, fast, slow, days, round(mean_pnl, 4) as mean_pnl, round(win_rate, 6) as win_rate, cast(row_number() over (partition by instrument order by round(mean_pnl, 6) desc, round(win_rate, 6) desc, round(max_drawdown, 6) desc, fast, slow) as integer) as rank from s""", recursive=True))
def grid_search(spark, sf_dir):
    """F14, D13, E13 all pairs of spans, ranked."""
    s = signals.segment(_grid_days(spark, sf_dir), ["instrument", "fast", "slow"])
    out = signals.ranked(s, ["instrument"], ["fast", "slow"])
    return rounded(out.select("instrument", "fast", "slow", "days", F.round("mean_pnl", 4).alias("mean_pnl"), "win_rate", "rank"))


_SEGMENTS = f""", dm as (select instrument, cast(date_trunc('month', trade_date) as date) as month, min(trade_date) as a, max(trade_date) as b from day_bars group by all),
    fm as (select instrument, month, row_number() over (partition by instrument order by month) - 1 as i from (select *, min(a) over (partition by instrument) as first, max(b) over (partition by instrument) as last from dm) where first <= month and last >= month + interval 1 month),
    win as (select 'w' || lpad(cast(a.i // 12 + 1 as varchar), 3, '0') as window_id, a.instrument, a.i from fm a join fm b on a.instrument = b.instrument and b.i = a.i + 35 where a.i % 12 = 0),
    roles as (select window_id, 'train' as role, instrument, i as a, i + 23 as b from win union all select window_id, 'valid', instrument, i + 24, i + 35 from win),
    src as (select window_id, role, d.instrument, trade_date, open, close from day_bars d join fm on d.instrument = fm.instrument and date_trunc('month', trade_date) = month join roles r on r.instrument = d.instrument and i between a and b)
    {grid_sql("src", "window_id, role, instrument")},
    eq as (select *, sum(pnl_day) over (partition by window_id, role, instrument, fast, slow order by day rows unbounded preceding) as eq from days),
    dd as (select *, eq - max(eq) over (partition by window_id, role, instrument, fast, slow order by day rows unbounded preceding) as dd from eq),
    seg as (select window_id, role, instrument, fast, slow, {_SEG}, avg(case when abs(pnl_day) <= 25 then 1.0 else 0 end) as near_zero_rate, cast(sum(trades_day) as bigint) as trades, min(dd) as max_drawdown from dd group by all)"""


def _segments(spark, sf_dir):
    d = views.day_bars(spark, sf_dir)
    return signals.walk_forward_segments(d, "instrument", "trade_date", _PAIRS, 1.0, F.col("trade_date"), 24, 12, 12, near_zero=25.0)


@query(sql("day_bars", f"""{_SEGMENTS} select s.window_id, s.role, s.instrument, fast, slow, days, trades, round(mean_pnl, 4) as mean_pnl, round(total_pnl, 4) as total_pnl, round(win_rate, 4) as win_rate, round(near_zero_rate, 4) as near_zero_rate, round(max_drawdown, 4) as max_drawdown, f.month as month_from, t.month as month_to
    from seg s join roles r on s.window_id = r.window_id and s.role = r.role and s.instrument = r.instrument join fm f on f.instrument = r.instrument and f.i = r.a join fm t on t.instrument = r.instrument and t.i = r.b""", recursive=True))
def walk_forward_grid(spark, sf_dir):
    """F15 every pair on every window's training and validation months, each segment started anew."""
    return rounded(_segments(spark, sf_dir), 4)


@query(sql("day_bars", f"""{_SEGMENTS}, u as (select *, row_number() over (partition by window_id, instrument order by round(mean_pnl, 6) desc, round(win_rate, 6) desc, round(max_drawdown, 6) desc, fast, slow) as r from seg where role = 'train')
    select u.window_id, u.instrument, u.fast, u.slow, round(u.mean_pnl, 4) as train_mean, u.days as train_days, round(u.max_drawdown, 4) as train_max_drawdown, round(v.mean_pnl, 4) as valid_mean, round(v.total_pnl, 4) as valid_total, v.days as valid_days,
    round(v.win_rate, 4) as valid_win_rate, round(v.near_zero_rate, 4) as valid_near_zero_rate, v.trades as valid_trades, round(v.max_drawdown, 4) as valid_max_drawdown
    from u join seg v on v.window_id = u.window_id and v.instrument = u.instrument and v.fast = u.fast and v.slow = u.slow and v.role = 'valid' where r = 1""", recursive=True))
def walk_forward(spark, sf_dir):
    """F15 per window the best pair of the training months, and what it did on the months after."""
    best = signals.best_by_window(_segments(spark, sf_dir), "instrument")
    out = best.select(
        "window_id", "instrument", "fast", "slow", F.col("train_mean_pnl").alias("train_mean"), "train_days", "train_max_drawdown", F.col("valid_mean_pnl").alias("valid_mean"),
        F.col("valid_total_pnl").alias("valid_total"), "valid_days", "valid_win_rate", "valid_near_zero_rate", "valid_trades", "valid_max_drawdown",
    )
    return rounded(out, 4)


_GATE = """f as (select instrument, trade_date, close - open as pnl_day, lag(abs(close - open) / nullif(high - low, 0)) over w as trend_ratio, lag((high - low) / open) over w as rel_range from day_bars window w as (partition by instrument order by trade_date)),
    q as (select quantile_cont(trend_ratio, 0.1) as qt, quantile_cont(rel_range, 0.1) as qr from f where trade_date < date '1999-01-01'),
    g as (select f.*, cast(coalesce(trend_ratio <= qt, false) or coalesce(rel_range <= qr, false) as integer) as risk from f, q)"""


def _gated(spark, sf_dir):
    w = wn.over("instrument", "trade_date")
    span = F.col("high") - F.col("low")
    d = views.day_bars(spark, sf_dir).select(
        "instrument", "trade_date", (F.col("close") - F.col("open")).alias("pnl_day"),
        F.lag(F.try_divide(F.abs(F.col("close") - F.col("open")), span)).over(w).alias("trend_ratio"), F.lag(F.try_divide(span, F.col("open"))).over(w).alias("rel_range"),
    )
    train = d.where(F.col("trade_date") < "1999-01-01")
    low = selection.quantiles(stats.long_form(train, [], ["trend_ratio", "rel_range"]), "value", [0.1], ["metric"])
    cuts = low.agg(*(F.max(F.when(F.col("metric") == m, F.col("q")[0])).alias(c) for m, c in (("trend_ratio", "qt"), ("rel_range", "qr"))))
    low = F.coalesce(F.col("trend_ratio") <= F.col("qt"), F.lit(False)) | F.coalesce(F.col("rel_range") <= F.col("qr"), F.lit(False))
    return d.join(F.broadcast(cuts)).withColumn("risk", low.cast("int"))


@query(sql("day_bars", f", {_GATE} select instrument, trade_date, risk from g"))
def phase_gate(spark, sf_dir):
    """F18 gate by training quantiles."""
    return _gated(spark, sf_dir).select("instrument", "trade_date", "risk")


@query(sql("day_bars", f", {_GATE} select coalesce(cast(risk as varchar), 'all') as gate, count(*) as days, round(avg(pnl_day), 4) as mean_pnl, round(avg(case when pnl_day > 0 then 1.0 else 0 end), 6) as win_rate from g group by rollup (risk)"))
def gate_buckets(spark, sf_dir):
    """F17, F19 results by gate and over all."""
    out = _gated(spark, sf_dir).rollup("risk").agg(F.count(F.lit(1)).alias("days"), F.avg("pnl_day").alias("m"), F.avg((F.col("pnl_day") > 0).cast("double")).alias("win_rate"))
    return rounded(out.select(F.coalesce(F.col("risk").cast("string"), F.lit("all")).alias("gate"), "days", F.round("m", 4).alias("mean_pnl"), "win_rate"))


@query(sql("day_bars", """, s as (select *, high - low as s, avg(high - low) over (partition by instrument order by trade_date rows between 20 preceding and 1 preceding) as base from day_bars),
    x as (select instrument, trade_date, s / greatest(base, 1e-12) as range_ratio, (close - low) / greatest(s, 1e-12) as close_pos, abs(close - open) / greatest(s, 1e-12) as body_ratio, base from s)
    select instrument, trade_date, round(case when base is not null then range_ratio end, 6) as range_ratio, round(close_pos, 6) as close_pos, round(body_ratio, 6) as body_ratio, case when base is null then 'R4'
    when range_ratio <= 0.85 and close_pos between 0.4 and 0.6 then 'R1' when range_ratio >= 1.25 and (close_pos >= 0.7 or close_pos <= 0.3) and body_ratio >= 0.6 then 'R2'
    when range_ratio >= 1.25 and close_pos between 0.4 and 0.6 then 'R3' else 'R4' end as regime from x"""))
def regime_r1r4(spark, sf_dir):
    """G7 four day regimes."""
    out = events.regime_r(views.day_bars(spark, sf_dir), "instrument", "trade_date")
    # means of no range are floored, so ratios can have 16 digits before the point; rounded as SQL's round does it
    ratio = (F.rint(F.col("range_ratio") * 1e6) / 1e6).alias("range_ratio")
    return rounded(out.select("instrument", "trade_date", ratio, "close_pos", "body_ratio", "regime"))


_VOL = """v as (select instrument, trade_date, close - open as pnl_day, (high - low) / nullif(open, 0) as v, abs(close - open) / nullif(high - low, 0) as t from day_bars),
    z as (select *, case when count(v) over w >= 5 and stddev_pop(v) over w > 0 then (v - avg(v) over w) / stddev_pop(v) over w end as vz, case when count(t) over w >= 5 and stddev_pop(t) over w > 0 then (t - avg(t) over w) / stddev_pop(t) over w end as tz from v window w as (partition by instrument order by trade_date rows between 20 preceding and 1 preceding)),
    reg as (select instrument, trade_date, pnl_day, vz, tz, case when vz < -0.3 then 'LOW' when vz > 0.7 then 'HIGH' when vz is not null then 'MID' end as vol_regime, case when tz < 0 then 'FLAT' when tz is not null then 'TREND' end as trend_regime from z),
    k as (select *, case vol_regime when 'LOW' then 0 when 'MID' then 1 when 'HIGH' then 2 end as k from reg),
    tr as (select *, coalesce(trend_regime = 'TREND' and lag(trend_regime) over w = 'FLAT', false) as en, coalesce(trend_regime = 'FLAT' and lag(trend_regime) over w = 'TREND', false) as ex, coalesce(k > lag(k) over w, false) as up from k window w as (partition by instrument order by trade_date))"""


def _regimes(spark, sf_dir):
    r = events.vol_trend(views.day_bars(spark, sf_dir), "instrument", "trade_date")
    return events.regime_transitions(r, "instrument", "trade_date").withColumn("pnl_day", F.col("close") - F.col("open"))


@query(sql("day_bars", f", {_VOL} select instrument, trade_date, round(vz, 6) as vol_z, round(tz, 6) as trend_z, vol_regime, trend_regime from tr"))
def vol_trend_regime(spark, sf_dir):
    """G8 volatility and trend regimes."""
    return rounded(_regimes(spark, sf_dir).select("instrument", "trade_date", "vol_z", "trend_z", "vol_regime", "trend_regime"))


@query(sql("day_bars", f", {_VOL} select instrument, trade_date, cast(en as integer) as enter_trend, cast(ex as integer) as exit_trend, cast(up as integer) as vol_upshift, cast(en or ex or up as integer) as any_shift from tr"))
def regime_transitions(spark, sf_dir):
    """G9 changes of regime."""
    return _regimes(spark, sf_dir).select("instrument", "trade_date", "enter_trend", "exit_trend", "vol_upshift", "any_shift")


@query(sql("day_bars", f""", {_VOL}, b as (select case when en then 'enter' when ex then 'exit' when vol_regime = 'HIGH' then 'high_vol' else 'other' end as bucket, pnl_day from tr)
    select bucket, count(*) as days, round(sum(pnl_day), 4) as pnl, round(count(*) / sum(count(*)) over (), 6) as day_share, round(sum(pnl_day) / sum(sum(pnl_day)) over (), 5) as pnl_share,
    round(count(*) filter (pnl_day > 0) / sum(count(*) filter (pnl_day > 0)) over (), 6) as win_share from b group by bucket"""))
def pnl_decomposition(spark, sf_dir):
    """G10 profit by bucket of day."""
    rules = [("enter", F.col("enter_trend") == 1), ("exit", F.col("exit_trend") == 1), ("high_vol", F.col("vol_regime") == "HIGH")]
    out = events.pnl_buckets(_regimes(spark, sf_dir), rules)
    return rounded(out.select("bucket", "days", F.round("pnl", 4).alias("pnl"), "day_share", F.round("pnl_share", 5).alias("pnl_share"), "win_share"))


@query(sql("day_bars", f""", {_VOL}, l as (select case when trade_date < date '1999-01-01' then 'train' else 'test' end as period, cast(pnl_day > 0 as integer) as good, unnest(['enter_trend', 'exit_trend', 'vol_upshift', 'any_shift']) as event, unnest([en, ex, up, en or ex or up]) as hit from tr),
    d as (select period, count(*) as days, avg(good) as base from l where event = 'any_shift' group by period), p as (select event, period, count(*) as hits, avg(good) as p_good from l where hit group by all),
    t as (select event, period, hits, hits / days as freq, p_good, p_good / base as lift from p join d using (period))
    select event, period, hits, round(freq, 6) as freq, round(p_good, 6) as p_good, round(lift, 6) as lift, bool_and(freq >= 0.1 and lift > 1) over (partition by event) as passed from t"""))
def lift_table(spark, sf_dir):
    """G6, G12 lift of events on good days, by period."""
    r = _regimes(spark, sf_dir).withColumn("period", F.when(F.col("trade_date") < "1999-01-01", "train").otherwise("test")).withColumn("good", (F.col("pnl_day") > 0).cast("int"))
    return rounded(stats.lift_table(r, ["enter_trend", "exit_trend", "vol_upshift", "any_shift"], "good", "period"))


@query(sql("day_bars", """, w as (select instrument, unnest(['range', 'volume', 'n']) as metric, unnest([high - low, volume, n]) as value, close > open as good from day_bars where close <> open),
    p as (select instrument, metric, value, cast(sum(cast(good as bigint)) as bigint) as na, cast(sum(cast(not good as bigint)) as bigint) as nb from w group by all),
    r as (select *, coalesce(sum(na + nb) over (partition by instrument, metric order by value rows between unbounded preceding and 1 preceding), 0) as before from p),
    s as (select instrument, metric, cast(sum(na) as bigint) as n_a, cast(sum(nb) as bigint) as n_b, cast(sum(na * (before + (na + nb + 1) / 2)) as double) as rs from r group by all),
    m as (select instrument, metric, median(value) filter (good) as median_a, median(value) filter (not good) as median_b from w group by all)
    select instrument, metric, n_a, n_b, round(median_a, 6) as median_a, round(median_b, 6) as median_b, round(rs - n_a * (n_a + 1) / 2, 6) as u, round(2 * (rs - n_a * (n_a + 1) / 2) / (n_a * n_b) - 1, 6) as cliffs_delta from s join m using (instrument, metric)"""))
def cliffs_delta(spark, sf_dir):
    """G13, G15 rank comparison of good and bad days."""
    d = views.day_bars(spark, sf_dir).where("close <> open").withColumn("range", F.col("high") - F.col("low")).withColumn("g", F.when(F.col("close") > F.col("open"), "G").otherwise("B"))
    return rounded(stats.compare_groups(d, "g", "G", "B", ["range", "volume", "n"], ["instrument"]).drop("ties"))


@query()
def mann_whitney(spark, sf_dir):
    """G14 p-values of the comparison; a fixed case in the tests."""
    d = views.day_bars(spark, sf_dir).where("close <> open").withColumn("range", F.col("high") - F.col("low")).withColumn("g", F.when(F.col("close") > F.col("open"), "G").otherwise("B"))
    return stats.with_p_value(stats.compare_groups(d, "g", "G", "B", ["range", "volume", "n"], ["instrument"]))


@query(sql("day_bars", """, t as (select abs(close - open) / nullif(high - low, 0) as t, close - open as pnl from day_bars), u as (select * from t where t is not null),
    q as (select quantile_cont(t, [0.2, 0.4, 0.6, 0.8]) as e from u), b as (select pnl, 1 + cast(t > e[1] as integer) + cast(t > e[2] as integer) + cast(t > e[3] as integer) + cast(t > e[4] as integer) as bucket from u, q)
    select bucket, count(*) as n, round(avg(pnl), 4) as mean, round(median(pnl), 4) as median, round(sum(pnl), 3) as total from b group by bucket"""))
def trend_ratio_buckets(spark, sf_dir):
    """C25, G18 quintiles of a day metric."""
    d = views.day_bars(spark, sf_dir).select(F.try_divide(F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")).alias("t"), (F.col("close") - F.col("open")).alias("pnl"))
    out = stats.quintiles(d, "t", "pnl")
    return out.select("bucket", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("total", 3).alias("total"))


@query(sql("day_bars", """, g as (select instrument, trade_date, case when close > open then 'G' else 'B' end as a from day_bars), p as (select a as label_from, lead(a) over (partition by instrument order by trade_date) as label_to from g),
    c as (select label_from, label_to, count(*) as n from p where label_to is not null group by all) select *, round(n / sum(n) over (partition by label_from), 6) as p from c"""))
def run_transitions(spark, sf_dir):
    """E12 transition matrix of good and bad days."""
    d = views.day_bars(spark, sf_dir).select("instrument", "trade_date", F.when(F.col("close") > F.col("open"), "G").otherwise("B").alias("a"))
    return rounded(stats.transitions(d, "a", "instrument", "trade_date"))


@query(sql("day_bars", """, g as (select instrument, trade_date, close > open as good from day_bars), c as (select *, case when good = lag(good) over w then 0 else 1 end as c from g window w as (partition by instrument order by trade_date)),
    r as (select *, sum(c) over (partition by instrument order by trade_date rows unbounded preceding) as id from c), l as (select instrument, good, id, count(*) as len from r group by all)
    select instrument, good, count(*) as runs, round(avg(len), 6) as mean_len, round(median(len), 6) as median_len, round(quantile_cont(len, 0.9), 6) as p90_len, max(len) as max_len from l group by all"""))
def run_stats(spark, sf_dir):
    """E12 lengths of runs."""
    d = views.day_bars(spark, sf_dir).select("instrument", "trade_date", (F.col("close") > F.col("open")).alias("good"))
    runs = blocked.runs(d, "good", ["instrument"], ["trade_date"]).where("run_pos = 1")
    return rounded(runs.groupBy("instrument", "good").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("run_len").alias("mean_len"), F.median("run_len").alias("median_len"), F.percentile("run_len", F.lit(0.9)).alias("p90_len"), F.max("run_len").alias("max_len")
    ))


@query(sql("day_bars", "select instrument, count(*) as n, count(*) filter (close > open) as hits, round((count(*) filter (close > open) + 1) / (count(*) + 2), 6) as p from day_bars group by all"))
def beta_posterior(spark, sf_dir):
    """C20 posterior rates."""
    return rounded(stats.beta_posterior(views.day_bars(spark, sf_dir).withColumn("good", F.col("close") > F.col("open")), ["instrument"], "good", 1, 1))


@query(sql("day_bars", "select cast(year(trade_date) as integer) as part, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from day_bars where high - low > 2 * open group by part"))
def concentration(spark, sf_dir):
    """C23 share of events per year."""
    return rounded(stats.concentration(views.day_bars(spark, sf_dir).where("high - low > 2 * open"), F.year("trade_date")))


_LEVELS = """lv as (select instrument, unnest([1, 2, 3, 4]) as level_id, unnest(quantile_cont(close, [0.2, 0.4, 0.6, 0.8])) as level_price from day_bars group by instrument)"""


def _levels(days):
    q = days.groupBy("instrument").agg(F.percentile("close", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("q"))
    return q.select("instrument", F.posexplode("q").alias("i", "level_price")).select("instrument", (F.col("i") + 1).alias("level_id"), "level_price")


_CROSS = f"""{_LEVELS}, nx as (select instrument, trade_date, close, lead(close) over w as c1, lead(close, 2) over w as c2, lead(trade_date) over w as crossed_on from day_bars window w as (partition by instrument order by trade_date)),
    cr as (select nx.instrument, crossed_on, level_id, level_price, case when c1 >= level_price then 'up' else 'down' end as direction, case when c2 is null then null when (c1 >= level_price) = (c2 >= level_price) then 'confirmed' else 'false_break' end as outcome
    from nx join lv on nx.instrument = lv.instrument and level_price > least(close, c1) and level_price <= greatest(close, c1) where c1 is not null)"""


@query(sql("day_bars", f", {_CROSS} select instrument, crossed_on, level_id, round(level_price, 6) as level_price, direction, outcome from cr"))
def level_crossings(spark, sf_dir):
    """G2, D12 crossings of price levels."""
    d = views.day_bars(spark, sf_dir)
    return rounded(events.level_crossings(d, _levels(d), "instrument", "trade_date"))


def approach_sql(grid: str) -> str:
    """Rows st: events with their parameters n, k, x of a values list, and the approach state."""
    return f""", {_CROSS}, t as (select *, greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr, row_number() over w as i from day_bars window w as (partition by instrument order by trade_date)),
    a as (select *, case when count(tr) over w >= 5 then avg(tr) over w end as atr from t window w as (partition by instrument order by trade_date rows 13 preceding)),
    e as (select cr.*, a.i as e, 0.25::double * a.atr as z, grid.n, grid.k, grid.x from cr join a on a.instrument = cr.instrument and a.trade_date = cr.crossed_on, (values {grid}) as grid(n, k, x)),
    h as (select e.*, p.i, p.atr as pa, (p.low <= level_price and p.high >= level_price) or abs(p.close - level_price) <= z as touched,
        case when direction = 'up' then level_price - p.low else p.high - level_price end >= x * p.atr as gone
        from e left join a p on p.instrument = e.instrument and p.i between e.e - greatest(e.n, e.k) and e.e - 1),
    g as (select instrument, crossed_on, level_id, direction, outcome, n, k, x, z, min(i) filter (touched and pa is not null and i >= e - k) as t, max(i) filter (gone and i >= e - k) as o,
        coalesce(bool_or(touched) filter (i >= e - n), false) as near from h group by all),
    st as (select *, case when z is null then null when o > t then 'rejection' when o is not null then null when t is not null then 'retest' when not near then 'direct' end as approach_state from g)"""


@query(sql("day_bars", f"{approach_sql('(10, 5, 0.5)')} select instrument, crossed_on, level_id, direction, outcome, approach_state from st"))
def classify_approach(spark, sf_dir):
    """G3 how price came to a level."""
    d = wn.with_atr(views.day_bars(spark, sf_dir), "instrument", "trade_date")
    ev = events.level_crossings(d, _levels(d), "instrument", "trade_date")
    return events.approach(ev, d, "instrument", "trade_date", [(10, 5, 0.5)], "atr").drop("n", "k", "x")


@query(sql("day_bars", f""", k as (select *, count(*) over (partition by instrument) as c, row_number() over (partition by instrument order by trade_date) - 1 as i, min(close) over (partition by instrument) as lo, max(close) over (partition by instrument) as hi from day_bars),
    h as (select instrument, cast(least(floor((close - lo) * 50 / nullif(hi - lo, 0)), 49) as integer) as bin, sum(exp(-3.0 + 3.0 * i / nullif(c - 1, 0))) as weight, min(lo) as lo, min(hi) as hi from k group by all),
    g as (select instrument, min(lo) as lo, min(hi) as hi, unnest(range(0, 50)) as bin from h group by instrument), f as (select g.*, coalesce(weight, 0) as weight from g left join h using (instrument, bin)),
    s as (select *, avg(weight) over (partition by instrument order by bin rows between 1 preceding and 1 following) as smooth from f), x as (select *, lag(smooth) over w as a, lead(smooth) over w as b from s window w as (partition by instrument order by bin))
    select instrument, cast(bin as integer) as level_id, round(lo + (bin + 0.5) * (hi - lo) / 50, 6) as level_price, round(smooth, 6) as strength from x where smooth > a and smooth > b"""))
def detect_levels(spark, sf_dir):
    """G1 price levels."""
    return rounded(events.detect_levels(views.day_bars(spark, sf_dir), "instrument", "trade_date"))


_X = "rows between unbounded preceding and 1 preceding"


@query(sql("day_bars", f""", r as (select *, high - low as range, lead(close) over w / close - 1 as next_1, lead(close, 2) over w / close - 1 as next_2, cast(lead(high) over w <= high and lead(low) over w >= low as integer) as inside_next from day_bars window w as (partition by instrument order by trade_date)),
    c as (select *, case when count(range) over w >= 60 then quantile_cont(range, 0.9) over w end as cut from r window w as (partition by instrument order by trade_date {_X}))
    select instrument, trade_date, round(range, 6) as range, round(cut, 6) as cut, round((close - low) / range, 6) as close_pos, round(next_1, 6) as next_1, round(next_2, 6) as next_2, inside_next from c where range > cut and (close - low) / range <= 0.5"""))
def downside_continuation(spark, sf_dir):
    """G16 extreme days that close low."""
    return rounded(events.extreme_days(views.day_bars(spark, sf_dir), "instrument", "trade_date", 0.9, 60, 0.5))


@query(sql("day_bars", f""", r as (select *, high - low as range, lead(high) over w as h1, lead(low) over w as l1, lead(high - low) over w as r1, lead(high, 2) over w as h2, lead(low, 2) over w as l2, lead(close, 2) over w as c2, lead(trade_date, 2) over w as d2 from day_bars window w as (partition by instrument order by trade_date)),
    c as (select *, case when count(range) over w >= 60 then quantile_cont(range, 0.8) over w end as cut from r window w as (partition by instrument order by trade_date {_X})),
    s as (select *, case when h2 > h1 and l2 < l1 then 'both' when h2 > h1 then 'up' when l2 < l1 then 'down' else 'none' end as break_side from c where range > cut and r1 < range / 2 and d2 is not null)
    select instrument, trade_date as d0, d2, break_side, round(case break_side when 'up' then c2 - h1 when 'down' then l1 - c2 end, 6) as result from s"""))
def compression_breakout(spark, sf_dir):
    """G17 extreme day, compression, breakout."""
    return rounded(events.compression_breakouts(views.day_bars(spark, sf_dir), "instrument", "trade_date", 0.8, 60))


@query(sql("day_bars", """, a as (select *, high - low as s, row_number() over w as i, lag(low) over w as pl, lag(close) over w as pc, lag(close, 2) over w as c2, lag(close, 3) over w as c3, lag(volume) over w as pv, lag(n) over w as pn,
        max(high) over (partition by instrument order by trade_date rows between 5 preceding and 1 preceding) as h5 from day_bars window w as (partition by instrument order by trade_date)),
    b as (select *, case when count(*) over w >= 20 then avg(volume) over w end as vm, case when count(*) over w >= 20 then stddev_pop(volume) over w end as vs, case when count(*) over w >= 20 then quantile_cont(s, 0.25) over w end as p25,
        sign(pc - c3) as d, (high - greatest(open, close)) / (s + 1e-9) as up, (least(open, close) - low) / (s + 1e-9) as dn, (close - low) / (s + 1e-9) as p from a window w as (partition by instrument order by trade_date rows 19 preceding)),
    c as (select *, (volume - vm) / nullif(vs, 0) as z from b), e as (select *, min(z) over w as z3, avg(s) over w as s3 from c window w as (partition by instrument order by trade_date rows 2 preceding))
    select instrument, trade_date, list_filter([case when z >= 2 and s > 0 and ((d > 0 and up > 0.35) or (d < 0 and dn > 0.35)) then 'ClimacticVolume' end,
    case when s <= p25 and volume <= 0.7::double * vm and close >= open then 'NoDemand' end, case when s <= p25 and volume <= 0.7::double * vm and close < open then 'NoSupply' end,
    case when z >= 1.5 and s > 0 and ((d < 0 and p > 0.6) or (d > 0 and p < 0.4)) then 'StoppingVolume' end, case when low < pl and close > pc and vm > 0 and volume < 0.9::double * vm then 'TestShakeout' end,
    case when z >= 1.2 and s <= p25 then 'EffortVsResult' end, case when i >= 3 and z3 >= 1 and abs(close - c2) <= 0.8::double * s3 then 'Absorption' end, case when i >= 6 and high >= h5 and volume < pv then 'VolumeDivergence' end,
    case when close > pc and n < pn then 'OIdiv_up_price_down_oi' end, case when close < pc and n > pn then 'OIdiv_down_price_up_oi' end], lambda x: x is not null) as tags from e"""))
def volume_patterns(spark, sf_dir):
    """F22 tags of volume against price, range and open interest (here the number of trades)."""
    return events.volume_patterns(views.day_bars(spark, sf_dir), "instrument", "trade_date", oi="n").select("instrument", "trade_date", "tags")


@query(sql("day_bars", "select instrument, trade_date, round(close - open, 6) as pnl from day_bars qualify row_number() over (partition by instrument order by close - open, trade_date) <= 5"))
def weakest_days(spark, sf_dir):
    """E14 the five weakest days of each instrument."""
    from pyspark.sql import Window as W

    d = views.day_bars(spark, sf_dir).select("instrument", "trade_date", (F.col("close") - F.col("open")).alias("pnl"))
    return rounded(d.withColumn("r", F.row_number().over(W.partitionBy("instrument").orderBy("pnl", "trade_date"))).where("r <= 5").drop("r"))
