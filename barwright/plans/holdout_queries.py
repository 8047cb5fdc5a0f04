"""Queries over holdouts, gated grids, validated joins, event packages, and pluggable builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barwright.functions import scalar
from barwright.operators import bars, daily, events, joins, packages, signals, stats, studies, windows as wn
from barwright.plans.registry import query, rounded
from barwright.plans.research_queries import _PAIRS, _SEG, _grid_days, _levels, _LEVELS, grid_sql
from barwright.sources import views
from barwright.sources.views import sql

_D = "(partition by instrument order by trade_date)"
_MONTHS = "mc as (select month as cut from (select distinct cast(date_trunc('month', trade_date) as date) as month from {0}) order by month desc offset 11 limit 1)"
_DD = """te as (select *, sum(pnl_day) over (partition by {0}, fast, slow order by day rows unbounded preceding) as eq from days), td as (select *, eq - max(eq) over (partition by {0}, fast, slow order by day rows unbounded preceding) as dd from te)"""
_RANK = "round(mean_pnl, 6) desc, round(win_rate, 6) desc, round(max_drawdown, 6) desc, fast, slow"


@query(sql("day_bars", f""", {_MONTHS.format("day_bars")}, src as (select case when date_trunc('month', trade_date) >= cut then 'holdout' else 'train' end as role, instrument, trade_date, open, close from day_bars, mc) {grid_sql("src", "role, instrument")}, {_DD.format("role, instrument")},
    s as (select role, instrument, fast, slow, {_SEG}, min(dd) as max_drawdown from td group by all), t as (select *, row_number() over (partition by instrument order by {_RANK}) as r from s where role = 'train')
    select t.instrument, t.fast, t.slow, round(t.mean_pnl, 4) as mean_pnl, round(t.win_rate, 6) as win_rate, round(t.max_drawdown, 3) as max_drawdown, round(t.total_pnl, 3) as total_pnl, t.days,
    round(h.mean_pnl, 4) as holdout_mean_pnl, round(h.win_rate, 6) as holdout_win_rate, round(h.max_drawdown, 3) as holdout_max_drawdown, round(h.total_pnl, 3) as holdout_total_pnl, h.days as holdout_days
    from t left join s h on h.role = 'holdout' and h.instrument = t.instrument and h.fast = t.fast and h.slow = t.slow where r = 1""", recursive=True))
def holdout(spark, sf_dir):
    """F16 the training months' best pair, frozen, on the last twelve months."""
    out = signals.holdout(views.day_bars(spark, sf_dir), "instrument", "trade_date", _PAIRS, 1.0, 12, F.col("trade_date"))
    digits = {"mean_pnl": 4, "win_rate": 6, "max_drawdown": 3, "total_pnl": 3}
    return out.withColumns({p + c: F.round(p + c, n) for p in ("", "holdout_") for c, n in digits.items()})


def _weeks(d: DataFrame) -> DataFrame:
    return d.groupBy("instrument", F.date_trunc("week", "trade_date").cast("date").alias("week")).agg(F.min_by("open", "trade_date").alias("open"), F.max_by("close", "trade_date").alias("close")).withColumnRenamed("week", "trade_date")


@query(sql("day_bars", f""", wk as (select instrument, cast(date_trunc('week', trade_date) as date) as week, arg_min(open, trade_date) as open, arg_max(close, trade_date) as close from day_bars group by all), ws as (select instrument, week as trade_date, open, close from wk),
    {_MONTHS.format("day_bars")}, mw as (select month as cut from (select distinct cast(date_trunc('month', trade_date) as date) as month from ws) order by month desc offset 11 limit 1),
    src as (select 'D1' as timeframe, instrument, trade_date, open, close from day_bars, mc where date_trunc('month', trade_date) >= cut union all select 'W1', instrument, trade_date, open, close from ws, mw where date_trunc('month', trade_date) >= cut)
    {grid_sql("src", "timeframe, instrument")}, {_DD.format("timeframe, instrument")}, s as (select timeframe, instrument, fast, slow, {_SEG}, min(dd) as max_drawdown from td group by all)
    select timeframe, instrument, fast, slow, days, round(mean_pnl, 4) as mean_pnl, round(win_rate, 6) as win_rate, cast(row_number() over (partition by timeframe, instrument order by {_RANK}) as integer) as rank from s""", recursive=True))
def timeframe_holdout(spark, sf_dir):
    """F16 days and weeks, ranked on the last twelve months themselves."""
    d = views.day_bars(spark, sf_dir).select("instrument", "trade_date", "open", "close")
    out = signals.timeframe_holdout({"D1": d, "W1": _weeks(d)}, "instrument", "trade_date", _PAIRS, 1.0, 12, F.col("trade_date"))
    return rounded(out.select("timeframe", "instrument", "fast", "slow", "days", F.round("mean_pnl", 4).alias("mean_pnl"), "win_rate", "rank"))


@query(sql("day_bars", f"""{grid_sql("day_bars", "instrument")}, {_DD.format("instrument")}, ctx as (select instrument, trade_date as day, coalesce(lag((high - low) / open) over {_D} >= 1, false) as blocked from day_bars),
    j as (select td.*, blocked from td join ctx using (instrument, day)), l as (select 'RAW' as mode_name, * from j union all select 'BLOCK', * from j where not blocked), x as (select 'full' as slice_label, * from l union all select 'from_1998-01-01', * from l where day >= date '1998-01-01')
    select mode_name, slice_label, instrument, fast, slow, count(*) as rows, min(day) as first_date, max(day) as last_date, round(sum(pnl_day), 3) as total_pnl, round(max(-dd), 3) as max_drawdown, cast(sum(trades_day) as bigint) as trades,
    round(avg(case when pnl_day > 0 then 1.0 else 0 end), 6) as edge_rate, round(sum(pnl_day) / nullif(max(-dd), 0), 4) as pnl_max_dd from x group by all""", recursive=True))
def gate_filter_grid(spark, sf_dir):
    """F17 every pair's days with and without those that a context blocks, over all days and from 1998 on."""
    d = views.day_bars(spark, sf_dir)
    wide = F.lag((F.col("high") - F.col("low")) / F.col("open")).over(wn.over("instrument", "trade_date"))
    ctx = d.select("instrument", F.col("trade_date").alias("day"), F.coalesce(wide >= 1, F.lit(False)).alias("blocked"))
    out = signals.gated_grid(_grid_days(spark, sf_dir), ctx, ["instrument", "day"], ["instrument", "fast", "slow"], "day", "blocked", "1998-01-01")
    return out.withColumns({"total_pnl": F.round("total_pnl", 3), "max_drawdown": F.round("max_drawdown", 3), "edge_rate": F.round("edge_rate", 6), "pnl_max_dd": F.round("pnl_max_dd", 4)})


@query(sql("day_bars", "order_days", """, m as (select instrument, trade_date, close, fx, ln(fx / lag(fx) over w) as r from day_bars join order_days using (trade_date) window w as (partition by instrument order by trade_date)),
    s as (select *, case when abs(r) >= 0.05 then sign(r) else 0 end as s from m), p as (select *, coalesce(lag(s) over w, 0) as p, close - lag(close) over w as d from s window w as (partition by instrument order by trade_date)),
    t as (select *, p * d as g, cast(p <> coalesce(lag(p) over w, 0) as bigint) as t from p window w as (partition by instrument order by trade_date)),
    a as (select instrument, count(*) as bars, cast(sum(t) as bigint) as trades, avg(case when g <> 0 then case when g > 0 then 1.0 else 0 end end) as win_rate, coalesce(sum(g - t * 2.0), 0) as pnl_net from t group by instrument)
    select instrument, bars, trades, round(win_rate, 6) as win_rate, round(pnl_net, 3) as pnl_net, round(coalesce(pnl_net / nullif(trades, 0), 0), 4) as avg_per_trade from a"""))
def lead_follow(spark, sf_dir):
    """F12 one feed traded in the direction of another's last return."""
    m = views.day_bars(spark, sf_dir).join(views.order_days(spark, sf_dir), "trade_date")
    out = signals.lead_follow(m, ["instrument"], "trade_date", "fx", "close", 0.05, 2.0)
    return out.withColumns({"win_rate": F.round("win_rate", 6), "pnl_net": F.round("pnl_net", 3), "avg_per_trade": F.round("avg_per_trade", 4)})


@query(sql("day_bars", "order_days", "select trade_date, round(avg(close), 6) as close, round(any_value(fx), 6) as fx from day_bars join order_days using (trade_date) group by trade_date"))
def join_one_to_one(spark, sf_dir):
    """D9 two daily series whose days stand once in each."""
    a = views.day_bars(spark, sf_dir).groupBy("trade_date").agg(F.avg("close").alias("close"))
    return rounded(joins.one_to_one(a, views.order_days(spark, sf_dir).select("trade_date", "fx"), ["trade_date"]))


@query("""with s as (select l_orderkey, l_linenumber, l_suppkey, l_extendedprice from lineitem) select s.*, n.n_name as nation from s join supplier on s_suppkey = l_suppkey join nation n on n_nationkey = s_nationkey""")
def lookup_many_to_one(spark, sf_dir):
    """D7 every line with its supplier's nation; a miss or a repeated key would stop the run."""
    s = joins.many_to_one(views.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation")), ["s_nationkey"])
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return joins.many_to_one(li, s.select(F.col("s_suppkey").alias("l_suppkey"), "nation"), ["l_suppkey"])


@query(sql("ticks", """, p as (select trade_id, instrument, ts, cast(ts - interval '1 microsecond' as date) as d, case when epoch_us(ts - interval '1 microsecond') % 86400000000 < 43200000000 then 1 else 2 end as part from ticks)
    select trade_id, instrument, ts, part, cast(d as timestamp) + (part - 1) * interval 12 hour as session_start, cast(d as timestamp) + part * interval 12 hour as session_end from p"""))
def session_cover(spark, sf_dir):
    """D6 every tick in its one half day; a tick in none or in two would stop the run."""
    t = views.ticks(spark, sf_dir).select("trade_id", "instrument", "ts", F.to_date(F.col("ts") - F.expr("interval 1 microsecond")).alias("day"))
    days = t.select("day").distinct().withColumn("part", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("_d", F.col("day").cast("timestamp_ntz"))
    halves = days.select("day", "part", F.expr("_d + make_dt_interval(0, 12 * (part - 1))").alias("session_start"), F.expr("_d + make_dt_interval(0, 12 * part)").alias("session_end"))
    return joins.covered_once(t, halves, ["day"], ["trade_id"], "ts", "session_start", "session_end").drop("day")


@query(sql("bars_1h", """, b as (select *, cast(bar_end - interval '1 microsecond' as date) as day from bars_1h), f as (select *, first_value(high) over w as level, row_number() over w as i, lead(open) over w as nopen, lead(bar_end) over w as nend, last_value(close) over (partition by instrument, day order by bar_end rows between unbounded preceding and unbounded following) as x from b window w as (partition by instrument, day order by bar_end)),
    e as (select instrument, day, level, min(bar_end) filter (high > level) as touched_at, arg_min(nend, bar_end) filter (high > level and nend is not null) as fe, arg_min(nopen, bar_end) filter (high > level and nend is not null) as fo, min(nend) filter (high > level) as any_next, max(x) as x from f group by all)
    select e.instrument, e.day, round(e.level, 6) as level, 1 as side, touched_at, f.nend as filled_at, round(f.nopen, 6) as fill, round(e.x - f.nopen, 6) as pnl from e left join f on f.instrument = e.instrument and f.day = e.day and f.bar_end = e.touched_at"""))
def touch_fills(spark, sf_dir):
    """D15 breaks of each day's first high, filled at the next bar's open, left at the day's close."""
    b = views.event_bars(spark, sf_dir).withColumn("day", signals.session_day("bar_end"))
    e = b.groupBy("instrument", "day").agg(F.min_by("high", "bar_end").alias("level")).withColumn("side", F.lit(1))
    return rounded(joins.touch_fills(e, b, ["instrument"], "day", "bar_end", "level", "side"))


_TF = ["15m", "30m", "1h", "4h", "1d"]


@query(sql("ticks", ", five as (select instrument, time_bucket(interval '5 minutes', ts - interval '1 microsecond') + interval '5 minutes' as bar_end, arg_min(price, ts) as open, max(price) as high, min(price) as low, arg_max(price, ts) as close, count(*) as volume from ticks group by all) " + " union all ".join(
    f"select '{t}' as timeframe, instrument, time_bucket(interval '{bars.duration(t)}', bar_end - interval '1 microsecond') + interval '{bars.duration(t)}' as bar_end, arg_min(open, bar_end) as open, max(high) as high, min(low) as low, arg_max(close, bar_end) as close, cast(sum(volume) as bigint) as volume, count(*) as source_bars from five group by all" for t in _TF)))
def resample_all(spark, sf_dir):
    """C1 five-minute bars to every coarser timeframe."""
    five = bars.ticks_to_bars(views.ticks(spark, sf_dir), "5 minutes")
    out = None
    for t in _TF:
        part = bars.resample(five, t).withColumn("timeframe", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


@query(sql("ticks", """, p as (select time_bucket(interval '1 hour', ts) as bucket, arg_max(price, ts) filter (user_id % 2 = 0) as FIZ, arg_max(price, ts) filter (user_id % 2 = 1) as YUR from ticks group by all), t as (select *, abs(FIZ) + abs(YUR) as oi from p)
    select bucket, FIZ, YUR, round(oi, 6) as oi_total, round(abs(FIZ) / nullif(oi, 0), 6) as FIZ_share, round(abs(YUR) / nullif(oi, 0), 6) as YUR_share, round(oi - lag(oi) over (order by bucket), 6) as oi_delta from t"""))
def group_shares(spark, sf_dir):
    """C13 client groups' shares of open interest, and its change from hour to hour."""
    t = views.ticks(spark, sf_dir).withColumn("clgroup", F.when(F.col("user_id") % 2 == 0, "FIZ").otherwise("YUR")).withColumn("bucket", F.window("ts", "1 hour")["start"])
    return rounded(daily.group_shares(t, ["bucket"], "clgroup", ["FIZ", "YUR"], "price", F.col("ts"), "bucket"))


@query(sql("day_bars", """, p as (select instrument, trade_date, close - open as pnl, low < 0.7::double * open as stopped from day_bars) select instrument, cast(date_trunc('month', trade_date) as date) as period, count(*) as trades, count(distinct trade_date) as days, round(sum(pnl), 5) as net, round(avg(pnl), 6) as mean,
    round(avg(case when pnl > 0 then 1.0 else 0 end), 6) as win_rate, round(avg(case when stopped then 1.0 else 0 end), 6) as stop_rate, sum(pnl) > 0 as profitable from p group by all"""))
def period_report_month(spark, sf_dir):
    """C18 results by month, with the rate of stopped trades."""
    d = views.day_bars(spark, sf_dir).withColumn("pnl_day", F.col("close") - F.col("open")).withColumn("stopped", F.col("low") < 0.7 * F.col("open"))
    return rounded(daily.period_report(d, ["instrument"], "trade_date", "month", stopped="stopped").withColumn("net", F.round("net", 5)))


@query(sql("day_bars", """, p as (select instrument, case when trade_date <= date '1998-12-31' then 'train' else 'test' end as period, trade_date, close - open as pnl from day_bars), e as (select *, sum(pnl) over w as eq from p window w as (partition by instrument, period order by trade_date rows unbounded preceding)),
    k as (select *, eq - max(eq) over (partition by instrument, period order by trade_date rows unbounded preceding) as dd from e)
    select instrument, period, count(*) as n, case when count(*) filter (pnl < 0) = 0 then 'infinity'::double else round(sum(case when pnl > 0 then pnl else 0 end) / sum(case when pnl < 0 then -pnl else 0 end), 6) end as profit_factor,
    round(avg(case when pnl > 0 then 1.0 else 0 end), 6) as win_rate, round(min(dd), 4) as max_drawdown from k group by all"""))
def trade_stats_periods(spark, sf_dir):
    """C19, B19 trade statistics of the training and the test period."""
    d = views.day_bars(spark, sf_dir).withColumn("pnl_day", F.col("close") - F.col("open")).withColumn("period", scalar.period_of("trade_date", "1998-12-31"))
    return rounded(daily.trade_stats(d, ["instrument", "period"], "trade_date").withColumn("max_drawdown", F.round("max_drawdown", 4)))


@query(sql("day_bars", f""", g as (select instrument, trade_date, close > open as good, lead(close > open) over {_D} as nxt from day_bars), c as (select *, case when good = lag(good) over {_D} then 0 else 1 end as c from g), r as (select *, sum(c) over (partition by instrument order by trade_date rows unbounded preceding) as id from c),
    l as (select instrument, good, id, count(*) as len from r group by all), a as (select instrument, avg(case when good then 1.0::double else 0 end) as pg, avg(case when nxt then 1.0::double else 0 end) filter (good and nxt is not null) as pgg, avg(case when not nxt then 1.0::double else 0 end) filter (not good and nxt is not null) as pbb from g group by instrument),
    m as (select instrument, avg(len) filter (good) as mean_g, avg(len) filter (not good) as mean_b from l group by instrument)
    select instrument, round(pg, 6) as p_good, round(pgg, 6) as p_good_good, round(pbb, 6) as p_bad_bad, round(mean_g, 6) as mean_good_run, round(1 / nullif(1 - pg, 0), 6) as iid_good_run, round(mean_b, 6) as mean_bad_run, round(1 / nullif(pg, 0), 6) as iid_bad_run,
    case when pgg - pg >= 0.05 and mean_g > 1 / nullif(1 - pg, 0) then 'CLUSTERED' when pg - pgg >= 0.05 then 'ALTERNATING' else 'IID_LIKE' end as verdict from a join m using (instrument)"""))
def run_verdict(spark, sf_dir):
    """E12 runs against what independent days would give."""
    d = views.day_bars(spark, sf_dir).select("instrument", "trade_date", (F.col("close") > F.col("open")).alias("good"))
    return rounded(stats.run_verdict(d, "good", "instrument", "trade_date"))


@query(sql("day_bars", f""", {_LEVELS}, t as (select *, case when level_id in (1, 4) then 'outer' else 'inner' end as level_type from lv) select d.instrument, d.trade_date, level_type, bool_or(abs(close - level_price) <= 0.05 * level_price) as near_level,
    bool_or((open < level_price and close > level_price) or (open > level_price and close < level_price)) as breakout,
    bool_or(low <= level_price and high >= level_price and not ((open < level_price and close > level_price) or (open > level_price and close < level_price))) as rebound,
    count(*) filter ((open < level_price and close > level_price) or (open > level_price and close < level_price)) as broken from day_bars d join t using (instrument) group by all"""))
def level_type_events(spark, sf_dir):
    """G5 days at price levels, by type of level."""
    d = views.day_bars(spark, sf_dir)
    lv = _levels(d).withColumn("level_type", F.when(F.col("level_id").isin(1, 4), "outer").otherwise("inner"))
    return studies.level_bar_events(d, lv, "instrument", "trade_date", 0.05, by=["level_type"])


_X = "rows between unbounded preceding and 1 preceding"
_EVENT_SQL = f""", r as (select *, high - low as range, lead(close) over {_D} / close - 1 as next_1 from day_bars), c as (select *, case when count(range) over w >= 60 then quantile_cont(range, [0.8, 0.9]) over w end as cuts from r window w as (partition by instrument order by trade_date {_X})),
    g as (select c.*, q, loc, case when q = 0.8 then cuts[1] else cuts[2] end as cut from c, (values (0.8::double, 0.3::double), (0.8, 0.5), (0.9, 0.3), (0.9, 0.5)) as k(q, loc)),
    e as (select *, coalesce(range > cut and (close - low) / nullif(range, 0) <= loc, false) as hit from g where next_1 is not null)"""


@query(sql("day_bars", f"""{_EVENT_SQL}, b as (select instrument, q, loc, avg(case when next_1 < 0 then 1.0::double else 0 end) as base from e group by all) select e.instrument, e.q, e.loc, count(*) as n, round(avg(next_1), 6) as mean_next, round(median(next_1), 6) as median_next,
    round(avg(case when next_1 < 0 then 1.0::double else 0 end), 6) as down_rate, round(any_value(base), 6) as base_rate, round(avg(case when next_1 < 0 then 1.0::double else 0 end) / nullif(any_value(base), 0), 6) as lift from e join b using (instrument, q, loc) where hit group by all"""))
def downside_fragility(spark, sf_dir):
    """G16 summary and lift of extreme low-closing days over a grid of cuts."""
    return rounded(packages.downside_fragility(views.day_bars(spark, sf_dir), "instrument", "trade_date", [0.8, 0.9], [0.3, 0.5], 60))


@query(sql("day_bars", f"""{_EVENT_SQL}, h as (select instrument, trade_date, row_number() over {_D} as i, hit from e where q = 0.8 and loc = 0.5), v as (select * from h where hit), w as (select *, case when i - lag(i) over {_D} <= 3 then 0 else 1 end as c from v), k as (select *, sum(c) over (partition by instrument order by i rows unbounded preceding) as cluster from w),
    s as (select instrument, cluster, count(*) as n from k group by all), y as (select instrument, year(trade_date) as y, count(*) as n from v group by all)
    select s.instrument, cast(sum(s.n) as bigint) as events, count(*) as clusters, max(s.n) as largest_cluster, round(max(s.n) / sum(s.n), 6) as largest_share, round((select max(n) from y where y.instrument = s.instrument) / sum(s.n), 6) as top_year_share from s group by s.instrument"""))
def event_dependence(spark, sf_dir):
    """G16 how far events come in clusters and in single years."""
    return rounded(packages.dependence(packages.downside_events(views.day_bars(spark, sf_dir), "instrument", "trade_date", [0.8], [0.5], 60), "instrument", "trade_date", 3))


@query(sql("day_bars", f""", r as (select *, high - low as range, lead(high) over w as h1, lead(low) over w as l1, lead(high - low) over w as r1, lead(high, 2) over w as h2, lead(low, 2) over w as l2, lead(open, 2) over w as o2, lead(close, 2) over w as c2 from day_bars window w as (partition by instrument order by trade_date)),
    c as (select *, case when count(range) over w >= 60 then quantile_cont(range, [0.8, 0.9]) over w end as cuts from r window w as (partition by instrument order by trade_date {_X})),
    g as (select c.*, q, squeeze, case when q = 0.8 then cuts[1] else cuts[2] end as cut from c, (values (0.8::double, 0.5::double), (0.8, 0.7), (0.9, 0.5), (0.9, 0.7)) as k(q, squeeze)),
    s as (select *, case when h2 > h1 and l2 < l1 then 'both' when h2 > h1 then 'up' when l2 < l1 then 'down' else 'none' end as side from g where range > cut and r1 < squeeze * range and c2 is not null)
    select q, squeeze, side, count(*) as n, round(avg(case side when 'up' then c2 - greatest(h1, o2) when 'down' then least(l1, o2) - c2 end), 6) as mean_result, round(median(case side when 'up' then c2 - greatest(h1, o2) when 'down' then least(l1, o2) - c2 end), 6) as median_result,
    round(avg(case side when 'up' then case when c2 > greatest(h1, o2) then 1.0 else 0 end when 'down' then case when c2 < least(l1, o2) then 1.0 else 0 end end), 6) as win_rate from s group by all"""))
def breakout_fragility(spark, sf_dir):
    """G17 breakouts by side over a grid of cuts, filled at the level or at an open beyond it."""
    return rounded(packages.breakout_fragility(views.day_bars(spark, sf_dir), "instrument", "trade_date", [0.8, 0.9], [0.5, 0.7], 60))


@query("select l_returnflag as flag, l_linestatus as status, l_orderkey as k, l_linenumber as n from lineitem")
def sorted_projection(spark, sf_dir):
    """J4 a projection in a stated order of several keys."""
    li = views.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).orderBy("flag", F.desc("status"), "k", "n")


@query(sql("day_bars", f""", f as (select *, close / lag(close) over {_D} - 1 as momentum, (close - low) / nullif(high - low, 0) as location from day_bars), s as (select *, case when momentum > 0.1 and location > 0.6 then 1 when momentum < -0.1 and location < 0.4 then -1 else 0 end as signal from f)
    select instrument, trade_date, signal, coalesce(lag(signal) over {_D}, 0) as position from s"""))
def pluggable_builders(spark, sf_dir):
    """J5 features and signals as functions that a caller registers, run by one pipeline."""
    features: dict[str, Callable[[], Column]] = {
        "momentum": lambda: wn.pct_change("close", wn.over("instrument", "trade_date")),
        "location": lambda: F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
    }

    def signal(df: DataFrame) -> DataFrame:
        up, down = (F.col("momentum") > 0.1) & (F.col("location") > 0.6), (F.col("momentum") < -0.1) & (F.col("location") < 0.4)
        return df.withColumn("signal", F.when(up, 1).when(down, -1).otherwise(0))

    return packages.built(views.day_bars(spark, sf_dir), ["instrument"], "trade_date", features, signal).select("instrument", "trade_date", "signal", "position")


@query(sql("trades", """select instrument, trade_date, round(median(price), 6) as median_price, round(quantile_cont(price, 0.9), 6) as p90_price, case when count(*) filter (price - 1500 < 0) = 0 then 'infinity'::double else round(coalesce(sum(price - 1500) filter (price > 1500), 0) / -sum(price - 1500) filter (price < 1500), 6) end as profit_factor from trades group by all"""))
def aggregates(spark, sf_dir):
    """J6 median, quantile and profit factor as aggregates of a group."""
    t = views.trades(spark, sf_dir).withColumn("d", F.col("price") - 1500)
    return rounded(t.groupBy("instrument", "trade_date").agg(F.median("price").alias("median_price"), F.percentile("price", F.lit(0.9)).alias("p90_price"), daily.profit_factor("d").alias("profit_factor")))


@query("""with e as (select event_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') as t, event_id % 3 as k from events)
    select event_id, case k when 0 then try_cast(t as timestamp) - interval 3 hour when 1 then try_cast(t as timestamp) - interval 5 hour else null end as utc from e""")
def localized_times(spark, sf_dir):
    """B6 wall clocks of a zone, times with an offset of their own, and texts that are no time."""
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    k = F.col("event_id") % 3
    raw = F.when(k == 0, t).when(k == 1, F.concat(t, F.lit("+05:00"))).otherwise(F.concat(F.lit("at "), t))
    return views.table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", scalar.localized("raw", "Europe/Moscow").alias("utc"))
