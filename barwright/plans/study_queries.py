"""Queries over studies: executions, contexts, screens, sweeps, the lake's refresh, and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.operators import bars, events, recurrence, signals, studies, windows as wn
from barwright.plans.joins_queries import _ROLL, ema_sql
from barwright.plans.registry import query, rounded
from barwright.plans.research_queries import _levels, _LEVELS, approach_sql, SIGNAL_SQL
from barwright.sources import views
from barwright.sources.room import room as _room
from barwright.sources.views import sql

_D = "(partition by instrument order by trade_date)"


@query(sql("day_bars", f""", s as (select instrument, trade_date, case when high >= 2 * low then -1 when high <= 1.2 * low then 1 end as want from day_bars),
    b as (select d.*, lag(s.want) over (partition by d.instrument order by d.trade_date) as w from day_bars d join s using (instrument, trade_date)),
    p as (select *, coalesce(last_value(w ignore nulls) over (partition by instrument order by trade_date rows unbounded preceding), 0) as position from b),
    t as (select *, abs(position - coalesce(lag(position) over {_D}, 0)) as trades, coalesce(lead(open) over {_D}, close) - open as step, lead(trade_date) over {_D} is null as last from p)
    select instrument, trade_date, position, trades, round(position * step - trades * 0.5::double - case when last then abs(position) * 0.5::double else 0 end, 6) as pnl_bar from t"""))
def signal_backtest(spark, sf_dir):
    """F5 sparse decisions executed on the next bar and held."""
    d = views.day_bars(spark, sf_dir)
    want = F.when(F.col("high") >= 2 * F.col("low"), -1).when(F.col("high") <= 1.2 * F.col("low"), 1)
    s = d.select("instrument", F.col("trade_date").alias("decision_ts"), want.alias("desired_position")).where("desired_position is not null")
    out = studies.execute_signals(d.select("instrument", "trade_date", "open", "close"), s, ["instrument"], "trade_date", 0.5)
    return rounded(out.select("instrument", "trade_date", "position", "trades", "pnl_bar"))


@query(sql("bars_1h", f""", {ema_sql(5, 12)}, g as (select instrument, bar_end, close, cast(sign(ema_fast - ema_slow) as integer) as target from ema),
    p as (select *, coalesce(lag(target) over w, 0) as position from g window w as (partition by instrument order by bar_end)),
    r as (select instrument, bar_end, position, coalesce(lag(position) over w, 0) * coalesce(close - lag(close) over w, 0) - abs(position - coalesce(lag(position) over w, 0)) * 0.05::double as pnl from p window w as (partition by instrument order by bar_end))
    select instrument, bar_end, position, round(pnl, 5) as pnl, round(sum(pnl) over (partition by instrument order by bar_end rows unbounded preceding), 4) as cum_pnl from r""", recursive=True))
def pending_execution(spark, sf_dir):
    """F21 targets taken at the next close."""
    e = recurrence.with_ema(views.event_bars(spark, sf_dir).select("instrument", "bar_end", "close"), ["instrument"], ["bar_end"], "close", {"f": 5, "s": 12})
    out = studies.pending_execution(e.withColumn("target", F.signum(F.col("f") - F.col("s")).cast("int")), ["instrument"], "bar_end", "target", 0.1)
    return out.select("instrument", "bar_end", "position", F.round("pnl", 5).alias("pnl"), F.round("cum_pnl", 4).alias("cum_pnl"))


@query(sql("bars_1h", f""", {ema_sql(5, 12)}, s as (select instrument, bar_end, close, last_value(nullif(sign(ema_fast - ema_slow), 0) ignore nulls) over (partition by instrument order by bar_end rows unbounded preceding) as p from ema),
    r as (select instrument, coalesce(lag(coalesce(p, 0)) over w, null) * (close - lag(close) over w) as r from s window w as (partition by instrument order by bar_end))
    select instrument, count(r) as bars, round(sum(r), 4) as total, round(avg(case when r <> 0 then case when r > 0 then 1.0 else 0 end end), 6) as win_rate, round(avg(r) / stddev_samp(r), 6) as sharpe from r group by instrument""", recursive=True))
def ma_always_in(spark, sf_dir):
    """F11 always in the market."""
    e = recurrence.with_ema(views.event_bars(spark, sf_dir).select("instrument", "bar_end", "close"), ["instrument"], ["bar_end"], "close", {"f": 5, "s": 12})
    return rounded(studies.always_in(e, ["instrument"], "bar_end", "f", "s").withColumn("total", F.round("total", 4)))


@query(sql("day_bars", """, e as (select instrument, trade_date, close as price from day_bars where day(trade_date) = 10)
    select e.instrument, e.trade_date, e.price, min(b.trade_date) as touched_at from e left join day_bars b on b.instrument = e.instrument and b.trade_date > e.trade_date and b.close <= e.price * 0.9 and b.trade_date <= e.trade_date + 90 group by all"""))
def first_hit_exit(spark, sf_dir):
    """F10 overlapping entries with their first exit."""
    d = views.day_bars(spark, sf_dir)
    e = d.where(F.dayofmonth("trade_date") == 10).select("instrument", "trade_date", F.col("close").alias("price"))
    return studies.first_hit_exit(e, d, ["instrument"], "trade_date", "trade_date", F.col("b.close") <= F.col("e.price") * 0.9, 90)


@query(sql("day_bars", f"""{SIGNAL_SQL}, n as (select instrument, trade_date, high, low, close, atr, signal, lag(close) over {_D} as poc, row_number() over {_D} as rn from ms),
    st(instrument, rn, trade_date, side, price, stop, goal, entry, kind, pnl) as (select instrument, rn, trade_date, case when signal <> 0 and atr is not null then signal else 0 end, close, close - signal * atr, poc, trade_date, null::varchar, null::double from n where rn = 1
        union all select n.instrument, n.rn, n.trade_date, case when x.hit is not null then 0 when s.side <> 0 then s.side when n.signal <> 0 and n.atr is not null then n.signal else 0 end,
            case when s.side <> 0 then s.price else n.close end, case when s.side <> 0 then s.stop else n.close - n.signal * n.atr end, case when s.side <> 0 then s.goal else n.poc end, case when s.side <> 0 then s.entry else n.trade_date end,
            x.hit, case x.hit when 'stop' then (s.stop - s.price) * s.side when 'poc' then (n.close - s.price) * s.side end
        from st s join n on n.instrument = s.instrument and n.rn = s.rn + 1, lateral (select case when s.side = 0 then null when (case when s.side > 0 then n.low else n.high end - s.stop) * s.side <= 0 then 'stop' when (n.close - s.goal) * s.side >= 0 then 'poc' end as hit) x)
    select instrument, lag(entry) over {_D} as entry, trade_date as exit, cast(lag(side) over {_D} as integer) as side, pnl, kind as reason from st qualify kind is not null""", recursive=True))
def stop_or_poc(spark, sf_dir):
    """F10 stop, else the level; one position at a time."""
    d = wn.with_atr(views.day_bars(spark, sf_dir), "instrument", "trade_date")
    d = signals.threshold_positions(d, "instrument", "trade_date", 20, 1.5).withColumn("poc", F.lag("close").over(wn.over("instrument", "trade_date")))
    return studies.stop_or_poc(d.select("instrument", "trade_date", "high", "low", "close", "atr", "signal", "poc"), "instrument", "trade_date", 1.0)


@query(sql("day_bars", f""", f as (select instrument, trade_date, (high - low) / nullif(open, 0) as v, abs(close - open) / nullif(high - low, 0) as b from day_bars),
    z as (select *, case when count(v) over w >= 20 and stddev_pop(v) over w > 0 then (v - avg(v) over w) / stddev_pop(v) over w end as z from f window w as (partition by instrument order by trade_date rows between unbounded preceding and 1 preceding)),
    l as (select instrument, trade_date, lag(z) over {_D} as vol_z, lag(b) over {_D} as body_ratio from z), s as (select *, 1 / (1 + exp(-(-0.2::double + 0.8::double * vol_z + -1.1::double * body_ratio))) as score from l)
    select instrument, trade_date, round(vol_z, 6) as vol_z, round(body_ratio, 6) as body_ratio, round(score, 6) as score, case when score is null then 'blocked' when score < 0.3 then 'adverse' when score > 0.5 then 'favorable' else 'neutral' end as context from s"""))
def day_context(spark, sf_dir):
    """F20 context of a day from the session before."""
    return rounded(studies.day_context(views.day_bars(spark, sf_dir), "instrument", "trade_date", {"bias": -0.2, "vol_z": 0.8, "body_ratio": -1.1}, 0.3, 0.5))


@query(sql("day_bars", f""", f as (select instrument, trade_date, cast(close > open as integer) as good, trade_date < date '1999-01-01' as train, lag((high - low) / open) over {_D} as rel_range, lag(volume) over {_D} as prior_volume from day_bars),
    l as (select good, train, unnest(['rel_range', 'prior_volume']) as feature, unnest([rel_range, prior_volume]) as value from f), v as (select * from l where value is not null),
    c as (select feature, quantile_cont(value, 0.1) as lo, quantile_cont(value, 0.9) as hi from v where train group by feature having count(*) >= 200), b as (select train, avg(good) as base from f group by train),
    h as (select feature, 'low' as tail, train, good, lo as cut from v join c using (feature) where value <= lo union all select feature, 'high', train, good, hi from v join c using (feature) where value >= hi),
    p as (select feature, tail, train, any_value(cut) as cut, count(*) as n, avg(good) as rate from h group by all)
    select feature, tail, case when train then 'train' else 'test' end as period, round(cut, 6) as cut, n, round(rate, 6) as rate, round(rate / base, 6) as lift, n >= 30 and rate / base >= 1.2 and rate >= base + 0.02 as ok from p join b using (train)"""))
def quantile_feature_screen(spark, sf_dir):
    """G11 features screened by their tails."""
    w = wn.over("instrument", "trade_date")
    d = views.day_bars(spark, sf_dir).select(
        "trade_date", (F.col("close") > F.col("open")).cast("int").alias("good"), F.lag((F.col("high") - F.col("low")) / F.col("open")).over(w).alias("rel_range"), F.lag("volume").over(w).alias("prior_volume")
    )
    return rounded(studies.quantile_screen(d, ["rel_range", "prior_volume"], "good", F.col("trade_date") < "1999-01-01", 0.1, 30))


@query(sql("day_bars", f"""{approach_sql('(10, 3, 0.5), (10, 3, 1.0), (10, 5, 0.5), (15, 5, 1.0)')} select n, k, cast(x as double) as x, approach_state, count(*) as events, count(*) filter (outcome = 'confirmed') as hits,
    round((count(*) filter (outcome = 'confirmed') + 1) / (count(*) + 2), 6) as p from st where outcome is not null and approach_state is not null group by all"""))
def approach_sweep(spark, sf_dir):
    """G4 approach states over a grid of parameters."""
    d = wn.with_atr(views.day_bars(spark, sf_dir), "instrument", "trade_date")
    c = events.level_crossings(d, _levels(d), "instrument", "trade_date")
    return rounded(studies.approach_sweep(c, d, "instrument", "trade_date", [(10, 3, 0.5), (10, 3, 1.0), (10, 5, 0.5), (15, 5, 1.0)], "atr"))


@query(sql("day_bars", f""", {_LEVELS} select d.instrument, d.trade_date, bool_or(abs(close - level_price) <= 0.05 * level_price) as near_level,
    bool_or((open < level_price and close > level_price) or (open > level_price and close < level_price)) as breakout,
    bool_or(low <= level_price and high >= level_price and not ((open < level_price and close > level_price) or (open > level_price and close < level_price))) as rebound,
    count(*) filter ((open < level_price and close > level_price) or (open > level_price and close < level_price)) as broken from day_bars d join lv using (instrument) group by all"""))
def level_bar_events(spark, sf_dir):
    """G5 days at price levels."""
    d = views.day_bars(spark, sf_dir)
    return studies.level_bar_events(d, _levels(d), "instrument", "trade_date", 0.05)


@query(sql("day_bars", "sessions", "contracts", f""", {_ROLL} select d.instrument, d.trade_date, d.open, d.high, d.low, d.close, r.secid from day_bars d join rolls r on r.family = d.instrument and d.trade_date >= r.valid_from and (r.valid_through is null or d.trade_date <= r.valid_through)"""))
def lake_refresh(spark, sf_dir):
    """H20 the batch run, stage by stage."""
    raw = views.day_bars(spark, sf_dir).select("instrument", "trade_date", "open", "high", "low", "close")
    return studies.refresh(spark, _room(spark), raw, views.contracts(spark, sf_dir), "trade_date")


@query(sql("sessions", """, d as (select cast(trade_date as timestamp) as d from sessions)
    select cast(unnest(generate_series(d + interval '10 hours 5 minutes', d + interval '14 hours', interval 5 minute)) as timestamp) as expected_end, cast(d as date) as trade_date from d"""))
def expected_bars(spark, sf_dir):
    """J7, D7 the bars that a calendar expects."""
    s = views.sessions(spark, sf_dir).withColumn("d", F.col("trade_date").cast("timestamp_ntz"))
    ends = F.expr("sequence(d + interval 10 hours 5 minutes, d + interval 14 hours, interval 5 minutes)")
    return s.select(F.explode(ends).alias("expected_end"), "trade_date")


@query(sql("sessions", """, d as (select cast(trade_date as timestamp) as d from sessions)
    select cast(unnest(generate_series(d + interval '10 hours 5 minutes', d + interval '14 hours', interval 5 minute)) as timestamp) as expected_end, cast(d as date) as trade_date from d"""))
def expected_bars_calendar(spark, sf_dir):
    """J7 the bars that a calendar expects, for every session."""
    s = views.sessions(spark, sf_dir).withColumn("d", F.col("trade_date").cast("timestamp_ntz"))
    ends = F.expr("sequence(d + interval 10 hours 5 minutes, d + interval 14 hours, interval 5 minutes)")
    return s.select(F.explode(ends).alias("expected_end"), "trade_date")


@query("""select n_nationkey as k from nation intersect select c_nationkey from customer union select r_regionkey + 100 from region except select 101""")
def set_operations(spark, sf_dir):
    """J2, J3 set operations."""
    n = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    c = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    r = views.table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("k"))
    return n.intersect(c).union(r).distinct().subtract(r.where("k = 101"))


@query(sql("ticks", """, m as (select instrument, time_bucket(interval '5 minutes', ts - interval '1 microsecond') as part_start, price, ts from ticks), p as (select instrument, part_start, arg_min(price, ts) as open, max(price) as high, min(price) as low, arg_max(price, ts) as close from m group by all)
    select instrument, time_bucket(interval '15 minutes', part_start) as bucket, arg_min(open, part_start) as open, max(high) as high, min(low) as low, arg_max(close, part_start) as close from p group by all having count(*) = 3"""))
def complete_15m(spark, sf_dir):
    """I8 quarter hours of which all three parts came; the batch form."""
    b = bars.ticks_to_bars(views.ticks(spark, sf_dir), "5 minutes").withColumn("at", F.col("bar_end") - F.expr("interval 5 minutes"))
    g = b.groupBy("instrument", F.window("at", "15 minutes")["start"].alias("bucket")).agg(
        F.min_by("open", "at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "at").alias("close"), F.count(F.lit(1)).alias("n")
    )
    return g.where("n = 3").drop("n")
