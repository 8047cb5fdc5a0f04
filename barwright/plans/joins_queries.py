"""Queries over joins, rolls, calendars, and window analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.functions import scalar
from barwright.operators import bars, blocked, joins, quality, recurrence, windows as wn
from barwright.plans.registry import query, rounded
from barwright.sources import lake, views
from barwright.sources.room import kept
from barwright.sources.views import sql


@query(sql("day_bars", "order_days", "select instrument, trade_date, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, volume, n, round(o.fx, 6) as fx, o.orders from day_bars d left join order_days o using (trade_date)"))
def enrich_left(spark, sf_dir):
    """D1 left enrichment by day."""
    return rounded(joins.enrich(views.day_bars(spark, sf_dir), views.order_days(spark, sf_dir), ["trade_date"]))


@query(sql("day_bars", "order_days", "select d.trade_date, d.instrument, round(d.close, 6) as close, round(o.fx, 6) as fx from day_bars d join order_days o using (trade_date)"))
def join_inner(spark, sf_dir):
    """D2 two feeds on the days of both."""
    return rounded(views.day_bars(spark, sf_dir).join(views.order_days(spark, sf_dir), "trade_date").select("trade_date", "instrument", "close", "fx"))


@query(sql("sessions", "order_days", "select trade_date, s.trade_date is not null as traded, o.orders from sessions s full join order_days o using (trade_date)"))
def join_outer(spark, sf_dir):
    """D3 full outer join of two feeds."""
    s = views.sessions(spark, sf_dir).withColumn("traded", F.lit(True))
    return s.join(views.order_days(spark, sf_dir), "trade_date", "full").select("trade_date", F.coalesce("traded", F.lit(False)).alias("traded"), "orders")


@query(sql("ticks", """, l as (select trade_id, ts, user_id % 7 as k, price from ticks where instrument = 'click'), r as (select ts, user_id % 7 as k, price from ticks where instrument = 'view')
    select l.trade_id, l.ts, l.k, l.price, case when r.ts >= l.ts - interval 30 minute then r.price end as view_price from l asof left join r on l.k = r.k and l.ts >= r.ts"""))
def asof_tolerance(spark, sf_dir):
    """D4 last quote at or before a trade, at most 30 minutes old."""
    t = views.ticks(spark, sf_dir).withColumn("k", F.col("user_id") % 7)
    left = t.where("instrument = 'click'").select("k", "ts", "trade_id", "price")
    right = t.where("instrument = 'view'").select("k", "ts", F.col("price").alias("view_price"))
    return joins.asof(left, right, ["k"], "ts", ["view_price"], "30 minutes")


_ROLL = """near as (select family, secid, anchor, (select max(trade_date) from sessions s where s.trade_date < anchor) as roll_date from contracts),
    seq as (select *, lead(secid) over (partition by family order by anchor) as next_secid, lag(roll_date) over (partition by family order by anchor) as p from near),
    rolls as (select family, secid, anchor, roll_date, next_secid, case when p is null then (select min(trade_date) from sessions) else (select min(trade_date) from sessions s where s.trade_date > p) end as valid_from,
        case when next_secid is not null then roll_date end as valid_through from seq)"""


def _rolls(spark, sf_dir):
    # both are small, and the map reads them many times; they are taken from the trades once
    contracts, sessions = kept(views.contracts(spark, sf_dir)), kept(views.sessions(spark, sf_dir))
    return kept(quality.roll_map(contracts, sessions, "family", "anchor", "trade_date"))


@query(sql("sessions", "contracts", f", {_ROLL} select * from rolls"))
def roll_map(spark, sf_dir):
    """H7, D18 roll dates and validity windows."""
    return _rolls(spark, sf_dir)


@query(sql("day_bars", "sessions", "contracts", f""", {_ROLL}, j as (select d.instrument, d.trade_date, d.close, r.secid, r.valid_from from day_bars d join rolls r on r.family = d.instrument
        and d.trade_date >= r.valid_from and (r.valid_through is null or d.trade_date <= r.valid_through))
    select instrument, trade_date, close, secid, coalesce(secid <> lag(secid) over (partition by instrument order by trade_date), false) as is_roll_boundary from j"""))
def roll_join(spark, sf_dir):
    """D5 bars stitched by validity windows, with the first session of each later contract."""
    rolls = _rolls(spark, sf_dir).withColumnRenamed("family", "instrument")
    j = joins.interval_join(views.day_bars(spark, sf_dir), rolls, ["instrument"], "trade_date", "valid_from", "valid_through")
    first = F.coalesce(F.col("secid") != F.lag("secid").over(wn.over("instrument", "trade_date")), F.lit(False))
    return j.select("instrument", "trade_date", "close", "secid", first.alias("is_roll_boundary"))


@query(sql("day_bars", "sessions", "contracts", f""", {_ROLL} select instrument, trade_date, count(*) as matches from day_bars d join rolls r on r.family = d.instrument
    and d.trade_date >= r.valid_from - interval 5 day and (r.valid_through is null or d.trade_date <= r.valid_through) group by all having count(*) > 1"""))
def roll_ambiguity(spark, sf_dir):
    """D5 sessions that overlapping windows match twice."""
    rolls = _rolls(spark, sf_dir).withColumnRenamed("family", "instrument").withColumn("early", F.date_sub("valid_from", 5))
    j = joins.interval_join(views.day_bars(spark, sf_dir), rolls, ["instrument"], "trade_date", "early", "valid_through")
    return joins.ambiguous(j, ["instrument", "trade_date"])


@query(sql("sessions", "contracts", f""", {_ROLL}, e as (select *, max(coalesce(valid_through, date '9999-12-31')) over (partition by family order by valid_from rows between unbounded preceding and 1 preceding) as b from rolls)
    select family, secid, coalesce(b >= valid_from, false) as overlapping from e"""))
def roll_overlaps(spark, sf_dir):
    """E18 windows that begin before an earlier one has ended."""
    r = _rolls(spark, sf_dir)
    return r.select("family", "secid", wn.overlaps(r, "family", "valid_from", "valid_through").alias("overlapping"))


@query(sql("day_bars", "sessions", "select i.instrument, s.trade_date from (select distinct instrument from day_bars) i, sessions s where not exists (select 1 from day_bars d where d.instrument = i.instrument and d.trade_date = s.trade_date)"))
def missing_sessions(spark, sf_dir):
    """D8 sessions without a bar."""
    d = views.day_bars(spark, sf_dir)
    names = [r[0] for r in d.select("instrument").distinct().collect()]  # instruments are configuration, not data
    expected = views.sessions(spark, sf_dir).select(F.explode(F.array(*map(F.lit, names))).alias("instrument"), "trade_date")
    return joins.missing_keys(expected, d, ["instrument", "trade_date"])


@query(sql("day_bars", "sessions", """, f as (select instrument, min(trade_date) as a from day_bars group by all), e as (select f.instrument, s.trade_date from f join sessions s on s.trade_date >= f.a)
    select instrument, count(*) as expected_days, count(d.close) as observed_days, count(*) - count(d.close) as missing_days, round(count(d.close) / count(*), 6) as coverage
    from e left join day_bars d using (instrument, trade_date) group by all"""))
def calendar_gaps(spark, sf_dir):
    """D17 coverage since the first day."""
    return rounded(joins.calendar_gaps(views.sessions(spark, sf_dir), views.day_bars(spark, sf_dir), "instrument", "trade_date"))


@query(sql("sessions", "order_days", """select trade_date as day, 'left' as side from sessions where trade_date not in (select trade_date from order_days)
    union all select trade_date, 'right' from order_days where trade_date not in (select trade_date from sessions)"""))
def universe_parity(spark, sf_dir):
    """D19, J3 keys on one side only."""
    a = views.sessions(spark, sf_dir).withColumnRenamed("trade_date", "day")
    return joins.parity(a, views.order_days(spark, sf_dir).withColumnRenamed("trade_date", "day"), "day")


@query(sql("order_days", "sessions", "select o.* exclude fx from order_days o where trade_date in (select trade_date from sessions)"))
def semi_filter(spark, sf_dir):
    """D14 rows whose day is in a set."""
    return views.order_days(spark, sf_dir).drop("fx").join(views.sessions(spark, sf_dir), "trade_date", "left_semi")


@query("""select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as returned,
    exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount > 0.05) as discounted,
    exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount > 0.05) as all_flags from orders""")
def flag_join(spark, sf_dir):
    """D10 membership flags."""
    li = views.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    sets = {"returned": li.where("l_returnflag = 'R'"), "discounted": li.where("l_discount > 0.05")}
    return quality.flag_join(views.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", sets)


@query(sql("day_bars", """, e as (select instrument, trade_date, close from day_bars where day(trade_date) = 1)
    select e.instrument, e.trade_date, e.close, min(b.trade_date) as touched_at from e left join day_bars b on b.instrument = e.instrument and b.trade_date > e.trade_date
    and b.trade_date <= e.trade_date + interval 60 day and b.high >= e.close * 1.2 group by all"""))
def first_touch(spark, sf_dir):
    """D15 first later bar that breaks a price."""
    d = views.day_bars(spark, sf_dir)
    e = d.where(F.dayofmonth("trade_date") == 1).select("instrument", "trade_date", "close")
    return joins.first_touch(e, d, ["instrument"], "trade_date", "trade_date", F.col("b.high") >= F.col("e.close") * 1.2, 60)


@query(sql("ticks", """, a as (select user_id, instrument, ts, price, time_bucket(interval '5 minutes', ts) + interval '5 minutes' as bucket from ticks where instrument = 'click'),
    b as (select user_id, time_bucket(interval '5 minutes', ts) + interval '5 minutes' as bucket, max(price) as other from ticks where instrument <> 'click' group by all)
    select a.user_id, bucket, a.ts, a.price, b.other from a left join b using (user_id, bucket)"""))
def join_on_bucket_end(spark, sf_dir):
    """D21 join on computed bucket ends."""
    t = views.ticks(spark, sf_dir)
    b = t.where("instrument <> 'click'").withColumn("e", bars.next_bucket("ts", "5 minutes")).groupBy("user_id", "e").agg(F.max("price").alias("other"))
    out = joins.bucketed_join(t.where("instrument = 'click'"), b, ["user_id"], bars.next_bucket("ts", "5 minutes"), F.col("e"))
    return out.select("user_id", "bucket", "ts", "price", "other")


@query(sql("day_bars", """select instrument, trade_date, lag(close) over w as prior_session_close,
    (select p.close from day_bars p where p.instrument = d.instrument and p.trade_date = d.trade_date - 1) as prior_day_close from day_bars d window w as (partition by instrument order by trade_date)"""))
def prev_day_join(spark, sf_dir):
    """D16 yesterday as the session before and as the calendar day before."""
    d = views.day_bars(spark, sf_dir)
    day = d.select("instrument", F.date_add("trade_date", 1).alias("trade_date"), F.col("close").alias("prior_day_close"))
    return d.withColumn("prior_session_close", F.lag("close").over(wn.over("instrument", "trade_date"))).join(day, ["instrument", "trade_date"], "left").select(
        "instrument", "trade_date", "prior_session_close", "prior_day_close"
    )


@query(sql("day_bars", "select instrument, lag(trade_date) over w as source_day, trade_date as outcome_day, cast(sign(lag(close - open) over w) as integer) as source_dir, round(close / open - 1, 6) as outcome from day_bars window w as (partition by instrument order by trade_date) qualify source_day is not null"))
def day_pairs(spark, sf_dir):
    """D20 features of a day with the outcome of the next."""
    w = wn.over("instrument", "trade_date")
    d = views.day_bars(spark, sf_dir).select(
        "instrument", F.lag("trade_date").over(w).alias("source_day"), F.col("trade_date").alias("outcome_day"),
        F.signum(F.lag(F.col("close") - F.col("open")).over(w)).cast("int").alias("source_dir"), (F.col("close") / F.col("open") - 1).alias("outcome"),
    )
    return rounded(d.where("source_day is not null"))


@query(sql("ticks", """, d as (select cast(ts as date) as day, avg(price) as day_mean from ticks group by all)
    select trade_id, round(price - day_mean, 6) as off_mean from ticks t join d on cast(t.ts as date) = d.day"""))
def attach_daily(spark, sf_dir):
    """D11 a day-level feature on every tick."""
    t = views.ticks(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return rounded(t.join(t.groupBy("day").agg(F.avg("price").alias("day_mean")), "day").select("trade_id", (F.col("price") - F.col("day_mean")).alias("off_mean")))


def _w(extra: str = "") -> str:
    return f"(partition by instrument order by trade_date {extra})"


@query(sql("day_bars", f"""select instrument, trade_date, round(close - lag(close) over {_w()}, 6) as diff, round(close / lag(close) over {_w()} - 1, 6) as pct, round(ln(close / lag(close) over {_w()}), 6) as log_ret,
    round(lead(close) over {_w()} / close - 1, 6) as next_1, round(lead(close, 2) over {_w()} / close - 1, 6) as next_2,
    coalesce(high <= lag(high) over {_w()} and low >= lag(low) over {_w()}, false) as inside from day_bars"""))
def returns(spark, sf_dir):
    """E1, E15, E22 returns back and ahead."""
    w = wn.over("instrument", "trade_date")
    return rounded(views.day_bars(spark, sf_dir).select(
        "instrument", "trade_date", wn.diff("close", w).alias("diff"), wn.pct_change("close", w).alias("pct"), wn.log_return("close", w).alias("log_ret"),
        wn.forward_return("close", "instrument", "trade_date").alias("next_1"), wn.forward_return("close", "instrument", "trade_date", 2).alias("next_2"),
        wn.inside_previous("instrument", "trade_date").alias("inside"),
    ))


_EMA = """n as (select instrument, bar_end, close, row_number() over (partition by instrument order by bar_end) as rn from bars_1h),
    ema(instrument, rn, bar_end, close, ema_fast, ema_slow) as (select instrument, rn, bar_end, close, close, close from n where rn = 1
        union all select n.instrument, n.rn, n.bar_end, n.close, {f} * n.close + (1 - {f}) * e.ema_fast, {s} * n.close + (1 - {s}) * e.ema_slow
        from ema e join n on n.instrument = e.instrument and n.rn = e.rn + 1)"""


def ema_sql(fast: int, slow: int) -> str:
    return _EMA.format(f=f"(2.0::double / {fast + 1})", s=f"(2.0::double / {slow + 1})")


@query(sql("bars_1h", f", {ema_sql(5, 12)} select instrument, bar_end, round(ema_fast, 6) as ema_fast, round(ema_slow, 6) as ema_slow from ema", recursive=True))
def ema_1h(spark, sf_dir):
    """E2 exponential averages by a blocked scan."""
    e = recurrence.with_ema(views.event_bars(spark, sf_dir), ["instrument"], ["bar_end"], "close", {"ema_fast": 5, "ema_slow": 12})
    return rounded(e.select("instrument", "bar_end", "ema_fast", "ema_slow"))


@query(sql("bars_1h", """, n as (select instrument, bar_end, close, row_number() over (partition by instrument order by bar_end) as rn from bars_1h),
    e(instrument, rn, bar_end, close, m, v, s) as (select instrument, rn, bar_end, close, close, 0::double, 1::double from n where rn = 1
        union all select n.instrument, n.rn, n.bar_end, n.close, e.m + (2.0::double / 13) * (n.close - e.m), (1 - 2.0::double / 13) * (e.v + (2.0::double / 13) * (n.close - e.m) * (n.close - e.m)), (1 - 2.0::double / 13) * (1 - 2.0::double / 13) * e.s + (2.0::double / 13) * (2.0::double / 13)
        from e join n on n.instrument = e.instrument and n.rn = e.rn + 1),
    k as (select *, case when rn >= 5 then m end as mean, case when rn >= 5 then sqrt(v / (1 - s)) end as std from e),
    z as (select *, case when std > 0 then (close - mean) / std end as z, case when count(*) over w >= 3 then avg(close) over w end as fm, case when count(*) over w >= 3 then stddev_pop(close) over w end as fs from k window w as (partition by instrument order by bar_end rows 19 preceding))
    select instrument, bar_end, round(close, 6) as close, round(case when z is null then fm else mean end, 6) as ew_mean, round(case when z is null then fs else std end, 5) as ew_std, round(coalesce(z, case when fs > 0 then (close - fm) / fs end), 5) as ew_z from z""", recursive=True))
def ew_zscore_1h(spark, sf_dir):
    """E3 exponentially weighted z-score, with a rolling one until there is enough history."""
    b = views.event_bars(spark, sf_dir).select("instrument", "bar_end", "close")
    out = recurrence.with_ew_stats(b, ["instrument"], ["bar_end"], "close", 12, 5, fallback=20)
    return out.select("instrument", "bar_end", F.round("close", 6).alias("close"), F.round("ew_mean", 6).alias("ew_mean"), F.round("ew_std", 5).alias("ew_std"), F.round("ew_z", 5).alias("ew_z"))


@query(sql("day_bars", f"""select instrument, trade_date, round(case when count(close) over {_w('rows 19 preceding')} >= 10 then avg(close) over {_w('rows 19 preceding')} end, 6) as mean_20,
    round(case when count(close) over {_w('rows 19 preceding')} >= 10 then stddev_samp(close) over {_w('rows 19 preceding')} end, 6) as std_20,
    round(case when count(close) over {_w('rows 19 preceding')} >= 20 then max(close) over {_w('rows 19 preceding')} end, 6) as max_20,
    round(case when count(close) over {_w('rows 19 preceding')} >= 20 then quantile_cont(close, 0.25) over {_w('rows 19 preceding')} end, 6) as q25_20,
    round(avg(close) over {_w('rows between 2 preceding and 2 following')}, 6) as centred_5 from day_bars"""))
def rolling_stats(spark, sf_dir):
    """E4, E21 rolling statistics."""
    k, o = "instrument", "trade_date"
    return rounded(views.day_bars(spark, sf_dir).select(
        k, o, wn.rolling(F.avg, "close", k, o, 20, 10).alias("mean_20"), wn.rolling(F.stddev_samp, "close", k, o, 20, 10).alias("std_20"),
        wn.rolling(F.max, "close", k, o, 20).alias("max_20"), wn.rolling(lambda c: F.percentile(c, F.lit(0.25)), "close", k, o, 20).alias("q25_20"),
        wn.centred_mean("close", k, o, 5).alias("centred_5"),
    ))


def _z(frame: str, n: int) -> str:
    return f"case when count(close) over {_w(frame)} >= {n} and stddev_pop(close) over {_w(frame)} > 0 then (close - avg(close) over {_w(frame)}) / stddev_pop(close) over {_w(frame)} end"


@query(sql("day_bars", f"select instrument, trade_date, round({_z('rows between 60 preceding and 1 preceding', 20)}, 6) as z_60, round({_z('rows unbounded preceding', 20)}, 6) as z_all from day_bars"))
def past_z_60(spark, sf_dir):
    """E5, E6 z-scores against the past and against all so far."""
    k, o = "instrument", "trade_date"
    m, s = (wn.expanding(f, "close", k, o, 20, include_current=True) for f in (F.avg, F.stddev_pop))
    return rounded(views.day_bars(spark, sf_dir).select(k, o, wn.zscore("close", k, o, 60, 20).alias("z_60"), F.when(s > 0, (F.col("close") - m) / s).alias("z_all")))


@query(sql("day_bars", f"select instrument, trade_date, round(case when count(close) over {_w('rows between unbounded preceding and 1 preceding')} >= 60 then quantile_cont(close, 0.8) over {_w('rows between unbounded preceding and 1 preceding')} end, 6) as q80 from day_bars"))
def expanding_q80(spark, sf_dir):
    """E7 expanding quantile of earlier rows."""
    d = views.day_bars(spark, sf_dir).select("instrument", "trade_date", "close")
    return rounded(wn.with_expanding_quantile(d, "q80", "close", 0.8, ["instrument"], "trade_date", 60).drop("close"))


@query(sql("day_bars", f""", t as (select *, greatest(high - low, abs(high - lag(close) over {_w()}), abs(low - lag(close) over {_w()})) as tr from day_bars)
    select instrument, trade_date, round(tr, 6) as tr, round(case when count(tr) over {_w('rows 13 preceding')} >= 5 then avg(tr) over {_w('rows 13 preceding')} end, 6) as atr from t"""))
def atr_14(spark, sf_dir):
    """E8 true range and its average."""
    return rounded(wn.with_atr(views.day_bars(spark, sf_dir), "instrument", "trade_date").select("instrument", "trade_date", "tr", "atr"))


@query(sql("day_bars", f""", p as (select instrument, trade_date, close - open as pnl from day_bars), e as (select *, sum(pnl) over {_w('rows unbounded preceding')} as equity from p)
    select instrument, trade_date, round(equity, 4) as equity, round(max(equity) over {_w('rows unbounded preceding')}, 4) as peak, round(equity - max(equity) over {_w('rows unbounded preceding')}, 4) as drawdown from e"""))
def drawdown(spark, sf_dir):
    """E9 equity and drawdown."""
    d = views.day_bars(spark, sf_dir).select("instrument", "trade_date", (F.col("close") - F.col("open")).alias("pnl"))
    return rounded(blocked.drawdown(d, "pnl", ["instrument"], ["trade_date"]).drop("pnl"), 4)


@query(sql("day_bars", f""", g as (select instrument, trade_date, close > open as good from day_bars), c as (select *, case when good = lag(good) over {_w()} then 0 else 1 end as c from g),
    r as (select *, sum(c) over {_w('rows unbounded preceding')} as run_id from c),
    p as (select instrument, trade_date, good, cast(run_id as bigint) as run_id, row_number() over (partition by instrument, run_id order by trade_date) as run_pos, count(*) over (partition by instrument, run_id) as run_len from r)
    select *, case when run_len = 1 then 'single' when run_pos = 1 then 'start' when run_pos = run_len then 'end' else 'mid' end as place from p"""))
def label_runs(spark, sf_dir):
    """E11 runs of good and bad days."""
    d = views.day_bars(spark, sf_dir).select("instrument", "trade_date", (F.col("close") > F.col("open")).alias("good"))
    return blocked.runs(d, "good", ["instrument"], ["trade_date"])


@query(sql("ticks", """, s as (select trade_id, instrument, ts, case when price > 60 then 1 when price < 5 then -1 else 0 end as x from ticks)
    select trade_id, coalesce(last_value(nullif(x, 0) ignore nulls) over (partition by instrument order by ts rows unbounded preceding), 0) as held from s"""))
def hold_last_nonzero(spark, sf_dir):
    """E10, F12 threshold signs held."""
    t = views.ticks(spark, sf_dir).withColumn("x", F.when(F.col("price") > 60, 1).when(F.col("price") < 5, -1).otherwise(0))
    return blocked.held(t, "held", "x", ["instrument"], ["ts"]).select("trade_id", "held")


@query(sql("day_bars", "order_days", """, a as (select trade_date, avg(close) as a from day_bars group by all), r as (select a.trade_date, a.a, o.fx as b, row_number() over (order by a.trade_date) as i from a join order_days o using (trade_date)),
    k as (select unnest(range(-12, 13)) as lag) select k.lag, count(*) as n, round(corr(x.a, y.b), 6) as corr,
    round(corr(x.a, y.b) * sqrt((count(*) - 2) / (1 - corr(x.a, y.b) * corr(x.a, y.b))), 5) as t_stat from k, r x join r y on y.i = x.i + k.lag group by k.lag"""))
def lead_lag_corr(spark, sf_dir):
    """E20 correlation of two daily feeds at lags."""
    a = views.day_bars(spark, sf_dir).groupBy("trade_date").agg(F.avg("close").alias("a"))
    both = a.join(views.order_days(spark, sf_dir).select("trade_date", F.col("fx").alias("b")), "trade_date")
    out = wn.lead_lag(both, "a", "b", "trade_date", range(-12, 13))
    return rounded(out.withColumn("t_stat", F.round("t_stat", 5)).withColumn("lag", F.col("lag").cast("long")))


@query(sql("sessions", """, m as (select unnest(generate_series(timestamp '1995-01-01', timestamp '2002-12-01', interval 1 month)) as m),
    x as (select cast(m + interval ((4 - isodow(m) + 7) % 7 + 14) day as date) as expiry from m where month(m) % 3 = 0)
    select trade_date, min(expiry) as expiry, cast(isodow(trade_date) - 1 as integer) as weekday, cast(isodow(trade_date) = 1 as integer) as is_monday, cast(isodow(trade_date) = 5 as integer) as is_friday,
    cast(min(expiry) - trade_date as integer) as days_to_expiry, cast(min(expiry) - trade_date between 0 and 4 as integer) as is_expiry_week from sessions join x on expiry >= trade_date group by trade_date"""))
def front_expiry(spark, sf_dir):
    """B9, B10 the front contract's expiry and calendar features."""
    return scalar.front_expiry(views.sessions(spark, sf_dir), "trade_date")


@query(sql("day_bars", """, c as (select instrument, trade_date, close, lag(close) over (partition by instrument order by trade_date) as prior, avg(close) over (partition by instrument) as m from day_bars)
    select instrument, trade_date, case when close > m and prior <= m then 'up' when close < m and prior >= m then 'down' end as cross from c"""))
def cross_detect(spark, sf_dir):
    """E19 crossings of two series."""
    from pyspark.sql import Window as W

    d = views.day_bars(spark, sf_dir).withColumn("m", F.avg("close").over(W.partitionBy("instrument")))
    return d.select("instrument", "trade_date", wn.crossed("close", "m", "instrument", "trade_date").alias("cross"))


@query("""select p_partkey, substr(sha256(concat_ws('|', p_partkey, coalesce(p_name, 'None'), case when p_size > 25 then p_type else 'None' end)), 1, 24) as id,
    p_brand as brand, p_size > 25 as big from part""")
def stable_ids(spark, sf_dir):
    """B7 stable identifiers."""
    p = views.table(spark, sf_dir, "part")
    return p.select("p_partkey", scalar.stable_id("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_type"))).alias("id"), F.col("p_brand").alias("brand"), (F.col("p_size") > 25).alias("big"))


@query("""with m as (select c_custkey, case when c_nationkey % 5 = 0 then ' NaN ' when c_nationkey % 5 = 1 then '  ' || c_name || ' ' else c_mktsegment end as raw,
        case when c_custkey % 3 = 0 then '1970-01-01' when c_custkey % 3 = 1 then '2024-02-30' else '2024-05-17T10:00' end as d, case when c_custkey % 2 = 0 then ' Yes' else 'off' end as b from customer)
    select c_custkey, case when lower(trim(raw)) not in ('', 'nan', 'nat', 'none', 'null') then trim(raw) end as text, case when year(try_cast(substr(d, 1, 10) as date)) between 2000 and 2200 then try_cast(substr(d, 1, 10) as date) end as date,
    case when year(try_cast(substr(d, 1, 10) as date)) not between 2000 and 2200 then try_cast(substr(d, 1, 10) as date) end as sentinel, lower(trim(b)) in ('1', 'true', 't', 'yes', 'y') as flag from m""")
def cleaned(spark, sf_dir):
    """B4, B5 cleaned texts, dates and flags."""
    m = views.table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("case when c_nationkey % 5 = 0 then ' NaN ' when c_nationkey % 5 = 1 then '  ' || c_name || ' ' else c_mktsegment end").alias("raw"),
        F.expr("case when c_custkey % 3 = 0 then '1970-01-01' when c_custkey % 3 = 1 then '2024-02-30' else '2024-05-17T10:00' end").alias("d"),
        F.expr("case when c_custkey % 2 = 0 then ' Yes' else 'off' end").alias("b"),
    )
    return m.select("c_custkey", scalar.clean_text("raw").alias("text"), scalar.source_date("d").alias("x"), scalar.to_bool("b").alias("flag")).select(
        "c_custkey", "text", "x.date", "x.sentinel", "flag"
    )


@query("""with m as (select c_custkey, case when c_custkey % 4 = 0 then c_name || 'F' when c_custkey % 4 = 1 then 'Si' || chr(cast(70 + c_nationkey % 2 as integer)) || (c_custkey % 100) else 'BR' || 'H' || c_nationkey % 10 end as code from customer)
    select c_custkey, code, case when regexp_matches(code, '^([A-Za-z]+)([FGHJKMNQUVXZ])(\\d{1,2})$') then regexp_extract(code, '^([A-Za-z]+)([FGHJKMNQUVXZ])(\\d{1,2})$', 1) else code end as family,
    case when regexp_matches(code, '^([A-Za-z]+)([FGHJKMNQUVXZ])(\\d{1,2})$') then regexp_extract(code, '^([A-Za-z]+)([FGHJKMNQUVXZ])(\\d{1,2})$', 2) end as month_code, regexp_matches(lower(code), '(f|perp)$') as perpetual from m""")
def contract_codes(spark, sf_dir):
    """B8 parts of a contract's code."""
    m = views.table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("case when c_custkey % 4 = 0 then c_name || 'F' when c_custkey % 4 = 1 then 'Si' || chr(70 + c_nationkey % 2) || (c_custkey % 100) else 'BR' || 'H' || c_nationkey % 10 end").alias("code")
    )
    return m.withColumn("p", scalar.contract_code("code")).select("c_custkey", "code", "p.family", "p.month_code", "p.perpetual")


@query(sql("ticks", """select trade_id, try_cast(case when trade_id % 3 = 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') else strftime(ts, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M:%S') end as timestamp) as ts from ticks"""))
def combined_ts(spark, sf_dir):
    """B3 times with and without a date."""
    t = views.ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    full, short = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.date_format("ts", "HH:mm:ss")
    t = t.select("trade_id", F.date_format("ts", "yyyy-MM-dd").alias("d"), F.when(F.col("trade_id") % 3 == 0, full).otherwise(short).alias("t"))
    return t.select("trade_id", scalar.combine_ts("d", "t").cast("timestamp_ntz").alias("ts"))


@query("""select o_orderkey, round(1 / (1 + exp(-(-1.0 + 0.00001 * o_totalprice))), 6) as p, case when 1 / (1 + exp(-(-1.0 + 0.00001 * o_totalprice))) < 0.4 then 'adverse'
    when 1 / (1 + exp(-(-1.0 + 0.00001 * o_totalprice))) > 0.7 then 'favorable' else 'neutral' end as band from orders""")
def logistic_bands(spark, sf_dir):
    """B17 logistic score and bands."""
    p = scalar.logistic(-1.0, {"o_totalprice": 0.00001})
    return rounded(views.table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p"), scalar.band(p, 0.4, 0.7).alias("band")))


@query("""select l_orderkey, l_linenumber, round(l_discount / nullif(l_quantity, 0), 6) as rel_l1, round(coalesce(l_tax, 0) + coalesce(l_discount, 0), 6) as depth_bid,
    case when isfinite(l_discount / nullif(l_quantity, 0)) then cast(l_discount / l_quantity > 0.002 as integer) end as wide from lineitem""")
def book_features(spark, sf_dir):
    """B11, B12 relative spreads, depths and the liquidity flag."""
    f = scalar.book_features("l_quantity", {"l1": "l_discount"}, {"bid": ["l_tax", "l_discount"]})
    li = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in f.items()))
    return rounded(li.withColumn("wide", scalar.liquidity_flag("rel_l1", 0.002)))


@query("""select p_partkey, list_filter(list_transform(string_split(case when p_size % 2 = 0 then p_type else p_name end, ' '), lambda x: trim(x)), lambda x: x <> '') as words from part""")
def string_lists(spark, sf_dir):
    """B15 lists from JSON and from text."""
    p = views.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.to_json(F.split("p_type", " "))).otherwise(F.regexp_replace("p_name", " ", ",")).alias("t"))
    return p.select("p_partkey", scalar.string_list("t").alias("words"))


@query("""with a as (select n_nationkey as k, n_name as name, null as acct from nation union all select c_nationkey, c_name, c_acctbal from customer) select k, name, acct from a""")
def union_columns(spark, sf_dir):
    """J1 union of tables with different columns."""
    n = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    c = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acct"))
    return n.unionByName(c, allowMissingColumns=True)


@query("""select n_nationkey as r_regionkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as payload from nation""")
def row_payload(spark, sf_dir):
    """B16 rows as JSON."""
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("r_regionkey"), scalar.payload_json(["n_name", "n_regionkey"]).alias("payload"))


@query("""select c_name as instrument, c_acctbal as open, c_acctbal + 1 as high, c_acctbal - 1 as low, c_acctbal as close from customer""")
def resolved_columns(spark, sf_dir):
    """A3 columns found under other names."""
    c = views.table(spark, sf_dir, "customer").select("c_name", F.col("c_acctbal").alias("PR_OPEN"), (F.col("c_acctbal") + 1).alias("H"), (F.col("c_acctbal") - 1).alias("pr_low"), F.col("c_acctbal").alias("Close"))
    return lake.resolve(c, {"instrument": ["c_name"], **lake.BAR_NAMES})
