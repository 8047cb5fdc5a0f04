"""Queries over bars: resampling, buckets, book tops, day features, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.functions import scalar
from barwright.operators import bars, daily, signals, windows as wn
from barwright.plans.registry import query, rounded
from barwright.sources import lake, views
from barwright.sources.views import sql


def _bars_sql(interval: str) -> str:
    return f"""select instrument, time_bucket(interval '{interval}', ts - interval '1 microsecond') + interval '{interval}' as bar_end,
        round(arg_min(price, ts), 6) as open, round(max(price), 6) as high, round(min(price), 6) as low, round(arg_max(price, ts), 6) as close,
        count(*) as volume, round(sum(turnover), 6) as turnover from ticks group by all"""


@query(sql("ticks", _bars_sql("15 minutes")))
def bars_15m(spark, sf_dir):
    """C2 ticks to bars."""
    return rounded(bars.ticks_to_bars(views.ticks(spark, sf_dir), "15 minutes"))


@query(sql("ticks", _bars_sql("1 hour")))
def bars_1h(spark, sf_dir):
    return rounded(views.event_bars(spark, sf_dir))


@query(sql("bars_1h", """select instrument, time_bucket(interval '4 hours', bar_end - interval '1 microsecond') + interval '4 hours' as bar_end,
    arg_min(open, bar_end) as open, max(high) as high, min(low) as low, arg_max(close, bar_end) as close,
    cast(sum(volume) as bigint) as volume, count(*) as source_bars from bars_1h group by all"""))
def resample_4h(spark, sf_dir):
    """C1 coarser bars from finer ones."""
    return bars.resample(views.event_bars(spark, sf_dir), "4h")


_INTERVALS = """select date, date + interval '10 hours' as session_start, date + interval '14 hours' as session_end, 1 as part
    from (select distinct date_trunc('day', ts) as date from ticks) union all
    select date, date + interval '14 hours 5 minutes', date + interval '18 hours 45 minutes', 2 from (select distinct date_trunc('day', ts) as date from ticks)"""


def _intervals(ticks):
    day = ticks.select(F.date_trunc("day", "ts").alias("date")).distinct()
    part = lambda a, b, n: F.struct(
        (F.col("date") + F.expr(f"interval {a} minutes")).alias("session_start"), (F.col("date") + F.expr(f"interval {b} minutes")).alias("session_end"), F.lit(n).alias("part")
    )
    return day.select("date", F.explode(F.array(part(600, 840, 1), part(845, 1125, 2))).alias("s")).select("date", "s.*")


@query(sql("ticks", """, m as (select instrument, date_trunc('minute', ts) as ts, price, trade_id from ticks),
    j as (select m.*, i.part, i.session_start, i.session_end from m join intervals i on date_trunc('day', m.ts) = i.date
        and m.ts > i.session_start and m.ts <= i.session_end),
    b as (select *, least(session_start + greatest(ceil(epoch(ts - session_start) / 3600), 1) * interval '1 hour', session_end) as bucket_end from j)
    select instrument, part, cast(bucket_end as timestamp) as bucket_end, arg_min(price, trade_id) as open, max(price) as high, min(price) as low,
        arg_max(price, trade_id) as close, count(*) as source_bar_count from b group by all""", intervals=_INTERVALS))
def session_bars_1h(spark, sf_dir):
    """C3, D6 session-anchored buckets, clipped at the session's end."""
    ticks = views.ticks(spark, sf_dir).withColumn("ts", F.date_trunc("minute", "ts"))
    s = F.broadcast(_intervals(views.ticks(spark, sf_dir)))  # two rows per calendar day
    j = ticks.join(s, (F.date_trunc("day", ticks["ts"]) == s["date"]) & (F.col("ts") > F.col("session_start")) & (F.col("ts") <= F.col("session_end")))
    end = bars.session_bucket(F.col("ts"), F.col("session_start"), F.col("session_end"), 60)
    return j.groupBy("instrument", "part", end.alias("bucket_end")).agg(
        F.min_by("price", "trade_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "trade_id").alias("close"), F.count(F.lit(1)).alias("source_bar_count"),
    )


@query(sql("trades", """select instrument, trade_date, arg_min(price, seq) as open, max(price) as high, min(price) as low,
    arg_max(price, seq) as close, sum(qty) as volume, count(*) as n from trades group by all"""))
def day_bars(spark, sf_dir):
    """C5 daily bars."""
    return views.day_bars(spark, sf_dir)


@query(sql("trades", "contracts", """, j as (select t.*, c.secid, month(t.trade_date) % 3 = 0 and day(t.trade_date) > 25 as near_roll
    from trades t join contracts c on c.family = t.instrument and date_trunc('quarter', c.anchor) = date_trunc('quarter', t.trade_date))
    select instrument, date_trunc('month', trade_date)::date as month, arg_min(price, (trade_date, seq)) as open, max(price) as high, min(price) as low,
    arg_max(price, (trade_date, seq)) as close, sum(qty) as volume, count(*) as bar_count, string_agg(distinct secid, ',') as source_contracts,
    bool_or(near_roll) as has_roll_boundary from j group by all"""))
def continuous_months(spark, sf_dir):
    """C4 stitched bars with the contracts they came from."""
    t = views.trades(spark, sf_dir)
    quarter = F.date_trunc("quarter", "trade_date").cast("date")
    secid = F.concat_ws("_", "instrument", F.year(quarter).cast("string"), F.quarter(quarter).cast("string"))
    df = t.select(
        "instrument", F.trunc("trade_date", "month").alias("month"), secid.alias("secid"), F.struct("trade_date", "seq").alias("at"),
        F.col("price").alias("open"), F.col("price").alias("high"), F.col("price").alias("low"), F.col("price").alias("close"), F.col("qty").alias("volume"),
        ((F.month("trade_date") % 3 == 0) & (F.dayofmonth("trade_date") > 25)).alias("near_roll"),
    )
    out = bars.continuous_days(df, ["instrument", "month"], "at", "secid", "near_roll")
    return out.withColumn("source_contracts", F.concat_ws(",", "source_contracts"))


@query(sql("ticks", """select user_id % 2 as side, time_bucket(interval '5 minutes', ts) as bucket,
    arg_max(price, ts) filter (price > 20) as price, arg_max(trade_id, ts) as trade_id from ticks group by all"""))
def bucket_last(spark, sf_dir):
    """C6 last non-null value per column and bucket."""
    t = views.ticks(spark, sf_dir).withColumn("side", F.col("user_id") % 2).withColumn("price", F.when(F.col("price") > 20, F.col("price")))
    return bars.last_in_bucket(t, "5 minutes", ["price", "trade_id"], ["side"])


@query(sql("ticks", """select instrument, time_bucket(interval '5 minutes', ts) as bucket, round(avg(price), 6) as price_mean,
    arg_max(price, ts) as price_last from ticks group by all"""))
def bars_left_5m_mean(spark, sf_dir):
    """C7 left-labelled means."""
    return rounded(bars.mean_in_bucket(views.ticks(spark, sf_dir), "5 minutes", ["price"], ["price"], ["instrument"]))


@query("""with l as (select l_orderkey, case when l_returnflag = 'R' then 'S' else 'B' end as side, l_extendedprice as price, l_quantity as size from lineitem),
    r as (select *, row_number() over (partition by l_orderkey, side order by case when side = 'B' then -price else price end, size desc) as k from l),
    g as (select l_orderkey, max(price) filter (side = 'B') as best_bid, min(price) filter (side = 'S') as best_ask,
        sum(size) filter (side = 'B') as bid_depth, sum(size) filter (side = 'S') as ask_depth from r where k <= 3 group by all)
    select *, round(best_ask - best_bid, 6) as spread, round((best_ask + best_bid) / 2, 6) as mid,
        round((best_ask - best_bid) / ((best_ask + best_bid) / 2), 6) as rel_spread from g""")
def book_top(spark, sf_dir):
    """C26 top of the book per snapshot."""
    li = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_returnflag") == "R", "S").otherwise("B").alias("side"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("size")
    )
    return rounded(bars.book_top(li, ["l_orderkey"], "side", "price", "size", 3))


@query(sql("bars_1h", """, b as (select *, cast(bar_end - interval '1 microsecond' as date) as day from bars_1h),
    r as (select *, ln(close / lag(close) over w) as r, sign(close - lag(close) over w) as d, lag(close) over w as pc, lead(close) over w as nc,
        row_number() over w as i, count(*) over (partition by instrument, day) as n from b window w as (partition by instrument, day order by bar_end)),
    s as (select *, lag(r) over w as p, last_value(nullif(d, 0) ignore nulls) over (partition by instrument, day order by bar_end rows unbounded preceding) as s,
        case when (close > pc and close > nc) or (close < pc and close < nc) then 1 else 0 end as x from r window w as (partition by instrument, day order by bar_end)),
    f as (select *, case when s <> lag(s) over (partition by instrument, day order by bar_end) then 1 when s is not null and lag(s) over (partition by instrument, day order by bar_end) is not null then 0 end as f from s),
    g as (select instrument, day, arg_min(open, bar_end) as open, max(high) as high, min(low) as low, arg_max(close, bar_end) as close, count(*) as bars,
        cast(coalesce(sum(f), 0) as bigint) as sign_flips, case when count(r) >= 3 then stddev_samp(r) end as ret_std,
        case when count(r) filter (p is not null) >= 3 then corr(r, p) end as acf1, cast(sum(x) as bigint) as local_extrema,
        arg_max(close, i) filter (i <= ceil(n / 2)) as half from f group by all)
    select instrument, day, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, bars, sign_flips,
        round(ret_std, 6) as ret_std, round(acf1, 6) as acf1, local_extrema, round(high - low, 6) as range, round((high - low) / nullif(open, 0), 6) as rel_range,
        round(abs(close - open) / nullif(high - low, 0), 6) as trend_ratio, round((half - open) / nullif(close - open, 0), 6) as first_half_share from g"""))
def day_metrics(spark, sf_dir):
    """C8, C9, E1, E16 features of a day's bars."""
    b = views.event_bars(spark, sf_dir).withColumn("day", signals.session_day("bar_end"))
    return rounded(daily.intraday_features(b, "instrument", "day", "bar_end"))


@query(sql("trades", """select instrument, trade_date, round(avg(price), 6) as price_mean, round(quantile_cont(price, 0.9), 6) as price_p90,
    round(quantile_cont(qty, 0.1), 6) as qty_p10, arg_min(qty, seq) as qty_open, arg_max(qty, seq) as qty_close,
    arg_max(qty, seq) - arg_min(qty, seq) as qty_change, round((arg_max(qty, seq) - arg_min(qty, seq)) / arg_min(qty, seq), 6) as qty_rel from trades group by all"""))
def micro_day_features(spark, sf_dir):
    """C10 open, close, change and quantiles per day."""
    g = views.trades(spark, sf_dir).groupBy("instrument", "trade_date").agg(
        F.avg("price").alias("price_mean"), F.percentile("price", F.lit(0.9)).alias("price_p90"), F.percentile("qty", F.lit(0.1)).alias("qty_p10"),
        F.min_by("qty", "seq").alias("qty_open"), F.max_by("qty", "seq").alias("qty_close"),
    )
    change = F.col("qty_close") - F.col("qty_open")
    return rounded(g.withColumn("qty_change", change).withColumn("qty_rel", F.try_divide(change, "qty_open")))


@query(sql("ticks", """select instrument, cast(ts as date) as day, round(arg_min(price - user_id, ts), 6) as net_open, round(arg_max(price - user_id, ts), 6) as net_close,
    round(arg_max(price - user_id, ts) - arg_min(price - user_id, ts), 6) as net_change,
    round(arg_max(price - user_id, ts) / nullif(arg_max(price + user_id, ts), 0), 6) as imbalance from ticks group by all"""))
def net_position_day(spark, sf_dir):
    """C11 net position of a group per day."""
    t = views.ticks(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return rounded(daily.net_position(t, "instrument", "day", "ts", F.col("price"), F.col("user_id").cast("double")))


@query(sql("trades", """, d as (select instrument, trade_date, sum(qty) as volume, sum(price) as value, count(*) as n from trades group by all)
    select instrument, cast(sum(case when volume > 0 then 1 else 0 end) as bigint) as active_days, cast(sum(case when volume <= 0 then 1 else 0 end) as bigint) as zero_days,
    round(median(volume), 6) as median_volume, round(median(value), 6) as median_value, round(median(n), 6) as median_trades from d group by all"""))
def daily_activity(spark, sf_dir):
    """C12 activity per instrument."""
    return rounded(daily.activity(views.trades(spark, sf_dir), "instrument", "trade_date", "qty", "price"))


@query(sql("ticks", """, p as (select time_bucket(interval '1 hour', ts) as bucket, arg_max(price, ts) filter (user_id % 2 = 0) as FIZ, arg_max(price, ts) filter (user_id % 2 = 1) as YUR from ticks group by all)
    select *, round(coalesce(abs(FIZ), 0) + coalesce(abs(YUR), 0), 6) as total from p"""))
def pivot_groups(spark, sf_dir):
    """C13 client groups from long to wide."""
    t = views.ticks(spark, sf_dir).withColumn("clgroup", F.when(F.col("user_id") % 2 == 0, "FIZ").otherwise("YUR")).withColumn("bucket", F.window("ts", "1 hour")["start"])
    return rounded(daily.pivot_last(t, ["bucket"], "clgroup", ["FIZ", "YUR"], "price", F.col("ts")))


@query(sql("ticks", "select instrument, cast(ts as date) as day, arg_max(price, ts) as price, max(ts) as ts, arg_max(trade_id, ts) as trade_id from ticks group by all"))
def eod_last(spark, sf_dir):
    """C14 the last record per group and day."""
    t = views.ticks(spark, sf_dir).select("instrument", F.to_date("ts").alias("day"), "price", "ts", "trade_id")
    return daily.last_per(t, ["instrument", "day"], ["ts", "trade_id"])


@query(sql("ticks", """select day, user_id, n from (select *, row_number() over (partition by day order by n desc, user_id) as r
    from (select cast(ts as date) as day, user_id, count(*) as n from ticks group by all)) where r = 1"""))
def daily_mode(spark, sf_dir):
    """C15 the most frequent value per day."""
    return daily.daily_mode(views.ticks(spark, sf_dir).withColumn("day", F.to_date("ts")), ["day"], "user_id")


@query(sql("trades", """, s as (select instrument, trade_date, count(*) as bar_count, arg_min(price, seq) as open, max(price) as high, min(price) as low, arg_max(price, seq) as close
    from trades group by all) select *, cast(row_number() over (partition by instrument order by trade_date) as integer) as session_index, cast(isodow(trade_date) - 1 as integer) as weekday,
    isodow(trade_date) = 6 as is_saturday from s"""))
def session_table(spark, sf_dir):
    """C21 sessions numbered per instrument."""
    return daily.session_table(views.trades(spark, sf_dir), "instrument", "trade_date", "seq")


@query("select l_returnflag as family, l_linestatus as status, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def status_counts(spark, sf_dir):
    """C22 counts by status, with totals."""
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("status"))
    return daily.status_counts(li, "family", "status")


_DAY_PNL = "pnl as (select instrument, trade_date, close - open as pnl_day from day_bars)"


@query(sql("day_bars", f""", {_DAY_PNL} select instrument, cast(date_trunc('year', trade_date) as date) as period, count(distinct trade_date) as days, round(sum(pnl_day), 6) as net,
    round(avg(pnl_day), 6) as mean, round(avg(case when pnl_day > 0 then 1.0 else 0 end), 6) as win_rate, sum(pnl_day) > 0 as profitable from pnl group by all"""))
def period_report_year(spark, sf_dir):
    """C18 results by calendar year."""
    d = views.day_bars(spark, sf_dir).withColumn("pnl_day", F.col("close") - F.col("open"))
    return rounded(daily.period_report(d, ["instrument"], "trade_date", "year"))


@query(sql("day_bars", f""", {_DAY_PNL}, e as (select *, sum(pnl_day) over (partition by instrument order by trade_date rows unbounded preceding) as equity from pnl),
    p as (select *, max(equity) over (partition by instrument order by trade_date rows unbounded preceding) as peak from e)
    select instrument, count(*) as n, case when count(*) filter (pnl_day < 0) = 0 then 'infinity'::double else round(sum(case when pnl_day > 0 then pnl_day else 0 end) / sum(case when pnl_day < 0 then -pnl_day else 0 end), 6) end as profit_factor,
    round(avg(case when pnl_day > 0 then 1.0 else 0 end), 6) as win_rate, round(min(equity - peak), 4) as max_drawdown from p group by all"""))
def trade_stats(spark, sf_dir):
    """C19, E9 profit factor and drawdown."""
    d = views.day_bars(spark, sf_dir).withColumn("pnl_day", F.col("close") - F.col("open"))
    out = daily.trade_stats(d, ["instrument"], "trade_date")
    return rounded(out.withColumn("max_drawdown", F.round("max_drawdown", 4)))


@query(sql("day_bars", """, k as (select *, count(*) over (partition by instrument) as c, row_number() over (partition by instrument order by trade_date) - 1 as i,
        min(close) over (partition by instrument) as lo, max(close) over (partition by instrument) as hi from day_bars)
    select instrument, cast(least(floor((close - lo) * 20 / nullif(hi - lo, 0)), 19) as integer) as bin, round(sum(exp(-3.0 + 3.0 * i / nullif(c - 1, 0))), 6) as weight, count(*) as n,
    round(min(lo), 6) as low, round(min(hi), 6) as high from k group by all"""))
def weighted_histogram(spark, sf_dir):
    """C24 recency-weighted histogram."""
    return rounded(daily.weighted_histogram(views.day_bars(spark, sf_dir), "instrument", "trade_date", "close", 20))


@query(sql("day_bars", """select instrument, trade_date, round(high - low, 6) as bar_range, round(abs(close - open), 6) as body, round((close - low) / nullif(high - low, 0), 6) as close_pos,
    round(abs(close - open) / nullif(high - low, 0), 6) as body_ratio, round((high - greatest(open, close)) / nullif(high - low, 0), 6) as upper_wick,
    round((least(open, close) - low) / nullif(high - low, 0), 6) as lower_wick, cast(sign(close - open) as integer) as direction, round((high - low) / nullif(open, 0), 6) as rel_range from day_bars"""))
def bar_shape(spark, sf_dir):
    """B13 shape of a bar."""
    return rounded(views.day_bars(spark, sf_dir).select("instrument", "trade_date", *(c.alias(n) for n, c in scalar.bar_shape().items())))


@query(sql("ticks", """, b as (select time_bucket(interval '5 minutes', ts - interval '1 microsecond') + interval '5 minutes' as at_or_after, time_bucket(interval '5 minutes', ts) + interval '5 minutes' as after, trade_id from ticks)
    select at_or_after, after, count(*) as n from b group by all"""))
def ceil_buckets(spark, sf_dir):
    """B14 next bucket boundaries."""
    t = views.ticks(spark, sf_dir)
    return t.groupBy(bars.ceil_bucket("ts", "5 minutes").alias("at_or_after"), bars.next_bucket("ts", "5 minutes").alias("after")).agg(F.count(F.lit(1)).alias("n"))


@query(sql("bars_1h", """select instrument, time_bucket(interval '1 day', bar_end - interval '1 microsecond') + interval '1 day' as bar_end, arg_min(open, bar_end) as open, max(high) as high,
    min(low) as low, arg_max(close, bar_end) as close from bars_1h where bar_end >= timestamp '2024-01-05' and bar_end < timestamp '2024-01-13' group by all"""))
def load_bars_d1(spark, sf_dir):
    """H17, B18, A1 the read interface at D1 over a date range."""
    return lake.load_bars(views.event_bars(spark, sf_dir), "D1", "2024-01-05", "2024-01-12", ["instrument", "bar_end", "open", "high", "low", "close"])


@query(sql("bars_1h", """, g as (select instrument, unnest(generate_series(min(bar_end), max(bar_end), interval '1 hour')) as grid from bars_1h group by instrument)
    select g.instrument, g.grid, last_value(close ignore nulls) over (partition by g.instrument order by g.grid rows unbounded preceding) as price
    from g left join bars_1h b on b.instrument = g.instrument and b.bar_end = g.grid"""))
def regular_grid(spark, sf_dir):
    """E17, E10 a uniform grid, carried forward."""
    return wn.regular_grid(views.ticks(spark, sf_dir), "instrument", "ts", "1 hour", ["price"])
