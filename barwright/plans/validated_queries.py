"""Queries over the validated read path: one series, three routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.operators import validated, windows as wn
from barwright.plans.registry import query, rounded
from barwright.sources import views
from barwright.sources.views import sql

#: Sessions of a day in minutes: first bar's end, last bar's end; each begins five minutes before its first bar's end.
_SESSIONS = {"s1": (605, 840), "s2": (850, 1125)}


def _dense(spark, sf_dir):
    """Five-minute bars of each instrument in the sessions of its whole days, prices carried forward."""
    g = wn.regular_grid(views.ticks(spark, sf_dir), "instrument", "ts", "5 minutes", ["price"]).withColumn("day", F.to_date("grid"))
    minute = F.hour("grid") * 60 + F.minute("grid")
    within = F.lit(False)
    for a, b in _SESSIONS.values():
        within = within | minute.between(a, b)
    first = g.groupBy(F.col("instrument").alias("_of")).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    g = g.join(first, F.col("instrument") == F.col("_of")).where((F.col("day") > F.col("_a")) & (F.col("day") < F.col("_b"))).where(within)
    text = {c: F.lit(c) for c in ("roll_policy_id", "adjustment_policy_id", "roll_map_id")}
    return g.select(
        F.col("day").alias("trade_date"), F.col("day").alias("session_date"), F.col("grid").alias("end"), F.col("instrument").alias("continuous_symbol"),
        F.col("instrument").alias("family_code"), F.concat_ws("-", "instrument", F.date_format("day", "yyyyMM")).alias("source_secid"), F.date_format("day", "yyyyMM").alias("source_contract"),
        *(F.col("price").alias(c) for c in ("open", "high", "low", "close")), F.lit(1).cast("long").alias("volume"), *(v.alias(c) for c, v in text.items()),
        F.lit(1.0).alias("adjustment_factor"), ((F.dayofmonth("day") == 1) & (minute == 605)).alias("is_roll_boundary"), F.lit("continuous_5m.v1").alias("schema_version"),
    )


def _calendar(spark, sf_dir):
    days = views.ticks(spark, sf_dir).select(F.to_date("ts").alias("session_date")).distinct()
    at = lambda m: F.col("session_date").cast("timestamp_ntz") + F.expr(f"interval {m} minutes")
    sessions = F.array(*(
        F.struct(F.lit(n).alias("session_interval_id"), at(a - 5).alias("session_start"), at(b).alias("session_end"), at(a).alias("expected_first_bar_end"), at(b).alias("expected_last_bar_end"), F.lit((b - a) // 5 + 1).alias("expected_bar_count"))
        for n, (a, b) in _SESSIONS.items()
    ))
    return days.select("session_date", F.explode(sessions).alias("s"), F.lit(True).alias("is_trading_day")).select("session_date", "s.*", "is_trading_day")


def _route(spark, sf_dir, timeframe):
    out = validated.read_validated(_dense(spark, sf_dir), _calendar(spark, sf_dir), timeframe)
    return rounded(out.select("continuous_symbol", "session_date", "bucket_end", "source_secid", "open", "high", "low", "close", "volume", "contains_roll_boundary", "source_bar_count", "first_source_end", "last_source_end"))


_DENSE = """, b as (select instrument, time_bucket(interval '5 minutes', ts - interval '1 microsecond') + interval '5 minutes' as grid, arg_max(price, ts) as price from ticks group by all),
    g as (select instrument, unnest(generate_series(min(grid), max(grid), interval '5 minutes')) as grid from b group by instrument),
    f as (select g.instrument, g.grid, last_value(price ignore nulls) over (partition by g.instrument order by g.grid rows unbounded preceding) as price, min(cast(g.grid as date)) over (partition by g.instrument) as a, max(cast(g.grid as date)) over (partition by g.instrument) as z from g left join b using (instrument, grid)),
    d as (select instrument, cast(grid as date) as day, grid, price, hour(grid) * 60 + minute(grid) as m from f where cast(grid as date) > a and cast(grid as date) < z),
    s as (select *, case when m between 605 and 840 then 600 else 845 end as open_m, case when m between 605 and 840 then 840 else 1125 end as close_m from d where m between 605 and 840 or m between 850 and 1125)"""


def _sql(bucket: str) -> str:
    return sql("ticks", f"""{_DENSE}, q as (select *, {bucket} as bucket_end from s)
    select instrument as continuous_symbol, day as session_date, bucket_end, instrument || '-' || strftime(day, '%Y%m') as source_secid, round(arg_min(price, grid), 6) as open, round(max(price), 6) as high, round(min(price), 6) as low, round(arg_max(price, grid), 6) as close,
    count(*) as volume, bool_or(day(day) = 1 and m = 605) as contains_roll_boundary, count(*) as source_bar_count, min(grid) as first_source_end, max(grid) as last_source_end from q group by instrument, day, bucket_end""")


def _minutes(n: int) -> str:
    return f"cast(day as timestamp) + least(open_m + greatest(ceil((m - open_m) / {n}.0), 1) * {n}, close_m) * interval '1 minute'"


@query(_sql("grid"))
def validated_5m(spark, sf_dir):
    """H17 five-minute bars that passed all checks."""
    return _route(spark, sf_dir, "5m")


@query(_sql(_minutes(60)))
def validated_1h(spark, sf_dir):
    """H17, H18, C3 hourly bars anchored at sessions, from validated five-minute bars."""
    return _route(spark, sf_dir, "1h")


@query(_sql("cast(day as timestamp) + 1125 * interval '1 minute'"))
def validated_d1(spark, sf_dir):
    """H17, C4 daily bars from validated five-minute bars."""
    return _route(spark, sf_dir, "D1")
