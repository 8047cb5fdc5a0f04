"""Queries over quality reports, mappings, screens and refreshes of the lake."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.operators import joins, quality, windows as wn
from barwright.plans.registry import query, rounded
from barwright.sources import lake, views
from barwright.sources.views import sql

_DEFECTS = """bad as (select instrument, trade_date, case when day(trade_date) = 13 then null else open end as open, case when month(trade_date) = 7 and day(trade_date) = 7 then low - 1 else high end as high, low, close, volume from day_bars
    union all select instrument, trade_date, open, high, low, close, volume from day_bars where day(trade_date) = 1
    union all select instrument, trade_date, open, high, low, close + 1, volume from day_bars where day(trade_date) = 2)"""


def _defects(spark, sf_dir):
    d = views.day_bars(spark, sf_dir).drop("n")
    day = F.dayofmonth("trade_date")
    bad = d.withColumn("open", F.when(day != 13, F.col("open"))).withColumn("high", F.when((F.month("trade_date") == 7) & (day == 7), F.col("low") - 1).otherwise(F.col("high")))
    return bad.unionByName(d.where(day == 1)).unionByName(d.where(day == 2).withColumn("close", F.col("close") + 1))


_INVALID = "(open is null or high is null or low is null or close is null or high < greatest(open, close, low) or low > least(open, close, high) or low <= 0)"


@query(sql("day_bars", f", {_DEFECTS} select instrument, count(*) as bars, count(*) filter {_INVALID.replace('(', '(where ', 1)} as invalid from bad group by all"))
def ohlc_quality(spark, sf_dir):
    """H2 bars whose prices can't be."""
    return _defects(spark, sf_dir).groupBy("instrument").agg(F.count(F.lit(1)).alias("bars"), F.sum(quality.invalid_ohlc().cast("long")).alias("invalid"))


@query(sql("day_bars", f", {_DEFECTS} select instrument, trade_date, count(*) as rows, count(distinct (open, high, low, close, volume)) as versions, case when count(distinct (open, high, low, close, volume)) = 1 then 'same_values' else 'conflicting' end as kind from bad group by instrument, trade_date having count(*) > 1"))
def duplicate_policy(spark, sf_dir):
    """H1 repeated keys, agreeing or conflicting."""
    return quality.duplicate_policy(_defects(spark, sf_dir), ["instrument", "trade_date"], ["open", "high", "low", "close", "volume"])


@query(sql("day_bars", f""", {_DEFECTS}, c as (select instrument, count(*) filter (where open is null) as no, count(*) filter (where close is null) as nc, count(*) filter {_INVALID.replace('(', '(where ', 1)} as inv, count(*) - count(distinct trade_date) as dup from bad group by all),
    l as (select instrument, unnest(['null_open', 'null_close', 'invalid_ohlc', 'duplicate_keys']) as check_id, unnest([no, nc, inv, dup]) as observed from c)
    select check_id, instrument, case when observed = 0 then 'pass' else 'fail' end as status, observed from l"""))
def quality_report(spark, sf_dir):
    """H3, H5 checks as a long table."""
    return quality.checks(_defects(spark, sf_dir), "instrument", ["open", "close"], ["instrument", "trade_date"])


@query("""select 'priority_scope' as check_id, case when count(*) = 0 then 'pass' else 'fail' end as status, count(*) as observed from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')""")
def contract_check(spark, sf_dir):
    """H4 values outside the contract's set."""
    return quality.value_set(views.table(spark, sf_dir, "orders"), "priority_scope", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])


@query("""select o_custkey, max(o_orderdate) as o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as o_totalprice from orders group by o_custkey""")
def latest_snapshot(spark, sf_dir):
    """A6 each key's latest row."""
    o = views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return quality.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(sql("contracts", """, s as (select secid, family, anchor, row_number() over (order by secid) as i from contracts),
    t as (select secid, family, i % 11 = 0 as perp, case when i % 3 = 0 then date '2199-01-01' + cast(i as integer) * 10 when i % 3 = 1 then null else anchor + 5000 end as e, case when i % 2 = 0 then anchor + 5003 end as l from s)
    select secid, family, case when perp then 'perpetual' when year(e) between 2000 and 2200 then 'expiration' when year(l) between 2000 and 2200 then 'last_trade' else 'unresolved' end as expiration_status,
    case when not perp then coalesce(case when year(e) between 2000 and 2200 then e end, case when year(l) between 2000 and 2200 then l end) end as roll_anchor,
    coalesce(case when year(e) not between 2000 and 2200 then e end, case when year(l) not between 2000 and 2200 then l end) as sentinel from t"""))
def expiration_map(spark, sf_dir):
    """H6 expirations by precedence."""
    from pyspark.sql import Window as W

    i = F.row_number().over(W.orderBy("secid"))  # contracts: a few per instrument and year
    s = views.contracts(spark, sf_dir).withColumn("i", i)
    e = F.when(F.col("i") % 3 == 0, F.date_add(F.lit("2199-01-01").cast("date"), F.col("i") * 10)).when(F.col("i") % 3 == 2, F.date_add("anchor", 5000))
    raw = s.select("secid", "family", (F.col("i") % 11 == 0).alias("is_perpetual"), e.cast("string").alias("expiration_date"), F.when(F.col("i") % 2 == 0, F.date_add("anchor", 5003)).cast("string").alias("last_trade_date"))
    return quality.expiration_map(raw)


@query("""with o(pattern, kind, f) as (values ('Brand#11', 'exact', 'E11'), ('Brand#1', 'prefix', 'P1'), ('Brand#', 'prefix', 'P')),
    c as (select p_partkey, case when p_size % 4 = 0 then p_brand when p_size % 4 = 1 then 'SiH' || p_size % 10 else 'x' || p_size end as code, case when p_size % 4 = 3 then p_brand else '' end as source_family from part),
    m as (select c.*, arg_max(f, (kind = 'exact', length(pattern))) as f, arg_max(kind, (kind = 'exact', length(pattern))) as k from c left join o on (kind = 'exact' and code = pattern) or (kind = 'prefix' and starts_with(code, pattern)) group by all)
    select p_partkey, code, source_family, coalesce(f, nullif(source_family, ''), nullif(regexp_extract(code, '^([A-Za-z]{2,})[A-Z]\\d{1,2}$', 1), '')) as family,
    case when k is not null then 'override_' || k when source_family <> '' then 'source' when regexp_extract(code, '^([A-Za-z]{2,})[A-Z]\\d{1,2}$', 1) <> '' then 'derived' else 'unresolved' end as mapping_source from m""")
def family_mapping(spark, sf_dir):
    """H8 families by overrides, source, or the code itself."""
    o = spark.createDataFrame([("Brand#11", "exact", "E11"), ("Brand#1", "prefix", "P1"), ("Brand#", "prefix", "P")], "pattern string, kind string, family string")
    r = F.col("p_size") % 4
    code = F.when(r == 0, F.col("p_brand")).when(r == 1, F.concat(F.lit("SiH"), (F.col("p_size") % 10).cast("string"))).otherwise(F.concat(F.lit("x"), F.col("p_size").cast("string")))
    c = views.table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), F.when(r == 3, F.col("p_brand")).otherwise("").alias("source_family"))
    return quality.family_mapping(c, o, "code")


@query("""select c_custkey, case when c_acctbal < 0 then 'excluded' when c_mktsegment = 'MACHINERY' then 'deferred' when c_nationkey > 20 then 'deferred' else 'included' end as decision,
    case when c_acctbal < 0 then 'negative_balance' when c_mktsegment = 'MACHINERY' then 'segment_not_ready' when c_nationkey > 20 then 'calendar_missing' else 'all_checks_passed' end as reason,
    case when c_acctbal is null or c_acctbal < 1000 then 'fail' when c_acctbal < 5000 then 'review' else 'pass' end as liquidity from customer""")
def eligibility(spark, sf_dir):
    """H11, H12, H14 ordered decisions and screens."""
    rules = [
        ("negative_balance", "excluded", F.col("c_acctbal") < 0),
        ("segment_not_ready", "deferred", F.col("c_mktsegment") == "MACHINERY"),
        ("calendar_missing", "deferred", F.col("c_nationkey") > 20),
    ]
    c = quality.classify(views.table(spark, sf_dir, "customer"), rules)
    return c.select("c_custkey", "decision", "reason", quality.screen(F.col("c_acctbal"), 1000, 5000).alias("liquidity"))


@query("""select c_nationkey, count(*) as candidates, arg_max(c_name, (c_acctbal, c_custkey)) as preferred, max(c_acctbal) as acctbal from customer where c_mktsegment <> 'BUILDING' group by c_nationkey""")
def select_universe(spark, sf_dir):
    """H10 one preferred member per family."""
    c = views.table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    return c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("candidates"), F.max_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("preferred"), F.max("c_acctbal").alias("acctbal"))


@query("""with g as (select l_returnflag, l_orderkey, l_linenumber, l_shipdate as ts, case when l_tax > 0 then l_tax end as tax, l_discount - 0.02 as rebate from lineitem),
    k as (select l_returnflag, sum(c - 1) as duplicate_keys from (select l_returnflag, l_orderkey, l_linenumber, count(*) as c from g group by all) group by all)
    select l_returnflag, count(*) as rows, count(*) filter (where epoch_us(ts + cast(l_linenumber as integer) * interval 1 minute) % 300000000 <> 0) as off_grid, count(*) filter (where tax is null) as null_tax, count(*) filter (where rebate is null) as null_rebate,
    count(*) filter (where tax < 0) as negative_tax, count(*) filter (where rebate < 0) as negative_rebate, cast(any_value(duplicate_keys) as bigint) as duplicate_keys from g join k using (l_returnflag) group by l_returnflag""")
def partition_diagnostics(spark, sf_dir):
    """H15, H21 defects per partition."""
    li = views.table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_linenumber", F.timestamp_add("MINUTE", "l_linenumber", F.col("l_shipdate").cast("timestamp")).alias("ts"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"), (F.col("l_discount") - 0.02).alias("rebate"),
    )
    return quality.partition_diagnostics(li, ["l_returnflag"], ["l_orderkey", "l_linenumber"], ["tax", "rebate"], "ts", 300)


@query(sql("bars_1h", """select instrument, min(bar_end) as first_end, max(bar_end) as last_end, count(*) as n, cast(epoch(max(bar_end)) - epoch(min(bar_end)) as bigint) as span_seconds,
    case when max(bar_end) >= timestamp '2024-01-31' then 'complete' else 'behind' end as coverage from bars_1h group by all"""))
def freshness(spark, sf_dir):
    """H16 how fresh each feed is."""
    b = views.event_bars(spark, sf_dir).withColumn("bar_end", F.col("bar_end").cast("timestamp"))
    f = quality.freshness(b, ["instrument"], "bar_end", F.lit("2024-01-31").cast("timestamp"))
    return f.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_end", "last_end")})


@query(sql("ticks", """, e as (select instrument, time_bucket(interval '1 hour', ts - interval '1 microsecond') + interval '1 hour' as h, time_bucket(interval '15 minutes', ts - interval '1 microsecond') as q from ticks)
    select instrument, h as bucket_end, count(distinct q) as observed, 4 as expected, count(distinct q) = 4 as complete from e group by all"""))
def htf_completeness(spark, sf_dir):
    """H18 quarter hours present in each hour."""
    from barwright.operators import bars

    b = bars.ticks_to_bars(views.ticks(spark, sf_dir), "15 minutes")
    g = b.groupBy("instrument", bars.bucket_end("bar_end", "1 hour").alias("bucket_end")).agg(F.count(F.lit(1)).alias("observed"))
    return g.withColumn("expected", F.lit(4)).withColumn("complete", F.col("observed") == 4)


@query(sql("day_bars", """, t as (select instrument, trade_date, close * 2 as close, 1 as p from day_bars where trade_date >= date '2001-01-01'), o as (select instrument, trade_date, close, 0 as p from day_bars where trade_date < date '2001-02-01')
    select instrument, trade_date, close from (select * from t union all select * from o where trade_date < date '2001-01-15') qualify row_number() over (partition by instrument, trade_date order by p desc) = 1"""))
def tail_refresh(spark, sf_dir):
    """A5, A11, H19 old rows with a rewritten tail."""
    d = views.day_bars(spark, sf_dir).select("instrument", "trade_date", "close")
    tail = d.where("trade_date >= '2001-01-01'").withColumn("close", F.col("close") * 2)
    return quality.tail_refresh(d.where("trade_date < '2001-02-01'"), tail, ["instrument", "trade_date"], "trade_date", F.lit("2001-01-15").cast("date"))


@query(sql("day_bars", "order_days", """, b as (select trade_date, avg(close) as v from day_bars group by all), e as (select trade_date, fx as v from order_days where year(trade_date) = 1998)
    select trade_date, round(v, 6) as v, 'base' as origin from b where trade_date not in (select trade_date from e) union all select trade_date, round(v, 6), 'enriched' from e"""))
def concat_history(spark, sf_dir):
    """A8 enriched days where there are any."""
    b = views.day_bars(spark, sf_dir).groupBy("trade_date").agg(F.avg("close").alias("v"))
    e = views.order_days(spark, sf_dir).where("year(trade_date) = 1998").select("trade_date", F.col("fx").alias("v"))
    return rounded(quality.prefer_enriched(b, e, "trade_date", ["trade_date"]))


@query(sql("day_bars", """, d as (select instrument, trade_date, volume from day_bars), f as (select instrument, count(distinct trade_date) as active_days, median(volume) as median_volume, min(trade_date) as first_day, max(trade_date) as last_day from d group by all),
    s as (select distinct trade_date from d) select instrument, active_days, round(median_volume, 6) as median_volume, round(active_days / (select count(*) from s where trade_date between first_day and last_day), 6) as coverage,
    cast(row_number() over (order by active_days / (select count(*) from s where trade_date between first_day and last_day), instrument) as integer) as weakness from f"""))
def coverage_diagnostics(spark, sf_dir):
    """H13 coverage per family and the weakest first."""
    from pyspark.sql import Window as W

    d = views.day_bars(spark, sf_dir)
    f = d.groupBy("instrument").agg(F.count_distinct("trade_date").alias("active_days"), F.median("volume").alias("median_volume"), F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    s = F.broadcast(views.sessions(spark, sf_dir))  # the calendar: some 250 days a year
    all_days = f.join(s, s["trade_date"].between(F.col("a"), F.col("b"))).groupBy("instrument", "active_days", "median_volume").agg(F.count(F.lit(1)).alias("n"))
    c = all_days.withColumn("coverage", F.col("active_days") / F.col("n"))
    return rounded(c.withColumn("weakness", F.row_number().over(W.orderBy("coverage", "instrument"))).drop("n"))


@query("select n_nationkey as nationkey, n_name as name from nation")
def column_blocks(spark, sf_dir):
    """A7 rows of archived answers in column form."""
    n = views.table(spark, sf_dir, "nation")
    page = n.groupBy((F.col("n_nationkey") / 10).cast("int").alias("page")).agg(F.collect_list(F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))).alias("data"))
    block = F.struct(F.array(F.lit("nationkey"), F.lit("name")).alias("columns"), F.col("data"))
    payload = page.select(F.to_json(F.struct(block.alias("securities"))).alias("payload"))
    rows = lake.column_blocks(payload, "payload", ["marketdata", "securities"])
    return rows.select(F.col("row")["nationkey"].cast("int").alias("nationkey"), F.col("row")["name"].alias("name"))


@query("""with a as (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as seq, o_custkey, o_orderdate, o_totalprice from orders)
    select o_custkey, count(*) as n, round(max(o_totalprice), 2) as top, sum(cast(p as bigint))::bigint as non_monotonic from (select *, coalesce(o_totalprice < lag(o_totalprice) over (partition by o_custkey order by seq), false) as p from a) group by o_custkey""")
def monotonic_check(spark, sf_dir):
    """H3 values that go backwards along a sequence."""
    o = views.table(spark, sf_dir, "orders")
    w = wn.over("o_custkey", ["o_orderdate", "o_orderkey"])
    p = F.coalesce(F.col("o_totalprice") < F.lag("o_totalprice").over(w), F.lit(False)).cast("long")
    return rounded(o.withColumn("p", p).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"), F.sum("p").alias("non_monotonic")), 2)


@query(sql("sessions", "contracts", """select distinct anchor, (select max(trade_date) from sessions s where s.trade_date < anchor) as previous_session, (select min(trade_date) from sessions s where s.trade_date > anchor) as next_session from contracts"""))
def near_sessions(spark, sf_dir):
    """D18 sessions before and after an anchor."""
    return joins.previous_and_next(views.contracts(spark, sf_dir), views.sessions(spark, sf_dir), "anchor", "trade_date")


@query(sql("ticks", """, n as (select instrument, try_cast(cast(price as varchar) as double) as price, case when user_id % 3 = 0 then null else user_id end as board, ts from ticks where instrument is not null)
    select instrument, upper(trim(instrument)) as secid, count(*) as n, count(board) as with_board, round(sum(price), 4) as value from n group by all"""))
def normalized_feed(spark, sf_dir):
    """B1, B2, H9 raw text columns to canonical ones."""
    from barwright.functions.scalar import to_number

    t = views.ticks(spark, sf_dir).select("instrument", F.col("price").cast("string").alias("p"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("board"))
    n = t.select("instrument", F.upper(F.trim("instrument")).alias("secid"), to_number("p").alias("price"), "board").where("instrument is not null")
    return rounded(n.groupBy("instrument", "secid").agg(F.count(F.lit(1)).alias("n"), F.count("board").alias("with_board"), F.sum("price").alias("value")), 4)
