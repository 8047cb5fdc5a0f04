"""Queries that write, refresh and read partitioned tables, and the reports and screens over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.operators import bars, quality, windows as wn
from barwright.plans.joins_queries import _ROLL, _rolls
from barwright.plans.registry import query, rounded
from barwright.sources import lake, views
from barwright.sources.room import room
from barwright.sources.views import sql


def _months(spark, sf_dir) -> str:
    """The daily bars written as a lake by instrument and month, one row per key."""
    root = room(spark, "lake")
    d = views.day_bars(spark, sf_dir).withColumn("month", F.date_format("trade_date", "yyyy-MM"))
    lake.write_partitioned(d, root, ["instrument", "trade_date"], ["month", "instrument"], ["n", "close"])
    return root


@query(sql("day_bars", "select instrument, trade_date, open, high, low, close, strftime(trade_date, '%Y-%m') as month, true as from_lake from day_bars where strftime(trade_date, '%Y-%m') between '1996-03' and '1998-11' and instrument in ('AF', 'NO', 'RF')"))
def scan_partitions(spark, sf_dir):
    """A1, A4 a lake partitioned by month and instrument, read with both pruned, and where rows came from."""
    root = _months(spark, sf_dir)
    some = lake.scan_bars(spark, root, F.col("month").between("1996-03", "1998-11") & F.col("instrument").isin("AF", "NO", "RF"), lineage=True)
    return some.select("instrument", "trade_date", "open", "high", "low", "close", F.col("month").cast("string").alias("month"), F.col("source_file").contains("month=").alias("from_lake"))


@query(sql("day_bars", "select cast(trade_date as timestamp) + interval 18 hour as ts, open, high, low, close, volume from day_bars"))
def csv_bars(spark, sf_dir):
    """A2 bars from delimited text with other column names."""
    path = room(spark, "csv")
    d = views.day_bars(spark, sf_dir)
    text = d.select(F.concat(F.date_format("trade_date", "dd.MM.yyyy"), F.lit(" 18:00")).alias("Time"), *(F.col(c).alias(n) for c, n in (("open", "Op"), ("high", "Hi"), ("low", "Lo"), ("close", "Cl"))), F.col("volume").alias("Vol"))
    text.write.option("header", True).option("sep", ";").csv(path)
    names = {"ts": "Time", "open": "Op", "high": "Hi", "low": "Lo", "close": "Cl", "volume": "Vol"}
    out = lake.read_ohlc_csv(spark, path, names, ";", "dd.MM.yyyy HH:mm")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(sql("day_bars", "select instrument, trade_date, case when trade_date >= date '1998-06-10' then close * 2 else close end as close from day_bars where trade_date < date '2000-01-01'"))
def refreshed_tail(spark, sf_dir):
    """A5 days from a cutoff on replaced in one step; months before it keep their files, stale ones go."""
    root = room(spark, "lake")
    d = views.day_bars(spark, sf_dir).select("instrument", "trade_date", "close")
    lake.create_lake(d, root, "trade_date")
    # the tail lacks the last year: its old months go
    tail = d.where("trade_date < '2000-01-01'").withColumn("close", F.col("close") * 2)
    lake.refresh_tail(spark, root, tail, "trade_date", "1998-06-10", ["instrument", "trade_date"])
    return lake.read_lake(spark, root).drop("month")


@query(sql("day_bars", """select step, taken, (select count(*) from day_bars) as rows, (select max(trade_date) from day_bars) as last_day from (values ('first', true), ('shorter', false), ('empty', false), ('same', true)) as s(step, taken)"""))
def guarded_refresh(spark, sf_dir):
    """A11 a table's next version taken only if it isn't empty and doesn't end earlier."""
    root, d = room(spark, "master"), views.day_bars(spark, sf_dir)
    tries = {"first": d, "shorter": d.where("trade_date < '1997-01-01'"), "empty": d.limit(0), "same": d}
    out = []
    for step, candidate in tries.items():
        taken = lake.guarded_swap(spark, candidate, root, "bars", "trade_date")
        now = lake.current(spark, root, "bars", d.schema).agg(F.count(F.lit(1)).alias("rows"), F.max("trade_date").alias("last_day"))
        out.append(now.select(F.lit(step).alias("step"), F.lit(taken).alias("taken"), "rows", "last_day"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(sql("day_bars", "select instrument, 'run_' || instrument as run, count(*) as days, round(sum(close - open), 4) as pnl from day_bars group by all"))
def experiment_registry(spark, sf_dir):
    """A9 results of runs appended to a registry, one after the other, and read back."""
    path = room(spark, "registry")
    d = views.day_bars(spark, sf_dir).groupBy("instrument").agg(F.count(F.lit(1)).alias("days"), F.round(F.sum(F.col("close") - F.col("open")), 4).alias("pnl"))
    d = d.withColumn("run", F.concat(F.lit("run_"), F.col("instrument")))
    for part in (F.col("instrument") < "N", F.col("instrument") >= "N"):
        lake.append_registry(d.where(part), path)
    return spark.read.schema(d.schema).parquet(path)


@query("""select o_orderkey as "key", o_orderstatus as status, o_orderkey + 1 as "key#2", o_orderpriority as o_priority from orders""")
def unique_columns(spark, sf_dir):
    """A10 repeated names numbered, and the columns that exist, by name and prefix."""
    o = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") + 1).alias("again"), F.col("o_orderpriority").alias("o_priority"))
    o = o.toDF(*lake.unique_names(["key", "status", "key", "o_priority"]))
    return lake.select_existing(o, ["key", "status", "key#2", "absent"], ("o_",))


_SERIES = f""", {_ROLL}, b as (select r.family, r.secid, d.* exclude (instrument) from day_bars d join rolls r on r.family = d.instrument and d.trade_date >= r.valid_from and (r.valid_through is null or d.trade_date <= r.valid_through)),
    x as (select family, secid, trade_date, open, high, low, close from b union all select family, secid, trade_date, open, high, low, close from b where day(trade_date) = 1 and family = 'AF'),
    y as (select family, case when family = 'RF' and day(trade_date) = 2 then null else secid end as secid, trade_date, open, case when family = 'NF' and day(trade_date) = 3 then low - 1 else high end as high, low, close from x)"""
_NAMES = [
    "missing_normalized_registry", "missing_expiration_anchor", "unresolved_decision_source", "invalid_calendar_status", "duplicate_timestamps", "missing_raw_source_partitions",
    "ambiguous_active_source_contract", "overlapping_roll_map_windows", "missing_next_contract", "identity_validation", "adjustment_factor_not_1", "unexpected_included_instruments",
    "excluded_instruments_included", "row_source_lineage_completeness", "missing_expiration_map_artifact", "missing_roll_map_artifact", "missing_continuous_bars_artifact",
    "missing_continuous_d1_artifact", "duplicate_d1_rows", "missing_source_contracts_in_d1", "ohlc_validity",
]
_FOUND = f"""fams as (select distinct family from contracts), found as (
    select 'duplicate_timestamps' as check_id, family, sum(k - 1) as observed from (select family, trade_date, count(*) as k from y group by all) group by family
    union all select 'missing_raw_source_partitions', family, count(*) from (select family, secid from contracts except select family, secid from y) group by family
    union all select 'unresolved_decision_source', family, count(*) from contracts where secid like '%_1996_3' group by family
    union all select 'missing_expiration_anchor', family, count(*) from contracts where secid like '%_1996_3' group by family
    union all select 'identity_validation', family, count(*) from rolls where valid_through < valid_from group by family
    union all select 'overlapping_roll_map_windows', family, count(*) from (select family, max(coalesce(valid_through, date '9999-12-31')) over (partition by family order by valid_from rows between unbounded preceding and 1 preceding) >= valid_from as o from rolls) where o group by family
    union all select 'row_source_lineage_completeness', family, count(*) from y where secid is null group by family
    union all select 'excluded_instruments_included', family, count(distinct secid) from y where secid in ('AF_1997_2', 'NO_1997_2') group by family
    union all select 'ohlc_validity', family, count(*) from y where open is null or high is null or low is null or close is null or high < greatest(open, close, low) or low > least(open, close, high) or low <= 0 group by family)"""


@query(sql("day_bars", "sessions", "contracts", f"""{_SERIES}, {_FOUND}, n as (select unnest({_NAMES}) as check_id)
    select n.check_id, f.family, case when n.check_id = 'adjustment_factor_not_1' then 'not_applicable' when coalesce(o.observed, 0) = 0 then 'pass' when n.check_id = 'missing_raw_source_partitions' and f.family in ('AF', 'RF') then 'explicit_gap' else 'fail' end as status,
    case when n.check_id <> 'adjustment_factor_not_1' then cast(coalesce(o.observed, 0) as bigint) end as observed from n cross join fams f left join found o on o.check_id = n.check_id and o.family = f.family"""))
def series_report(spark, sf_dir):
    """H5, H4 the stitched series' named checks for every family: pass, fail, not applicable or a known gap."""
    return _report(spark, sf_dir)


def _report(spark, sf_dir):
    from barwright.operators import joins
    from barwright.sources.room import kept

    rolls, contracts = _rolls(spark, sf_dir), kept(views.contracts(spark, sf_dir))
    sessions = kept(views.sessions(spark, sf_dir))
    day = F.dayofmonth("trade_date")
    b = joins.interval_join(views.day_bars(spark, sf_dir).withColumnRenamed("instrument", "family"), rolls.select("family", "secid", "valid_from", "valid_through"), ["family"], "trade_date", "valid_from", "valid_through")
    b = b.select("family", "secid", "trade_date", "open", "high", "low", "close")
    b = b.unionByName(b.where((day == 1) & (F.col("family") == "AF")))
    b = b.withColumn("secid", F.when(~((F.col("family") == "RF") & (day == 2)), F.col("secid"))).withColumn("high", F.when((F.col("family") == "NF") & (day == 3), F.col("low") - 1).otherwise(F.col("high")))
    b = kept(b.withColumn("ts", F.col("trade_date")))
    odd = F.col("secid").endswith("_1996_3")
    exp = contracts.select("family", "secid", F.when(odd, "unresolved").otherwise("expiration").alias("expiration_status"), F.when(~odd, F.col("anchor")).alias("roll_anchor"))
    days = b.groupBy("family", "trade_date").agg(F.collect_set(F.coalesce("secid", F.lit("unknown"))).alias("source_contracts"))
    found = quality.series_checks(contracts, exp, rolls, b, days, sessions, ["AF_1997_2", "NO_1997_2"], None)
    return quality.report_rows(contracts, "family", found, {"missing_raw_source_partitions": ["AF", "RF"]})


@query(sql("day_bars", "sessions", "contracts", f"""{_SERIES}, {_FOUND} select check_id, count(*) as families from found where observed > 0 and not (check_id = 'missing_raw_source_partitions' and family in ('AF', 'RF')) group by all"""))
def report_blockers(spark, sf_dir):
    """H4, H5 the checks that stop a release, and how many families fail them."""
    return quality.blockers(_report(spark, sf_dir))


@query("""select c_custkey, upper(trim(c_mktsegment)) as family, 'C' || c_custkey as secid, case when c_acctbal < 0 then null else c_acctbal end as lot, c_nationkey % 3 = 0 as is_perpetual, case when c_nationkey % 3 = 0 then 'perpetual' else 'expiring' end as kind from customer where c_mktsegment is not null""")
def normalized_registry(spark, sf_dir):
    """H9 raw registry rows to canonical ones: trimmed upper-case names, numbers that make sense, kinds."""
    c = views.table(spark, sf_dir, "customer")
    raw = c.select("c_custkey", F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("family"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("secid"), F.col("c_acctbal").cast("string").alias("lot"), F.when(F.col("c_nationkey") % 3 == 0, "Yes").otherwise("").alias("perp"))
    return quality.normalized_registry(raw, "family", "secid", "lot", "perp")


@query("""with b as (select * from (values ('RFUD'), ('X')) as t(board)), c as (select c_nationkey as family, c_custkey as secid, c_acctbal as turnover, case when c_custkey % 5 = 0 then 'X' else 'RFUD' end as board from customer), e as (select distinct family, secid, turnover from c where board = 'RFUD'),
    p as (select n_nationkey as family, n_nationkey * 7 + 1 as wanted from nation) select p.family, count(e.secid) as candidates, coalesce(max(e.secid) filter (e.secid = p.wanted), arg_max(e.secid, (e.turnover, e.secid))) as secid,
    case when count(e.secid) = 0 then 'missing' when count(*) filter (e.secid = p.wanted) > 0 then 'preferred' else 'largest' end as chosen_by from p left join e using (family) group by p.family""")
def universe_scope(spark, sf_dir):
    """H10 a board's members: the preferred one of a family, else its largest, else marked as missing."""
    c = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("secid"), F.col("c_acctbal").alias("turnover"), F.when(F.col("c_custkey") % 5 == 0, "X").otherwise("RFUD").alias("board"))
    p = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("family"), (F.col("n_nationkey") * 7 + 1).alias("wanted"))
    return quality.select_universe(c, p, "family", "secid", "wanted", "turnover", F.col("board") == "RFUD")


@query(sql("day_bars", "sessions", """, a as (select instrument, count(*) as active, count(*) - count(distinct trade_date) as dup, min(trade_date) as f, max(trade_date) as l from day_bars group by all), r as (select trade_date from sessions order by trade_date desc limit 20),
    k as (select a.*, active / (select count(*) from sessions where trade_date >= f) as coverage, (select count(*) from r where r.trade_date >= f and not exists (select 1 from day_bars d where d.instrument = a.instrument and d.trade_date = r.trade_date)) as gaps from a)
    select instrument, active as active_days, round(coverage, 6) as coverage, gaps as recent_gaps, case when dup > 0 or active < 250 then 'fail' when coverage < 0.95 or gaps > 0 then 'review' else 'pass' end as history from k"""))
def history_screen(spark, sf_dir):
    """H12, D17 a history's length, coverage and gaps in the last twenty sessions."""
    d, s = views.day_bars(spark, sf_dir), views.sessions(spark, sf_dir)
    return rounded(quality.screened_history(d, s, "instrument", "trade_date", 250, 20))


@query("""with g as (select o_orderkey, o_orderstatus, case when o_orderpriority = '5-LOW' then 'draft' else 'final' end as mapping, case when o_orderkey % 7 = 0 then 'rejected' else 'validated' end as validation, case when o_orderkey % 11 = 0 then null else cast(o_orderdate as date) end as a, cast(o_orderdate as date) + case when o_orderkey % 13 = 0 then -1 else 40 end as z from orders),
    d as (select *, case when mapping = 'draft' then 'mapping_status_draft' when validation <> 'validated' then 'validation_status_not_accepted' when a is null or z is null then 'date_range_missing' when a > z then 'date_range_inverted' when z < date '1995-06-01' then 'expired_before_snapshot' else 'all_checks_passed' end as reason from g)
    select o_orderstatus, case when reason = 'all_checks_passed' then 'accepted' else 'rejected' end as side, reason, count(*) as n from d group by all""")
def eligibility_gate(spark, sf_dir):
    """H14 the first reason to reject, the accepted and the rejected, and their counts."""
    o, k = views.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    g = o.select(
        "o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", "draft").otherwise("final").alias("mapping"), F.when(k % 7 == 0, "rejected").otherwise("validated").alias("validation"),
        F.when(k % 11 != 0, F.to_date("o_orderdate")).alias("a"), F.date_add(F.to_date("o_orderdate"), F.when(k % 13 == 0, -1).otherwise(40)).alias("z"),
    )
    rules = [
        ("mapping_status_draft", "rejected", F.col("mapping") == "draft"),
        ("validation_status_not_accepted", "rejected", F.col("validation") != "validated"),
        ("date_range_missing", "rejected", F.col("a").isNull() | F.col("z").isNull()),
        ("date_range_inverted", "rejected", F.col("a") > F.col("z")),
        ("expired_before_snapshot", "rejected", F.col("z") < F.lit("1995-06-01").cast("date")),
    ]
    yes, no = quality.split_accepted(quality.classify(g, rules))
    both = yes.withColumn("side", F.lit("accepted")).unionByName(no.withColumn("side", F.lit("rejected")))
    return both.groupBy("o_orderstatus", "side", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(sql("day_bars", """, h as (select instrument, trade_date from day_bars where not (instrument = 'NO' and day(trade_date) = 17)), n as (select instrument, trade_date from day_bars where trade_date < date '2001-01-01'), u as (select * from h union select instrument, date '1998-08-17' from day_bars)
    select instrument, count(*) as days, count(*) filter (not ok) as missing, min(trade_date) filter (not ok) as first_missing, count(*) filter (not ok) = 0 and count(*) >= 20 as complete
    from (select n.*, exists (select 1 from u where u.instrument = n.instrument and u.trade_date = n.trade_date) as ok from n) group by instrument"""))
def history_upsert(spark, sf_dir):
    """H19 a day added where it is absent, and the days that a history still lacks."""
    d = views.day_bars(spark, sf_dir).select("instrument", "trade_date")
    history = d.where(~((F.col("instrument") == "NO") & (F.dayofmonth("trade_date") == 17)))
    more = d.select("instrument", F.lit("1998-08-17").cast("date").alias("trade_date")).distinct()
    history = history.unionByName(more.join(history, ["instrument", "trade_date"], "left_anti"))
    return quality.history_gaps(d, history, ["instrument"], "trade_date", F.lit("2001-01-01").cast("date"))


@query(sql("ticks", """, o as (select instrument, cast(ts as date) as day, case when user_id % 2 = 0 then 'FIZ' else 'YUR' end as clgroup, ts, case when trade_id % 997 = 0 then null else price end as pos_long, case when trade_id % 499 = 0 then price else -price end as pos_short from ticks), q as (select * from o union all select * from o where instrument = 'view' and extract(hour from ts) = 3),
    c as (select distinct cast(ts as date) as day from ticks where extract(day from ts) <> 13), k as (select instrument, sum(k - 1) as dup from (select instrument, clgroup, ts, count(*) as k from q group by all) group by instrument),
    a as (select instrument, count(*) filter (pos_long is null or pos_short is null) as nul, count(*) filter (coalesce(pos_long < 0, true) or coalesce(pos_short > 0, true)) as inv, count(distinct day) filter (day not in (select day from c)) as off,
        (select count(*) from c where c.day between min(q.day) and max(q.day)) - count(distinct day) filter (day in (select day from c)) as miss from q group by instrument)
    select instrument, cast(dup as bigint) as duplicate_keys, nul as null_rows, inv as invalid_rows, off as off_calendar_days, miss as missing_days,
    case when dup > 0 then 'duplicate_keys' when nul > 0 then 'null_rows' when inv > 0 then 'invalid_rows' when off > 0 then 'off_calendar_days' else 'pass' end as status from a join k using (instrument)"""))
def oi_quality(spark, sf_dir):
    """H21, B2 open interest by client group: signs, nulls, repeats, and days against the calendar."""
    t, k = views.ticks(spark, sf_dir), F.col("trade_id")
    o = t.select(
        "instrument", F.to_date("ts").alias("day"), F.when(F.col("user_id") % 2 == 0, "FIZ").otherwise("YUR").alias("clgroup"), "ts",
        F.when(k % 997 != 0, F.col("price")).alias("pos_long"), F.when(k % 499 == 0, F.col("price")).otherwise(-F.col("price")).alias("pos_short"),
    )
    o = o.unionByName(o.where((F.col("instrument") == "view") & (F.hour("ts") == 3)))
    cal = t.select(F.to_date("ts").alias("day")).distinct().where(F.dayofmonth("day") != 13)
    return quality.oi_quality(o, ["instrument"], ["clgroup", "ts"], ["pos_long"], ["pos_short"], "day", cal)


@query("""select check_id, status, observed from (values ('schema_version', 'fail', 1), ('priority_scope', 'fail', (select count(*) from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'))), ('status_scope', 'pass', 0), ('required_columns', 'fail', 1)) as t(check_id, status, observed)""")
def contract_rows(spark, sf_dir):
    """H4 a table against its contract: version, required columns, and values outside the allowed sets."""
    o = views.table(spark, sf_dir, "orders")
    sets = {"priority_scope": ("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]), "status_scope": ("o_orderstatus", ["F", "O", "P"])}
    return quality.contract_rows(o, {"version": "2", "expected": "3"}, ["o_orderkey", "o_channel"], sets)


@query(sql("ticks", """, q as (select instrument, time_bucket(interval '15 minutes', ts - interval '1 microsecond') + interval '15 minutes' as bar_end, count(*) as volume from ticks group by all), s as (select min(bar_end) as a, max(bar_end) as z from q),
    g as (select instrument, unnest(generate_series(a + interval '15 minutes', z, interval '15 minutes')) as bar_end from (select distinct instrument from q), s), h as (select g.instrument, time_bucket(interval '1 hour', g.bar_end - interval '1 microsecond') + interval '1 hour' as bucket_end, q.volume from g left join q using (instrument, bar_end))
    select instrument, bucket_end, count(*) as expected, count(volume) as observed, case when count(volume) = 0 then 'missing' when count(volume) < count(*) then 'partial' else 'complete' end as state from h group by all"""))
def expected_buckets(spark, sf_dir):
    """H18 hours against the quarter hours that the calendar expects of them, absent hours included."""
    b = bars.ticks_to_bars(views.ticks(spark, sf_dir), "15 minutes")
    return quality.bucket_states(b, "instrument", "bar_end", "15 minutes", "1 hour")
