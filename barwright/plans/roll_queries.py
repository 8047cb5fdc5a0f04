"""Queries over roll maps with statuses."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from barwright.operators import rolls
from barwright.plans.registry import query
from barwright.sources import views
from barwright.sources.room import kept
from barwright.sources.views import sql

_CONTRACTS = """, k as (select family as family_code, secid, case when family like 'R%' and anchor = max(anchor) over (partition by family) then null else anchor end as roll_anchor_date from contracts),
    r as (select *, (select max(trade_date) from sessions s where s.trade_date < roll_anchor_date) as roll_date, row_number() over w as n, lead(secid) over w as next_secid from k window w as (partition by family_code order by roll_anchor_date nulls last, secid)),
    p as (select *, lag(roll_date) over (partition by family_code order by n) as before from r),
    v as (select *, case when n = 1 then (select min(trade_date) from sessions where trade_date >= date '1992-06-01') else (select min(s.trade_date) from sessions s where s.trade_date > before) end as valid_from_session from p),
    m as (select family_code, family_code as continuous_symbol, secid as source_secid, next_secid, false as is_perpetual, true as roll_required, roll_anchor_date, roll_date, valid_from_session, roll_date as valid_through_session,
        case when roll_anchor_date is null then 'unresolved' else 'expiration_date' end as decision_source,
        case when roll_date is null then 'blocked_unresolved_anchor' when secid like '%_1995_2' then 'explicit_partial_chain_gap' when next_secid is null then 'blocked_missing_next_contract' else 'active_window' end as roll_status,
        case when roll_date is null then 'no roll anchor, or no session before it' when secid like '%_1995_2' then 'left out before the next: ' || family_code || '_X' when next_secid is null then 'no next contract in scope' end as review_notes from v
      union all select distinct family, family || '-P', family || '-P', null, true, false, null::date, null::date, date '1992-06-01', null::date, 'perpetual_rule', 'perpetual_identity', 'its own series: no expiration, no roll' from contracts),
    roll as (select substr(sha256('1992-06-01|previous_session|' || family_code || '|' || source_secid), 1, 24) as roll_map_id, * from m)"""


def _map(spark, sf_dir):
    """The roll map of the quarters' contracts, with a perpetual one per family and one gap; kept, as it is read often."""
    c = views.contracts(spark, sf_dir)
    last = (F.col("anchor") == F.max("anchor").over(W.partitionBy("family"))) & F.col("family").startswith("R")
    none = F.lit(None).cast("date")
    plain = c.select(
        F.col("family").alias("family_code"), "secid", F.lit(False).alias("is_perpetual"), F.when(~last, F.col("anchor")).alias("roll_anchor_date"), none.alias("first_trade_date"),
        F.when(last, "unresolved").otherwise("expiration_date").alias("decision_source"),
    )
    own = c.select("family").distinct().select(
        F.col("family").alias("family_code"), F.concat("family", F.lit("-P")).alias("secid"), F.lit(True).alias("is_perpetual"), none.alias("roll_anchor_date"), none.alias("first_trade_date"), F.lit("perpetual_rule").alias("decision_source")
    )
    gaps = c.where("secid like '%_1995_2'").select("secid", F.concat("family", F.lit("_X")).alias("missing"))
    both, sessions = kept(plain.unionByName(own)), kept(views.sessions(spark, sf_dir))
    return kept(rolls.roll_map(both, sessions, gaps, "previous_session", "1992-06-01")), both, sessions


@query(sql("sessions", "contracts", f"{_CONTRACTS} select * from roll"))
def roll_map_status(spark, sf_dir):
    """H7 roll map with the status of every row: windows, gaps, blocked rows, perpetual identities."""
    return _map(spark, sf_dir)[0]


@query(sql("sessions", "contracts", f"""{_CONTRACTS} select 'ordinary_missing_roll_anchor' as blocker, source_secid as subject from roll where not is_perpetual and roll_anchor_date is null
    union all select 'ordinary_missing_roll_date', source_secid from roll where not is_perpetual and roll_date is null union all select 'excluded_source_instruments_present', source_secid from roll where source_secid like 'AF\\_1996\\_%' escape '\\'
    union all select 'excluded_next_instruments_present', source_secid from roll where next_secid like 'AF\\_1996\\_%' escape '\\' union all select 'missing_valid_from_session', source_secid from roll where valid_from_session is null
    union all select 'whitelist_scope_mismatch', upper(source_secid) from roll where is_perpetual"""))
def roll_map_blockers(spark, sf_dir):
    """H7, H4 why a roll map can't be used: unresolved rows, excluded contracts, and a scope without perpetual ones."""
    found, contracts, sessions = _map(spark, sf_dir)
    return rolls.blockers(found, sessions, contracts.where("not is_perpetual"), [f"AF_1996_{q}" for q in (1, 2, 3, 4)])
