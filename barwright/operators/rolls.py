"""Roll maps with a status for every row: windows, open ends, explicit gaps, perpetual identities, blocked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from barwright.functions.scalar import stable_id
from barwright.operators.joins import previous_and_next
from barwright.operators.quality import CheckFailed

#: Statuses and decision sources (fixed values).
STATUSES = ("active_window", "perpetual_identity", "explicit_partial_chain_gap", "blocked_missing_next_contract", "blocked_unresolved_anchor")
SOURCES = ("expiration_date", "last_trade_date", "perpetual_rule", "unresolved")
COLUMNS = (
    "roll_map_id", "family_code", "continuous_symbol", "source_secid", "next_secid", "is_perpetual", "roll_required", "roll_anchor_date", "roll_date",
    "valid_from_session", "valid_through_session", "decision_source", "roll_status", "review_notes",
)


def roll_map(contracts: DataFrame, sessions: DataFrame, gaps: DataFrame, policy: str, snapshot: str) -> DataFrame:
    """One row per contract, with COLUMNS.

    contracts: family_code, secid, is_perpetual, roll_anchor_date, first_trade_date, decision_source; in a family's
    order of anchors, those without one last. sessions: trade_date. gaps: secid, missing: contracts that are known
    to be left out between a contract and its next. An ordinary contract rolls at the session before its anchor; its
    window begins at the session after the roll before, the first one's at the first session on or after its first
    trade (or the snapshot's day), and ends at its roll. Statuses: blocked_unresolved_anchor without an anchor or a
    session before it, then explicit_partial_chain_gap, blocked_missing_next_contract for the last, else
    active_window; a perpetual contract is its own series, never rolls and is perpetual_identity.
    """
    plain = contracts.where(~F.col("is_perpetual"))
    w = W.partitionBy("family_code").orderBy(F.col("roll_anchor_date").asc_nulls_last(), "secid")
    near = previous_and_next(plain.where("roll_anchor_date is not null").select("roll_anchor_date").distinct(), sessions, "roll_anchor_date", "trade_date")
    df = plain.join(near.select(F.col("roll_anchor_date").alias("_anchor"), F.col("previous_session").alias("roll_date")), F.col("roll_anchor_date") == F.col("_anchor"), "left").drop("_anchor")
    df = df.where(F.col("decision_source") != "unresolved").unionByName(df.where("decision_source = 'unresolved'").withColumn("roll_date", F.lit(None).cast("date")))
    df = df.withColumn("next_secid", F.lead("secid").over(w)).withColumn("_before", F.lag("roll_date").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    # a family's first contract begins on or after its first trade: after the day before it
    df = df.withColumn("_since", F.when(F.col("_first"), F.date_sub(F.coalesce("first_trade_date", F.lit(snapshot).cast("date")), 1)).otherwise(F.col("_before")))
    after = previous_and_next(df.where("_since is not null").select(F.col("_since").alias("_day")).distinct(), sessions, "_day", "trade_date")
    df = df.join(after.select("_day", F.col("next_session").alias("valid_from_session")), F.col("_since") == F.col("_day"), "left")
    left_out = gaps.groupBy(F.col("secid").alias("_of")).agg(F.concat_ws(",", F.array_sort(F.collect_set("missing"))).alias("_missing"))
    df = df.join(left_out, F.col("secid") == F.col("_of"), "left")
    blocked = F.col("roll_date").isNull()
    status = (
        F.when(blocked, "blocked_unresolved_anchor").when(F.col("_missing").isNotNull(), "explicit_partial_chain_gap")
        .when(F.col("next_secid").isNull(), "blocked_missing_next_contract").otherwise("active_window")
    )
    notes = (
        F.when(blocked, "no roll anchor, or no session before it").when(F.col("_missing").isNotNull(), F.concat(F.lit("left out before the next: "), "_missing"))
        .when(F.col("next_secid").isNull(), "no next contract in scope")
    )
    rows = df.select(
        "family_code", F.col("family_code").alias("continuous_symbol"), F.col("secid").alias("source_secid"), "next_secid", F.lit(False).alias("is_perpetual"), F.lit(True).alias("roll_required"),
        "roll_anchor_date", "roll_date", "valid_from_session", F.col("roll_date").alias("valid_through_session"), "decision_source", status.alias("roll_status"), notes.alias("review_notes"),
    )
    none = lambda t: F.lit(None).cast(t)
    own = contracts.where("is_perpetual").select(
        "family_code", F.col("secid").alias("continuous_symbol"), F.col("secid").alias("source_secid"), none("string").alias("next_secid"), F.lit(True).alias("is_perpetual"),
        F.lit(False).alias("roll_required"), none("date").alias("roll_anchor_date"), none("date").alias("roll_date"),
        F.coalesce("first_trade_date", F.lit(snapshot).cast("date")).alias("valid_from_session"), none("date").alias("valid_through_session"), "decision_source",
        F.lit("perpetual_identity").alias("roll_status"), F.lit("its own series: no expiration, no roll").alias("review_notes"),
    )
    both = rows.unionByName(own).withColumn("_p", F.lit(policy)).withColumn("_s", F.lit(snapshot))
    return both.withColumn("roll_map_id", stable_id("_s", "_p", "family_code", "source_secid")).select(*COLUMNS)


def blockers(rolls: DataFrame, sessions: DataFrame, scope: DataFrame, excluded: list[str]) -> DataFrame:
    """(blocker, subject): every reason why a roll map must not be used; empty if there is none.

    scope: secid, the contracts that must be there, and no others. Codes are per contract, per family for
    overlapping windows, and for the scope.
    """
    w = W.partitionBy("family_code").orderBy("valid_from_session", "source_secid").rowsBetween(W.unboundedPreceding, -1)
    plain = ~F.col("is_perpetual")
    through = F.max(F.when(plain, F.col("valid_through_session"))).over(w)
    near = previous_and_next(rolls.where("roll_anchor_date is not null").select("roll_anchor_date").distinct(), sessions, "roll_anchor_date", "trade_date")
    df = rolls.withColumn("_o", plain & (F.col("valid_from_session") <= through))
    df = df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("roll_map_id", "family_code", "source_secid", "valid_from_session")))
    df = df.join(near.select(F.col("roll_anchor_date").alias("_a"), F.col("previous_session").alias("_want")), F.col("roll_anchor_date") == F.col("_a"), "left")
    df = df.join(sessions.select(F.col("trade_date").alias("_day")).distinct(), F.col("valid_from_session") == F.col("_day"), "left")
    barred = [x.upper() for x in excluded]
    tests = {
        "duplicate_primary_key_rows": F.col("_n") > 1,
        "excluded_source_instruments_present": F.upper("source_secid").isin(*barred) if barred else F.lit(False),
        "excluded_next_instruments_present": F.upper("next_secid").isin(*barred) if barred else F.lit(False),
        "invalid_decision_source": ~F.col("decision_source").isin(*SOURCES),
        "invalid_roll_status": ~F.col("roll_status").isin(*STATUSES),
        "missing_valid_from_session": F.col("valid_from_session").isNull(),
        "valid_from_not_calendar_session": plain & F.col("valid_from_session").isNotNull() & F.col("_day").isNull(),
        "perpetual_roll_required_true": ~plain & F.col("roll_required"),
        **{f"perpetual_non_null_{c}": ~plain & F.col(c).isNotNull() for c in ("next_secid", "roll_anchor_date", "roll_date")},
        "perpetual_invalid_roll_status": ~plain & (F.col("roll_status") != "perpetual_identity"),
        "perpetual_invalid_continuous_symbol": ~plain & (F.col("continuous_symbol") != F.col("source_secid")),
        "ordinary_roll_required_false": plain & ~F.col("roll_required"),
        "ordinary_missing_roll_anchor": plain & F.col("roll_anchor_date").isNull(),
        "ordinary_missing_roll_date": plain & F.col("roll_date").isNull(),
        "ordinary_roll_date_not_previous_session": plain & (F.col("roll_date") != F.col("_want")),
        "invalid_window_order": plain & (F.col("valid_from_session") > F.col("valid_through_session")),
        "active_window_missing_next_contract": (F.col("roll_status") == "active_window") & F.col("next_secid").isNull(),
        "explicit_status_missing_review_notes": F.col("roll_status").isin(*STATUSES[2:]) & F.col("review_notes").isNull(),
        "overlapping_roll_map_windows": F.col("_o"),
    }
    codes = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), c) for c, t in tests.items())))
    rows = df.select(F.explode(codes).alias("blocker"), "source_secid", "family_code")
    rows = rows.select("blocker", F.when(F.col("blocker") == "overlapping_roll_map_windows", F.col("family_code")).otherwise(F.col("source_secid")).alias("subject")).distinct()
    have, want = rolls.select(F.upper("source_secid").alias("s")).distinct(), scope.select(F.upper("secid").alias("s")).distinct()
    apart = have.join(want, "s", "left_anti").union(want.join(have, "s", "left_anti"))
    return rows.unionByName(apart.select(F.lit("whitelist_scope_mismatch").alias("blocker"), F.col("s").alias("subject")))


def assert_usable(found: DataFrame) -> None:
    """Raises with the codes of a roll map's blockers."""
    codes = [r["blocker"] for r in found.select("blocker").distinct().orderBy("blocker").collect()]  # of a fixed set
    if codes:
        raise CheckFailed(", ".join(codes))
