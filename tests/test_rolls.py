"""Roll maps by hand, and a map for each blocker."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwright.operators import rolls
from barwright.operators.quality import CheckFailed
from barwright.sources.room import kept

CONTRACTS = "family_code string, secid string, is_perpetual boolean, roll_anchor_date date, first_trade_date date, decision_source string"


def d(day, month=1):
    return dt.date(2024, month, day)


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([(d(k),) for k in (2, 3, 4, 5, 8, 9, 10, 11, 12, 15, 16)], "trade_date date")


@pytest.fixture(scope="module")
def made(spark, sessions):
    contracts = [
        ("F", "F3", False, d(16), None, "last_trade_date"), ("F", "F1", False, d(6), d(3), "expiration_date"), ("F", "F2", False, d(11), None, "expiration_date"),
        ("F", "F4", False, None, None, "unresolved"), ("G", "G1", False, d(9), None, "expiration_date"), ("P", "P1", True, None, None, "perpetual_rule"),
    ]
    gaps = spark.createDataFrame([("F2", "F2b"), ("F2", "F2a")], "secid string, missing string")
    df = spark.createDataFrame(contracts, CONTRACTS)
    return df, kept(rolls.roll_map(df, sessions, gaps, "policy", "2024-01-06"))


def test_rows_have_windows_and_statuses(made):
    got = {r["source_secid"]: r for r in made[1].collect()}
    want = {
        "F1": ("F2", d(5), d(3), d(5), "active_window"), "F2": ("F3", d(10), d(8), d(10), "explicit_partial_chain_gap"), "F3": ("F4", d(15), d(11), d(15), "active_window"),
        "F4": (None, None, d(16), None, "blocked_unresolved_anchor"), "G1": (None, d(8), d(8), d(8), "blocked_missing_next_contract"), "P1": (None, None, d(6), None, "perpetual_identity"),
    }
    for secid, row in want.items():
        r = got[secid]
        assert (r["next_secid"], r["roll_date"], r["valid_from_session"], r["valid_through_session"], r["roll_status"]) == row, secid
    assert got["F2"]["review_notes"].endswith("F2a,F2b") and got["P1"]["continuous_symbol"] == "P1" and not got["P1"]["roll_required"]
    assert len({r["roll_map_id"] for r in got.values()}) == 6


BROKEN = {
    "duplicate_primary_key_rows": lambda m: m.union(m.where("source_secid = 'F1'")),
    "invalid_roll_status": lambda m: m.withColumn("roll_status", F.when(F.col("source_secid") == "F1", "other").otherwise(F.col("roll_status"))),
    "invalid_decision_source": lambda m: m.withColumn("decision_source", F.lit("guess")),
    "valid_from_not_calendar_session": lambda m: m.withColumn("valid_from_session", F.when(F.col("source_secid") == "F1", F.lit("2024-01-01").cast("date")).otherwise(F.col("valid_from_session"))),
    "perpetual_roll_required_true": lambda m: m.withColumn("roll_required", F.lit(True)),
    "perpetual_invalid_continuous_symbol": lambda m: m.withColumn("continuous_symbol", F.col("family_code")),
    "ordinary_roll_date_not_previous_session": lambda m: m.withColumn("roll_date", F.date_add("roll_date", 1)),
    "invalid_window_order": lambda m: m.withColumn("valid_through_session", F.date_sub("valid_through_session", 9)),
    "active_window_missing_next_contract": lambda m: m.withColumn("next_secid", F.lit(None).cast("string")),
    "explicit_status_missing_review_notes": lambda m: m.withColumn("review_notes", F.lit(None).cast("string")),
    "overlapping_roll_map_windows": lambda m: m.withColumn("valid_through_session", F.date_add("valid_through_session", 4)),
    "whitelist_scope_mismatch": lambda m: m.where("source_secid <> 'G1'"),
}


def test_a_map_without_unresolved_rows_is_usable(spark, made, sessions):
    contracts, found = made
    good, scope = found.where("source_secid <> 'F4'"), contracts.where("secid <> 'F4'")
    rolls.assert_usable(rolls.blockers(good, sessions, scope, ["X"]))
    for code, change in BROKEN.items():
        assert code in {r["blocker"] for r in rolls.blockers(change(good), sessions, scope, []).collect()}, code
    hits = {tuple(r) for r in rolls.blockers(good, sessions, scope, ["f2"]).collect()}
    assert hits == {("excluded_source_instruments_present", "F2"), ("excluded_next_instruments_present", "F1")}
    with pytest.raises(CheckFailed, match="ordinary_missing_roll_anchor, ordinary_missing_roll_date"):
        rolls.assert_usable(rolls.blockers(found, sessions, contracts, []))
