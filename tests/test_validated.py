"""The validated read path: one test for each reason why a read is refused."""

import datetime as dt

import pytest

from barwright.operators import validated
from barwright.operators.quality import CheckFailed

D = dt.date(2024, 3, 4)
SOURCE = (
    "trade_date date, session_date date, end timestamp_ntz, continuous_symbol string, family_code string, source_secid string, source_contract string, open double, high double, low double,"
    " close double, volume long, roll_policy_id string, adjustment_policy_id string, adjustment_factor double, is_roll_boundary boolean, roll_map_id string, schema_version string"
)
CAL = "session_date date, session_interval_id string, session_start timestamp_ntz, session_end timestamp_ntz, expected_first_bar_end timestamp_ntz, expected_last_bar_end timestamp_ntz, expected_bar_count int, is_trading_day boolean"


def at(minute, day=D):
    return dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=minute)


def sources():
    """Two sessions of one day, 10:05 to 10:40 and 11:05 to 11:20, prices rising by one a bar."""
    ends = [*range(605, 641, 5), *range(665, 681, 5)]
    return [
        dict(trade_date=D, session_date=D, end=at(m), continuous_symbol="S", family_code="F", source_secid="F1", source_contract="F-1", open=float(k), high=k + 2.0, low=k - 1.0, close=k + 1.0,
             volume=10, roll_policy_id="r", adjustment_policy_id="a", adjustment_factor=1.0, is_roll_boundary=m == 640, roll_map_id="m", schema_version="continuous_5m.v1")
        for k, m in enumerate(ends, 5)
    ]


def sessions():
    return [(D, "s1", at(600), at(640), at(605), at(640), 8, True), (D, "s2", at(660), at(680), at(665), at(680), 4, True)]


def frames(spark, rows, cal):
    names = [f.split(" ")[0] for f in SOURCE.replace(", ", ",").split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SOURCE), spark.createDataFrame(cal, CAL)


def test_buckets_are_anchored_at_sessions_and_clipped_at_their_ends(spark):
    got = validated.read_validated(*frames(spark, sources(), sessions()), "30m").orderBy("bucket_end").collect()
    assert [(r["bucket_end"], r["open"], r["high"], r["low"], r["close"], r["volume"], r["source_bar_count"], r["contains_roll_boundary"]) for r in got] == [
        (at(630), 5.0, 12.0, 4.0, 11.0, 60, 6, False), (at(640), 11.0, 14.0, 10.0, 13.0, 20, 2, True), (at(680), 13.0, 18.0, 12.0, 17.0, 40, 4, False),
    ]
    assert (got[1]["first_source_end"], got[1]["last_source_end"]) == (at(635), at(640))
    day = validated.read_validated(*frames(spark, sources(), sessions()), "D1").collect()
    assert len(day) == 1 and day[0]["source_bar_count"] == 12 and day[0]["open"] == 5.0 and day[0]["close"] == 17.0 and day[0]["bucket_end"] == at(680)
    assert not validated.read_validated(*frames(spark, [], sessions()), "1h").collect()


def test_a_range_that_begins_at_a_bucket_is_whole(spark):
    tail = [r for r in sources() if r["end"] > at(630)]
    assert validated.read_validated(*frames(spark, tail, sessions()), "15m").count() == 3


def change(k, **new):
    return lambda rows: rows[k].update(new)


BROKEN = {
    "null_required_source_values": change(3, source_secid=None),
    "invalid_numeric_source_values": change(3, close=float("nan")),
    "source_schema_mismatch": change(3, schema_version="v0"),
    "invalid_source_ohlc": change(3, high=1.0),
    "source_bars_outside_calendar_intervals": change(3, end=at(650)),
    "source_bar_not_expected_by_calendar": change(3, end=at(607)),
    "duplicate_source_timestamps": lambda rows: rows.append(dict(rows[3])),
    **{f"mixed_{c}_inside_bucket": change(3, **{c: "other"}) for c in ("source_secid", "source_contract", "roll_policy_id", "adjustment_policy_id", "roll_map_id")},
    "mixed_trade_date_inside_bucket": change(3, trade_date=dt.date(2024, 3, 5)),
    "mixed_adjustment_factor_inside_bucket": change(3, adjustment_factor=2.0),
    "missing_expected_5m_source_bar_inside_bucket": lambda rows: rows.pop(3),
}


@pytest.mark.parametrize("code", BROKEN)
def test_a_broken_source_is_refused(spark, code):
    rows = sources()
    BROKEN[code](rows)
    with pytest.raises(CheckFailed) as e:
        validated.read_validated(*frames(spark, rows, sessions()), "30m")
    assert str(e.value) == code


def test_a_whole_bucket_that_lacks_is_refused(spark):
    rows = [r for r in sources() if not at(615) < r["end"] <= at(630)]
    with pytest.raises(CheckFailed, match="missing_expected_5m"):
        validated.read_validated(*frames(spark, rows, sessions()), "15m")


BAD_CALENDARS = {
    "null_required_calendar_values": lambda c: c.append((D, None, *c[0][2:])),
    "calendar_contains_non_trading_day_interval": lambda c: c.__setitem__(0, (*c[0][:7], False)),
    "invalid_calendar_session_interval": lambda c: c.__setitem__(0, (D, "s1", at(641), at(640), *c[0][4:])),
    "calendar_first_bar_before_session_start": lambda c: c.__setitem__(0, (D, "s1", at(606), *c[0][3:])),
    "calendar_last_bar_after_session_end": lambda c: c.__setitem__(0, (*c[0][:3], at(639), *c[0][4:])),
    "calendar_expected_bar_count_mismatch": lambda c: c.__setitem__(0, (*c[0][:6], 9, True)),
    "duplicate_calendar_session_interval": lambda c: c.append((D, "s1", at(700), at(710), at(705), at(710), 2, True)),
    "overlapping_calendar_session_intervals": lambda c: c.append((D, "s3", at(635), at(650), at(640), at(650), 3, True)),
    "empty_calendar_binding": lambda c: c.clear(),
}


@pytest.mark.parametrize("code", BAD_CALENDARS)
def test_a_broken_calendar_is_refused(spark, code):
    cal = sessions()
    BAD_CALENDARS[code](cal)
    with pytest.raises(CheckFailed) as e:
        validated.check_calendar(spark.createDataFrame(cal, CAL))
    assert str(e.value) == code


def test_requests_that_can_not_be_met(spark):
    source, cal = frames(spark, sources(), sessions())
    for bad, code in (((source, cal, "2h"), "unsupported_timeframe"), ((source.drop("volume"), cal, "1h"), "missing_source_columns:volume"), ((source, cal.drop("session_end"), "1h"), "missing_calendar_columns")):
        with pytest.raises(CheckFailed, match=code):
            validated.read_validated(*bad)
