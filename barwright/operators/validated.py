"""The validated read path: five-minute bars of a continuous series to any timeframe, or a reason why not.

Validation rides on the job that reads: every check is a counter that Dataset.observe takes from the same rows
that are written, so nothing is scanned twice, and what was written counts only if all counters are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from barwright.operators.quality import CheckFailed
from barwright.sources.room import room

#: Columns of a source bar (fixed values); those that must not change within a bucket; and the calendar's.
REQUIRED = (
    "trade_date", "session_date", "end", "continuous_symbol", "family_code", "source_secid", "source_contract", "open", "high", "low", "close",
    "volume", "roll_policy_id", "adjustment_policy_id", "adjustment_factor", "is_roll_boundary", "roll_map_id", "schema_version",
)
INVARIANT = ("trade_date", "source_secid", "source_contract", "roll_policy_id", "adjustment_policy_id", "adjustment_factor", "roll_map_id")
CALENDAR = ("session_date", "session_interval_id", "session_start", "session_end", "expected_first_bar_end", "expected_last_bar_end", "expected_bar_count", "is_trading_day")
TIMEFRAMES = {"5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "D1": 24 * 60}
STEP = 300


def _epoch(c: str | Column) -> Column:
    return F.unix_timestamp(F.col(c) if isinstance(c, str) else c)


def check_calendar(calendar: DataFrame) -> None:
    """Raises with the first reason code that a calendar of sessions (a few rows a day) gives cause for."""
    missing = [c for c in CALENDAR if c not in calendar.columns]
    if missing:
        raise CheckFailed("missing_calendar_columns:" + ",".join(missing))
    days = calendar.groupBy("session_date").agg(
        F.array_sort(F.collect_list(F.struct("session_start", "session_end", "session_interval_id"))).alias("s"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("session_interval_id").alias("ids"),
    )
    overlap = F.exists(F.sequence(F.lit(1), F.size("s") - 1), lambda k: F.col("s")[k]["session_start"] <= F.col("s")[k - 1]["session_end"])
    of_days = days.agg(
        F.sum((F.col("n") > F.col("ids")).cast("long")).alias("duplicate_calendar_session_interval"),
        F.sum(((F.size("s") > 1) & overlap).cast("long")).alias("overlapping_calendar_session_intervals"),
    ).first()
    first, last, count = F.col("expected_first_bar_end"), F.col("expected_last_bar_end"), F.col("expected_bar_count")
    steps = F.floor((_epoch("expected_last_bar_end") - _epoch("expected_first_bar_end")) / STEP) + 1
    tests = {
        "null_required_calendar_values": F.greatest(*(F.col(c).isNull().cast("int") for c in CALENDAR)) == 1,
        "calendar_contains_non_trading_day_interval": ~F.col("is_trading_day"),
        "invalid_calendar_session_interval": F.col("session_start") >= F.col("session_end"),
        "calendar_first_bar_before_session_start": first < F.col("session_start"),
        "calendar_last_bar_after_session_end": last > F.col("session_end"),
        "calendar_non_positive_expected_bar_count": count <= 0,
        "calendar_expected_bar_count_mismatch": steps != count,
    }
    rows = calendar.agg(F.count(F.lit(1)).alias("rows"), *(F.sum(F.coalesce(t, F.lit(False)).cast("long")).alias(c) for c, t in tests.items())).first()
    if not rows["rows"]:
        raise CheckFailed("empty_calendar_binding")
    found = [c for c in tests if rows[c]] + [c for c in ("duplicate_calendar_session_interval", "overlapping_calendar_session_intervals") if of_days[c]]
    if found:
        raise CheckFailed(found[0])


def resampled(source: DataFrame, calendar: DataFrame, timeframe: str, schema_version: str) -> tuple[DataFrame, list[str]]:
    """(bars, reason codes): the bars carry one counter per code, _<code>, of the violations met on the way to them.

    A source bar's session is looked up among its date's (an array of a few), so rows are never multiplied. Buckets
    are anchored at the session's start and clipped at its end; D1 has one bucket per session date.
    """
    if timeframe not in TIMEFRAMES:
        raise CheckFailed(f"unsupported_timeframe:{timeframe}")
    missing = [c for c in REQUIRED if c not in source.columns]
    if missing:
        raise CheckFailed("missing_source_columns:" + ",".join(missing))
    minutes, daily = TIMEFRAMES[timeframe], timeframe == "D1"
    day = calendar.groupBy(F.col("session_date").alias("_day")).agg(F.array_sort(F.collect_list(F.struct(
        "session_start", "session_end", "session_interval_id", "expected_first_bar_end", "expected_last_bar_end", "expected_bar_count"
    ))).alias("_day_sessions"))
    met = source.select(*REQUIRED).join(day, F.col("session_date") == F.col("_day"), "left").drop("_day")
    inside = F.filter(F.coalesce("_day_sessions", F.array()), lambda s: (s["session_start"] <= F.col("end")) & (F.col("end") <= s["session_end"]))
    met = met.withColumn("_in", inside).withColumn("_s", F.get("_in", F.lit(0)))
    start, at = _epoch("_s.session_start"), _epoch("end")
    off = (at < _epoch("_s.expected_first_bar_end")) | (at > _epoch("_s.expected_last_bar_end")) | ((at - _epoch("_s.expected_first_bar_end")) % STEP != 0)
    high, low = F.col("high"), F.col("low")
    numbers = ("open", "high", "low", "close", "volume", "adjustment_factor")
    per_row = {
        "null_required_source_values": F.greatest(*(F.col(c).isNull().cast("int") for c in REQUIRED)) == 1,
        "invalid_numeric_source_values": F.greatest(*(F.isnan(F.col(c).cast("double")).cast("int") for c in numbers)) == 1,
        "source_schema_mismatch": F.col("schema_version") != schema_version,
        "invalid_source_ohlc": (high < low) | (F.col("open") < low) | (F.col("open") > high) | (F.col("close") < low) | (F.col("close") > high),
        "source_bars_outside_calendar_intervals": F.size("_in") == 0,
        "source_bar_maps_to_multiple_calendar_intervals": F.size("_in") > 1,
        "source_bar_not_expected_by_calendar": (F.size("_in") == 1) & off,
    }
    met = met.withColumns({f"_{c}": F.coalesce(t, F.lit(False)).cast("long") for c, t in per_row.items()})
    span = minutes * 60
    number = F.greatest(F.ceil((at - start) / span), F.lit(1))
    clipped = F.timestamp_seconds(F.least(start + number * span, _epoch("_s.session_end"))).cast(dict(source.dtypes)["end"])
    last_session = F.element_at("_day_sessions", -1)["session_end"]
    met = met.withColumn("bucket_end", last_session if daily else clipped).withColumn("_interval", F.lit("day") if daily else F.col("_s.session_interval_id"))

    def ends(s: Column, low: Column, high: Column) -> Column:
        """How many bars the calendar expects of a session after low and up to high (seconds)."""
        a, b = _epoch(s["expected_first_bar_end"]), _epoch(s["expected_last_bar_end"])
        upto = lambda x: F.least(F.greatest(F.floor((x - a) / STEP) + 1, F.lit(0)), F.floor((b - a) / STEP) + 1)
        return upto(high) - upto(low)

    of_day = F.aggregate("_day_sessions", F.lit(0).cast("long"), lambda n, s: n + s["expected_bar_count"].cast("long"))
    opened = F.when(number > 1, start + (number - 1) * span).otherwise(start - 1)
    expected = of_day if daily else ends(F.col("_s"), opened, _epoch("bucket_end"))
    met = met.withColumn("_expected", expected.cast("long"))
    context = ["continuous_symbol", "family_code", "session_date", "_interval"]
    struct = F.struct("end", "open", "close")
    out = met.groupBy(*context, "bucket_end").agg(
        F.min("trade_date").alias("trade_date"), F.min("source_secid").alias("source_secid"), F.min("source_contract").alias("source_contract"),
        F.min(struct)["open"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(struct)["close"].alias("close"),
        F.sum("volume").alias("volume"), F.min("roll_policy_id").alias("roll_policy_id"), F.min("adjustment_policy_id").alias("adjustment_policy_id"),
        F.min("adjustment_factor").alias("adjustment_factor"), F.bool_or("is_roll_boundary").alias("contains_roll_boundary"),
        F.count(F.lit(1)).alias("source_bar_count"), F.min("end").alias("first_source_end"), F.max("end").alias("last_source_end"),
        *(F.sum(f"_{c}").alias(f"_{c}") for c in per_row), (F.count(F.lit(1)) - F.count_distinct("end")).alias("_duplicate_source_timestamps"),
        *(F.coalesce((F.min(c) != F.max(c)).cast("long"), F.lit(0)).alias(f"_mixed_{c}_inside_bucket") for c in INVARIANT),
        F.max("_expected").alias("_expected"), F.any_value("_s").alias("_s"),
    )
    short = F.coalesce((F.col("source_bar_count") != F.col("_expected")).cast("long"), F.lit(0))
    out = out.withColumn("_missing_expected_5m_source_bar_inside_bucket", short)
    codes = [*per_row, "duplicate_source_timestamps", *(f"mixed_{c}_inside_bucket" for c in INVARIANT), "missing_expected_5m_source_bar_inside_bucket"]
    if not daily:
        # whole buckets that lack between a session's first and last: a window over a session's few buckets
        from pyspark.sql import Window as W

        w = W.partitionBy(*context)
        lacks = ends(F.col("_s"), _epoch("first_source_end") - 1, _epoch(F.max("last_source_end").over(w))) - F.sum("source_bar_count").over(
            w.orderBy("bucket_end").rowsBetween(W.currentRow, W.unboundedFollowing)
        )
        code = "_missing_expected_5m_source_bar_inside_bucket"
        out = out.withColumn(code, F.greatest(code, F.coalesce((lacks != 0).cast("long"), F.lit(0))))
    names = ["continuous_symbol", "family_code", "trade_date", "session_date", "bucket_end", "source_secid", "source_contract", "open", "high", "low", "close", "volume",
             "roll_policy_id", "adjustment_policy_id", "adjustment_factor", "contains_roll_boundary", "source_bar_count", "first_source_end", "last_source_end"]
    return out.select(*names, F.lit(timeframe).alias("timeframe"), *(f"_{c}" for c in codes)), codes


def read_validated(source: DataFrame, calendar: DataFrame, timeframe: str, schema_version: str = "continuous_5m.v1") -> DataFrame:
    """The bars of a timeframe (5m, 15m, 30m, 1h, 4h, D1) from five-minute bars, or CheckFailed with the reason code.

    The source has the columns REQUIRED, the calendar CALENDAR. Any violation fails the whole read: nulls and
    numbers that aren't, another schema version, impossible prices, bars outside sessions, in two sessions or off
    the calendar's grid, repeated times, a bucket that mixes contracts, policies, factors, roll maps or dates, and
    buckets or whole stretches between a session's first and last bar in which an expected bar lacks. The first
    code, in this order, is raised. An empty source gives no bars. The bars are written to the shared folder, and
    read from there if all counters that the writing job observed are 0.
    """
    check_calendar(calendar)
    out, codes = resampled(source, calendar, timeframe, schema_version)
    seen = Observation("validated_read")
    watched = out.observe(seen, *(F.sum(f"_{c}").alias(c) for c in codes))
    names = [c for c in out.columns if not c.startswith("_")]
    kept = watched.select(*names)
    path = room(source.sparkSession, "validated")
    kept.write.parquet(path)
    found = [c for c in codes if seen.get.get(c)]
    if found:
        raise CheckFailed(found[0])
    return source.sparkSession.read.schema(kept.schema).parquet(path)
