"""Joins that market data need: enrichment, as-of, validity intervals, gaps, first touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barwright.operators.blocked import scan


def enrich(base: DataFrame, other: DataFrame, on: list[str], suffix: str | None = None) -> DataFrame:
    """Left join; overlapping columns of the right are dropped, or renamed where a suffix is given."""
    clash = [c for c in other.columns if c in base.columns and c not in on]
    if suffix is None:
        other = other.drop(*clash)
    else:
        other = other.withColumnsRenamed({c: c + suffix for c in clash})
    return base.join(other, on, "left")


def asof(
    left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], tolerance: str | None = None, strict: bool = False
) -> DataFrame:
    """left with the right's last row at or before ts (before, if strict), no older than the tolerance.

    Both sides are stacked and carried forward by a blocked scan: linear in the rows, without a range join,
    and no task holds a key. Of right rows with equal times the values' greatest wins.
    """
    side = F.lit(0 if not strict else 1)
    names = [f"_r_{v}" for v in values]
    r = right.groupBy(*keys, ts).agg(F.max(F.struct(*values)).alias("_v")).select(
        *keys, ts, side.alias("_side"), F.struct(F.col(ts).alias("_at"), "_v").alias("_right")
    )
    lcols = [c for c in left.columns if c not in keys and c != ts]
    l = left.select(*keys, ts, F.lit(1 if not strict else 0).alias("_side"), F.struct(*lcols).alias("_left") if lcols else F.lit(True).alias("_left"))
    both = l.unionByName(r, allowMissingColumns=True)
    carried = scan(both, keys, [ts, "_side"], {"_hit": ("last", "_right")}).where("_left is not null")
    fresh = F.lit(True) if tolerance is None else F.col("_hit._at") >= F.col(ts) - F.expr(f"interval {tolerance}")
    return carried.select(
        *keys,
        ts,
        *(F.col(f"_left.{c}").alias(c) for c in lcols),
        *(F.when(fresh, F.col(f"_hit._v.{v}")).alias(v if v not in left.columns else f"{v}_right") for v in values),
    )


def interval_join(rows: DataFrame, windows: DataFrame, on: list[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """Rows with the window whose closed interval holds ``at``; an open end (null) never closes.

    The equality key shuffles or broadcasts, by size; the range is a condition on the matches.
    """
    a, b = rows.alias("a"), windows.alias("b")
    cond = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
    inside = (F.col(f"b.{start}") <= F.col(f"a.{at}")) & (F.col(f"b.{end}").isNull() | (F.col(f"a.{at}") <= F.col(f"b.{end}")))
    extra = [F.col(f"b.{c}") for c in windows.columns if c not in on]
    joined = a
    test: Column = inside
    for c in cond:
        test = c & test
    return joined.join(b, test, how).select("a.*", *extra)


def ambiguous(joined: DataFrame, key: list[str]) -> DataFrame:
    """Keys that an interval join matched more than once."""
    return joined.groupBy(*key).agg(F.count(F.lit(1)).alias("matches")).where("matches > 1")


def _fails(bad: DataFrame, reason: str) -> None:
    """Stops the run if there is a bad row; looks no further than the first."""
    from barwright.operators.quality import CheckFailed

    if not bad.isEmpty():
        raise CheckFailed(reason)


def _repeated(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join whose keys stand once on either side; repeated keys raise."""
    _fails(_repeated(left, on), "left_keys_not_unique")
    _fails(_repeated(right, on), "right_keys_not_unique")
    return left.join(right, on)


def many_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Every left row with its one right row; a repeated right key or a left row without one raises."""
    _fails(_repeated(right, on), "right_keys_not_unique")
    _fails(left.join(right, on, "left_anti"), "lookup_missed")
    return left.join(right, on)


def covered_once(rows: DataFrame, windows: DataFrame, on: list[str], key: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every row with the one window that holds ``at`` (start < at <= end); a row in none or in more raises."""
    a, b = rows.alias("a"), windows.alias("b")
    test = (F.col(f"b.{start}") < F.col(f"a.{at}")) & (F.col(f"a.{at}") <= F.col(f"b.{end}"))
    for c in on:
        test = (F.col(f"a.{c}") == F.col(f"b.{c}")) & test
    met = a.join(b, test, "left").select("a.*", *(F.col(f"b.{c}") for c in windows.columns if c not in on))
    _fails(met.where(F.col(start).isNull()), "outside_session_calendar")
    _fails(_repeated(met, key), "covered_more_than_once")
    return met


def missing_keys(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti")


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("right"))
    )


def calendar_gaps(calendar: DataFrame, observed: DataFrame, key: str, day: str) -> DataFrame:
    """Per key: sessions expected since its first day, observed, missing, and the coverage ratio."""
    seen = observed.select(key, day).distinct()
    first = seen.groupBy(key).agg(F.min(day).alias("first_day"))
    days = calendar.select(day).distinct()
    expected = first.join(F.broadcast(days), days[day] >= first["first_day"]).select(key, day)
    return (
        expected.join(seen.withColumn("_seen", F.lit(1)), [key, day], "left")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("expected_days"), F.count("_seen").alias("observed_days"))
        .withColumn("missing_days", F.col("expected_days") - F.col("observed_days"))
        .withColumn("coverage", F.col("observed_days") / F.col("expected_days"))
    )


def previous_and_next(anchors: DataFrame, sessions: DataFrame, anchor: str, day: str) -> DataFrame:
    """Of each anchor the last session before it and the first after it, carried along one ordering.

    Sessions and anchors are days of a calendar, so a year is a partition's few hundred rows; the years'
    first and last sessions bridge the borders.
    """
    s = sessions.select(F.col(day).alias("_d")).distinct().withColumn("_s", F.col("_d"))
    a = anchors.select(F.col(anchor).alias("_d")).distinct()
    years = W.orderBy("_y").rowsBetween(W.unboundedPreceding, -1)
    later = W.orderBy("_y").rowsBetween(1, W.unboundedFollowing)
    edge = (
        a.unionByName(s, allowMissingColumns=True).groupBy(F.year("_d").alias("_y"))
        .agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
        .select("_y", F.max("_hi").over(years).alias("_before"), F.min("_lo").over(later).alias("_after"))
    )
    all_days = a.withColumn("_s", F.lit(None).cast("date")).unionByName(s).withColumn("_y", F.year("_d"))
    numbered = all_days.withColumn("_n", F.datediff("_d", F.lit("1970-01-01")))
    back = W.partitionBy("_y").orderBy("_n").rangeBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy("_y").orderBy("_n").rangeBetween(1, W.unboundedFollowing)
    found = numbered.select("_d", "_y", "_s", F.max("_s").over(back).alias("_p"), F.min("_s").over(ahead).alias("_q"))
    return (
        found.where("_s is null").join(F.broadcast(edge), "_y")
        .select(
            F.col("_d").alias(anchor),
            F.coalesce("_p", "_before").alias("previous_session"),
            F.coalesce("_q", "_after").alias("next_session"),
        )
    )


def first_touch(events: DataFrame, bars: DataFrame, keys: list[str], event_ts: str, bar_ts: str, hit: Column, within: int, span: int = 32) -> DataFrame:
    """Per event the first bar of its key after it, at most ``within`` days later, for which ``hit`` holds
    (null where none does). Repeated events are one.

    Days are dealt into spans; an event goes to the few spans that its days reach into, so it meets the
    bars of these and not those of its whole key.
    """
    number = F.floor(F.datediff(F.col(bar_ts), F.lit("1970-01-01")) / span)
    from_, to = (F.floor((F.datediff(F.col(event_ts), F.lit("1970-01-01")) + d) / span) for d in (0, within))
    e = events.withColumn("_span", F.explode(F.sequence(from_, to))).alias("e")
    b = bars.withColumn("_span", number).alias("b")
    cond = (F.col("e._span") == F.col("b._span")) & (F.col(f"b.{bar_ts}") > F.col(f"e.{event_ts}"))
    cond = cond & (F.datediff(F.col(f"b.{bar_ts}"), F.col(f"e.{event_ts}")) <= within)
    for k in keys:
        cond = (F.col(f"e.{k}") == F.col(f"b.{k}")) & cond
    return e.join(b, cond & hit, "left").groupBy(*(F.col(f"e.{c}") for c in events.columns)).agg(
        F.min(f"b.{bar_ts}").alias("touched_at")
    )


def touch_fills(events: DataFrame, bars: DataFrame, keys: list[str], day: str, ts: str, level: str, side: str) -> DataFrame:
    """Break of a level within a day: entered at the open of the bar after the first that trades through
    it, left at the day's last close. events: keys, day, level, side (1 up, -1 down); nulls where nothing
    was touched, or where the touch was the day's last bar."""
    w = W.partitionBy(*keys, day).orderBy(ts)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    b = bars.withColumn("_open", F.lead("open").over(w)).withColumn("_at", F.lead(ts).over(w)).withColumn("_exit", F.last("close").over(whole))
    met = events.join(b, [*keys, day], "left")
    through = F.when(F.col(side) > 0, F.col("high") > F.col(level)).otherwise(F.col("low") < F.col(level))
    first = F.min_by(F.struct(F.col("_at").alias("filled_at"), F.col("_open").alias("fill")), F.when(through, F.col(ts)))
    out = met.groupBy(*events.columns).agg(F.min(F.when(through, F.col(ts))).alias("touched_at"), first.alias("_f"), F.max("_exit").alias("_x"))
    return out.select(
        *events.columns, "touched_at", "_f.filled_at", "_f.fill", F.when(F.col("_f.fill").isNotNull(), F.col(side) * (F.col("_x") - F.col("_f.fill"))).alias("pnl")
    )


def bucketed_join(left: DataFrame, right: DataFrame, keys: list[str], left_bucket: Column, right_bucket: Column) -> DataFrame:
    """Left join on keys and computed buckets; the right must have one row per bucket."""
    return left.withColumn("bucket", left_bucket).join(right.withColumn("bucket", right_bucket), [*keys, "bucket"], "left")
