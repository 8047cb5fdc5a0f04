"""Checks and mappings over the data lake: duplicates, contracts, roll maps, eligibility, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barwright.functions.scalar import source_date
from barwright.operators import windows as wn
from barwright.operators.joins import previous_and_next


class CheckFailed(ValueError):
    """Raised by assert_pass with the reason codes of all failed checks."""


def invalid_ohlc() -> Column:
    """True where a bar's prices can't be; a null price counts as invalid."""
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")) | (F.col("low") <= 0)
    nulls = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    return nulls | F.coalesce(bad, F.lit(True))


def duplicate_policy(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Per repeated key: rows, distinct values, and whether these agree (same_values) or conflict."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*values)).alias("versions"))
    return per.where("rows > 1").withColumn("kind", F.when(F.col("versions") == 1, "same_values").otherwise("conflicting"))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def checks(df: DataFrame, family: str, required: list[str], key: list[str], order: str | None = None, seq: str | None = None) -> DataFrame:
    """Long table (check_id, family, status, observed): nulls in required columns, repeated keys, invalid
    bars where the columns are there, and, with a sequence column, times that go backwards. One pass over
    the rows by key, one over the keys by family."""
    base = {f"null_{c}": F.col(c).isNull() for c in required}
    if {"open", "high", "low", "close"} <= set(df.columns):
        base["invalid_ohlc"] = invalid_ohlc()
    flat = df
    if order and seq:
        flat = df.withColumn("_b", F.coalesce(F.col(order) < F.lag(order).over(wn.over(family, seq)), F.lit(False)))
        base["non_monotonic"] = F.col("_b")
    own = [family, *(k for k in key if k != family)]
    per = flat.groupBy(*own).agg(*(F.sum(c.cast("long")).alias(n) for n, c in base.items()), (F.count(F.lit(1)) - 1).alias("duplicate_keys"))
    names = [*base, "duplicate_keys"]
    wide = per.groupBy(family).agg(*(F.sum(n).alias(n) for n in names))
    long = wide.select(family, F.explode(F.array(*(F.struct(F.lit(n).alias("check_id"), F.col(n).cast("long").alias("observed")) for n in names))).alias("c"))
    return long.select("c.check_id", family, F.when(F.col("c.observed") == 0, "pass").otherwise("fail").alias("status"), "c.observed")


def report_rows(families: DataFrame, family: str, counts: dict[str, DataFrame | None], gaps: dict[str, list[str]] | None = None) -> DataFrame:
    """Long table (check_id, family, status, observed) of named checks for every family.

    A check is a table (family, observed) of what it found: a family with a positive number fails, one
    without a row or with 0 passes. A check that is None is not_applicable; families that ``gaps`` names
    for a check have an explicit_gap there instead of a failure, so a known gap is told, not hidden.
    """
    out = None
    for name, found in counts.items():
        rows = families.select(family).distinct()
        if found is None:
            one = rows.withColumn("observed", F.lit(None).cast("long")).withColumn("status", F.lit("not_applicable"))
        else:
            one = rows.join(found.groupBy(family).agg(F.sum("observed").cast("long").alias("observed")), family, "left").na.fill({"observed": 0})
            known = F.col(family).isin(*(gaps or {}).get(name, [])) if (gaps or {}).get(name) else F.lit(False)
            one = one.withColumn("status", F.when(F.col("observed") == 0, "pass").when(known, "explicit_gap").otherwise("fail"))
        one = one.select(F.lit(name).alias("check_id"), family, "status", "observed")
        out = one if out is None else out.unionByName(one)
    return out


def blockers(report: DataFrame) -> DataFrame:
    """(check_id, families): the failed checks and how many families fail them."""
    return report.where("status = 'fail'").groupBy("check_id").agg(F.count(F.lit(1)).alias("families"))


def series_checks(registry: DataFrame, expirations: DataFrame, rolls: DataFrame, bars: DataFrame, days: DataFrame, sessions: DataFrame, excluded: list[str], factor: str | None) -> dict[str, DataFrame | None]:
    """The named checks of a stitched series, each as (family, observed) for report_rows.

    registry: family, secid. expirations: family, secid, expiration_status, roll_anchor. rolls: family,
    secid, next_secid, roll_date, valid_from, valid_through. bars: family, trade_date, ts, secid, open,
    high, low, close. days: family, trade_date, source_contracts (an array).
    """
    def missing(have: DataFrame) -> DataFrame:
        return registry.select("family").distinct().join(have.select("family").distinct(), "family", "left_anti").withColumn("observed", F.lit(1))

    def number(df: DataFrame) -> DataFrame:
        return df.groupBy("family").agg(F.count(F.lit(1)).alias("observed"))

    def repeated(df: DataFrame, key: list[str]) -> DataFrame:
        return df.groupBy("family", *key).agg((F.count(F.lit(1)) - 1).alias("observed")).where("observed > 0")

    w = W.partitionBy("family").orderBy("valid_from")
    last = F.lead("secid").over(w).isNull()
    numbered = rolls.withColumn("_last", last)
    overlap = rolls.withColumn("_o", wn.overlaps(rolls, "family", "valid_from", "valid_through")).where("_o")
    known = registry.select("family", "secid").distinct()
    return {
        "missing_normalized_registry": missing(registry),
        "missing_expiration_anchor": number(expirations.where("roll_anchor is null and expiration_status <> 'perpetual'")),
        "unresolved_decision_source": number(expirations.where("expiration_status = 'unresolved'")),
        "invalid_calendar_status": number(bars.join(F.broadcast(sessions), "trade_date", "left_anti")),
        "duplicate_timestamps": repeated(bars, ["ts"]),
        "missing_raw_source_partitions": number(known.join(bars.select("family", "secid").distinct(), ["family", "secid"], "left_anti")),
        "ambiguous_active_source_contract": number(bars.groupBy("family", "trade_date").agg(F.count_distinct("secid").alias("_n")).where("_n > 1")),
        "overlapping_roll_map_windows": number(overlap),
        "missing_next_contract": number(numbered.where("next_secid is null and not _last")),
        "identity_validation": number(rolls.where("valid_through < valid_from")),
        "adjustment_factor_not_1": None if factor is None else number(bars.where(F.col(factor) != 1)),
        "unexpected_included_instruments": number(bars.where("secid is not null").select("family", "secid").distinct().join(known, ["family", "secid"], "left_anti")),
        "excluded_instruments_included": number(bars.where(F.col("secid").isin(*excluded)).select("family", "secid").distinct()),
        "row_source_lineage_completeness": number(bars.where("secid is null")),
        "missing_expiration_map_artifact": missing(expirations),
        "missing_roll_map_artifact": missing(rolls),
        "missing_continuous_bars_artifact": missing(bars),
        "missing_continuous_d1_artifact": missing(days),
        "duplicate_d1_rows": repeated(days, ["trade_date"]),
        "missing_source_contracts_in_d1": number(days.where("source_contracts is null or size(source_contracts) = 0")),
        "ohlc_validity": number(bars.where(invalid_ohlc())),
    }


def value_set(df: DataFrame, check_id: str, column: str, allowed: list[str]) -> DataFrame:
    """One check row: values outside the allowed ones."""
    bad = df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).agg(F.count(F.lit(1)).alias("observed"))
    return bad.select(F.lit(check_id).alias("check_id"), F.when(F.col("observed") == 0, "pass").otherwise("fail").alias("status"), "observed")


def assert_pass(report: DataFrame) -> None:
    """Raises with the reason codes of failed checks; the report has a row per check, not per record."""
    failed = [r["check_id"] for r in report.where("status = 'fail'").select("check_id").distinct().orderBy("check_id").collect()]
    if failed:
        raise CheckFailed(", ".join(failed))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each key's row of the latest snapshot."""
    names = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_l"))
    return best.select(*key, *(F.col(f"_l.{c}").alias(c) for c in names))


def expiration_map(snapshots: DataFrame) -> DataFrame:
    """(secid, family, expiration_status, roll_anchor, sentinel): perpetual, else the expiration date, else
    the last trade date, else unresolved; dates beyond the plausible years are kept as sentinels."""
    e, l = source_date("expiration_date"), source_date("last_trade_date")
    df = snapshots.withColumn("_e", e).withColumn("_l", l)
    status = (
        F.when(F.col("is_perpetual"), "perpetual").when(F.col("_e.date").isNotNull(), "expiration")
        .when(F.col("_l.date").isNotNull(), "last_trade").otherwise("unresolved")
    )
    anchor = F.when(~F.col("is_perpetual"), F.coalesce("_e.date", "_l.date"))
    return df.select("secid", "family", status.alias("expiration_status"), anchor.alias("roll_anchor"), F.coalesce("_e.sentinel", "_l.sentinel").alias("sentinel"))


def roll_map(contracts: DataFrame, sessions: DataFrame, family: str, anchor: str, day: str) -> DataFrame:
    """Validity windows: a contract's roll date is the session before its anchor, its window begins at the
    session after the previous roll, and the last contract's never ends."""
    near = previous_and_next(contracts, sessions, anchor, day)
    df = contracts.join(near, anchor).withColumn("roll_date", F.col("previous_session"))
    w = wn.over(family, anchor)
    df = df.withColumn("next_secid", F.lead("secid").over(w)).withColumn("_p", F.lag("roll_date").over(w))
    after = previous_and_next(df.where("_p is not null").select(F.col("_p").alias("_p")).distinct(), sessions, "_p", day).select("_p", F.col("next_session").alias("_n"))
    first = sessions.agg(F.min(day).alias("_first"))
    joined = df.join(after, "_p", "left").join(F.broadcast(first))
    return joined.select(
        family, "secid", anchor, "roll_date", "next_secid",
        F.when(F.col("_p").isNull(), F.col("_first")).otherwise(F.col("_n")).alias("valid_from"),
        F.when(F.col("next_secid").isNotNull(), F.col("roll_date")).alias("valid_through"),
    )


def family_mapping(codes: DataFrame, overrides: DataFrame, code: str) -> DataFrame:
    """Override by exact code, then by longest prefix, then the source's family, then the code's letters,
    else unresolved. Overrides (pattern, kind, family) are configuration, a few rows."""
    o = F.broadcast(overrides)
    hit = ((F.col("kind") == "exact") & (F.col(code) == F.col("pattern"))) | ((F.col("kind") == "prefix") & F.col(code).startswith(F.col("pattern")))
    rank = F.struct((F.col("kind") == "exact").cast("int"), F.length("pattern"))
    found = codes.join(o, hit, "left").groupBy(*codes.columns).agg(
        F.max_by("family", rank).alias("_f"), F.max_by("kind", rank).alias("_k")
    )
    letters = F.regexp_extract(code, r"^([A-Za-z]{2,})[A-Z]\d{1,2}$", 1)
    family = F.coalesce("_f", F.nullif("source_family", F.lit("")), F.nullif(letters, F.lit("")))
    how = (
        F.when(F.col("_k").isNotNull(), F.concat(F.lit("override_"), F.col("_k"))).when(F.nullif("source_family", F.lit("")).isNotNull(), "source")
        .when(letters != "", "derived").otherwise("unresolved")
    )
    return found.withColumn("family", family).withColumn("mapping_source", how).drop("_f", "_k")


def classify(df: DataFrame, rules: list[tuple[str, str, Column]], accepted: str = "included") -> DataFrame:
    """decision and reason by the first rule (reason, decision, condition) that holds; else accepted."""
    decision, reason = F.lit(accepted), F.lit("all_checks_passed")
    for why, what, cond in reversed(rules):
        hit = F.coalesce(cond, F.lit(False))
        decision, reason = F.when(hit, what).otherwise(decision), F.when(hit, why).otherwise(reason)
    return df.withColumn("decision", decision).withColumn("reason", reason)


def screen(metric: Column, fail_below: float, pass_from: float) -> Column:
    return F.when(metric.isNull() | (metric < fail_below), "fail").when(metric < pass_from, "review").otherwise("pass")


def flag_join(base: DataFrame, key: str, sets: dict[str, DataFrame]) -> DataFrame:
    """base with one flag per set of keys, and all_flags."""
    df = base
    for name, members in sets.items():
        df = df.join(members.select(key).distinct().withColumn(name, F.lit(True)), key, "left").na.fill({name: False})
    every = F.lit(True)
    for name in sets:
        every = every & F.col(name)
    return df.withColumn("all_flags", every)


def partition_diagnostics(df: DataFrame, parts: list[str], key: list[str], values: list[str], ts: str, grid_seconds: int) -> DataFrame:
    """Per partition: rows, repeated keys, times off the grid, nulls per value, negative values; one pass
    over the rows by key, one over the keys by partition."""
    off = F.unix_micros(F.col(ts).cast("timestamp")) % (grid_seconds * 1_000_000) != 0
    found = {"off_grid": off} | {f"null_{v}": F.col(v).isNull() for v in values} | {f"negative_{v}": F.coalesce(F.col(v) < 0, F.lit(False)) for v in values}
    per = df.groupBy(*parts, *key).agg(F.count(F.lit(1)).alias("rows"), *(F.sum(c.cast("long")).alias(n) for n, c in found.items()))
    return per.groupBy(*parts).agg(F.sum("rows").alias("rows"), *(F.sum(n).alias(n) for n in found), F.sum(F.col("rows") - 1).alias("duplicate_keys"))


def oi_quality(df: DataFrame, keys: list[str], row_key: list[str], longs: list[str], shorts: list[str], day: str, calendar: DataFrame) -> DataFrame:
    """Per key the defects of open interest: repeated rows, nulls, positions of the wrong sign (longs and
    numbers below 0, shorts above), days off the calendar, calendar days missing between first and last,
    and the first reason to reject it, or pass."""
    all_ = [*longs, *shorts]
    null = F.lit(False)
    bad = F.lit(False)
    for c in all_:
        null = null | F.col(c).isNull()
        bad = bad | F.coalesce(F.col(c) < 0 if c in longs else F.col(c) > 0, F.lit(True))
    per = df.groupBy(*keys, *row_key, day).agg((F.count(F.lit(1)) - 1).alias("_d"), F.sum(null.cast("long")).alias("_n"), F.sum(bad.cast("long")).alias("_b"))
    days = per.groupBy(*keys, day).agg(F.sum("_d").alias("_d"), F.sum("_n").alias("_n"), F.sum("_b").alias("_b"))
    cal = F.broadcast(calendar.select(F.col(day)).distinct().withColumn("_cal", F.lit(True)))  # a few hundred days a year
    marked = days.join(cal, day, "left")
    out = marked.groupBy(*keys).agg(
        F.sum("_d").alias("duplicate_keys"), F.sum("_n").alias("null_rows"), F.sum("_b").alias("invalid_rows"),
        F.sum(F.col("_cal").isNull().cast("long")).alias("off_calendar_days"), F.count("_cal").alias("_seen"), F.min(day).alias("_a"), F.max(day).alias("_z"),
    )
    expected = out.select(*keys, "_a", "_z").join(cal.withColumnRenamed(day, "_day"), F.col("_day").between(F.col("_a"), F.col("_z"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("_e"))
    out = out.join(expected, keys, "left").withColumn("missing_days", F.coalesce("_e", F.lit(0)) - F.col("_seen"))
    order = ["duplicate_keys", "null_rows", "invalid_rows", "off_calendar_days"]
    reason = F.coalesce(*(F.when(F.col(c) > 0, c) for c in order), F.lit("pass"))
    return out.select(*keys, *order, "missing_days", reason.alias("status"))


def history_screen(active: Column, least: int, repeated: Column, coverage: Column, recent_gaps: Column) -> Column:
    """fail on repeated rows or too few days, review on coverage below 95 % or recent gaps, else pass."""
    return F.when((repeated > 0) | active.isNull() | (active < least), "fail").when(coverage.isNull() | (coverage < 0.95) | (recent_gaps > 0), "review").otherwise("pass")


def split_accepted(decided: DataFrame, decision: str = "decision", accepted: str = "included") -> tuple[DataFrame, DataFrame]:
    """The rows that the rules accept, and the others."""
    return decided.where(F.col(decision) == accepted), decided.where(F.col(decision) != accepted)


def history_gaps(days: DataFrame, history: DataFrame, keys: list[str], day: str, before: Column, least: int = 20) -> DataFrame:
    """Per key: days before ``before``, of them missing in the history, the first missing, and whether the
    history is complete and has ``least`` days."""
    need = days.where(F.col(day) < before).select(*keys, day).distinct()
    have = history.where(F.col(day) < before).select(*keys, day).distinct().withColumn("_h", F.lit(True))
    out = need.join(have, [*keys, day], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.sum(F.col("_h").isNull().cast("long")).alias("missing"), F.min(F.when(F.col("_h").isNull(), F.col(day))).alias("first_missing")
    )
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("days") >= least))


def freshness(df: DataFrame, key: list[str], ts: str, target: Column) -> DataFrame:
    """Per key first and last time, span in seconds, rows, and whether the last reaches the target."""
    span = F.unix_timestamp("last_end") - F.unix_timestamp("first_end")
    per = df.groupBy(*key).agg(F.min(ts).alias("first_end"), F.max(ts).alias("last_end"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("span_seconds", span).withColumn("coverage", F.when(F.col("last_end") >= target, "complete").otherwise("behind"))


def tail_refresh(old: DataFrame, tail: DataFrame, key: list[str], day: str, cutoff: Column) -> DataFrame:
    """Old rows before the cutoff and all of the tail. Of tail rows that repeat a key the greatest counts; an old row
    gives way where the tail has its key, and the others pass through as they are, without a shuffle unless the
    tail's rows before the cutoff are too many to broadcast."""
    rest = [c for c in old.columns if c not in key]
    new = tail.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_l")).select(*key, *(F.col(f"_l.{c}").alias(c) for c in rest)).select(*old.columns)
    early = tail.where(F.col(day) < cutoff).select(*key).distinct()
    return old.where(F.col(day) < cutoff).join(early, key, "left_anti").select(*old.columns).unionByName(new)


def prefer_enriched(base: DataFrame, enriched: DataFrame, day: str, key: list[str]) -> DataFrame:
    """Per day the enriched rows where there are any, else the base's; one row per key."""
    have = enriched.select(day).distinct()
    rest = base.join(have, day, "left_anti")
    both = rest.withColumn("origin", F.lit("base")).unionByName(enriched.withColumn("origin", F.lit("enriched")), allowMissingColumns=True)
    w = W.partitionBy(*key).orderBy(*(F.desc_nulls_last(c) for c in both.columns if c not in key))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def may_replace(candidate: DataFrame, baseline: DataFrame, ts: str) -> bool:
    """Whether a rebuilt table may take the old one's place: it has rows, and its last time isn't earlier."""
    new, old = (d.agg(F.max(ts).alias("m"), F.count(F.lit(1)).alias("n")).first() for d in (candidate, baseline))
    return new["n"] > 0 and (old["m"] is None or new["m"] >= old["m"])


def normalized_registry(raw: DataFrame, family: str, secid: str, lot: str, perpetual: str) -> DataFrame:
    """Canonical registry rows: trimmed upper-case names, lots that are numbers of 0 or more, and whether a
    member is perpetual; rows without a family are left out, other columns stay."""
    from barwright.functions.scalar import clean_text, to_bool, to_number

    n = to_number(lot)
    rest = [c for c in raw.columns if c not in (family, secid, lot, perpetual)]
    out = raw.select(
        *rest, F.upper(clean_text(family)).alias("family"), F.upper(clean_text(secid)).alias("secid"), F.when(n >= 0, n).alias("lot"), to_bool(perpetual).alias("is_perpetual")
    )
    return out.where("family is not null").withColumn("kind", F.when(F.col("is_perpetual"), "perpetual").otherwise("expiring"))


def select_universe(members: DataFrame, families: DataFrame, family: str, secid: str, wanted: str, size: str, scope: Column) -> DataFrame:
    """Per family of the list: candidates in scope, the one chosen, and why: its wanted one if that is among
    them, else the largest, else none, marked as missing."""
    inside = members.where(scope).select(family, secid, size).distinct()
    met = families.join(inside, family, "left")
    hit = F.max(F.when(F.col(secid) == F.col(wanted), F.col(secid)))
    out = met.groupBy(family).agg(F.count(secid).alias("candidates"), hit.alias("_w"), F.max_by(secid, F.struct(size, secid)).alias("_l"))
    how = F.when(F.col("candidates") == 0, "missing").when(F.col("_w").isNotNull(), "preferred").otherwise("largest")
    return out.select(family, "candidates", F.coalesce("_w", "_l").alias(secid), how.alias("chosen_by"))


def screened_history(days: DataFrame, sessions: DataFrame, key: str, day: str, least: int, recent: int) -> DataFrame:
    """Per key: active days, coverage of the sessions since its first day, sessions missing among the last
    ``recent``, and the screen's answer."""
    a = days.groupBy(key, day).agg(F.count(F.lit(1)).alias("_c")).groupBy(key).agg(
        F.count(F.lit(1)).alias("active_days"), F.sum(F.col("_c") - 1).alias("_dup"), F.min(day).alias("_f")
    )
    cal = sessions.select(F.col(day).alias("_s")).distinct()
    last = cal.orderBy(F.desc("_s")).limit(recent).withColumn("_late", F.lit(True))
    cal = F.broadcast(cal.join(last, "_s", "left"))  # the calendar: some 250 days a year
    seen = days.select(F.col(key), F.col(day).alias("_s")).distinct().withColumn("_seen", F.lit(True))
    met = a.join(cal, F.col("_s") >= F.col("_f")).join(seen, [key, "_s"], "left").groupBy(key, "active_days", "_dup").agg(
        F.count(F.lit(1)).alias("_e"), F.sum((F.col("_late").isNotNull() & F.col("_seen").isNull()).cast("long")).alias("recent_gaps")
    )
    met = met.withColumn("coverage", F.col("active_days") / F.col("_e"))
    answer = history_screen(F.col("active_days"), least, F.col("_dup"), F.col("coverage"), F.col("recent_gaps"))
    return met.select(key, "active_days", "coverage", "recent_gaps", answer.alias("history"))


def contract_rows(df: DataFrame, versions: dict[str, str], required: list[str], sets: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(check_id, status, observed): the version, required columns that are absent, and per named set the
    values outside it, all sets in one pass."""
    absent = len([c for c in required if c not in df.columns])
    known = [("schema_version", int(versions["version"] != versions["expected"])), ("required_columns", absent)]
    outside = [F.coalesce(F.sum((~F.coalesce(F.col(c).isin(*allowed), F.lit(False))).cast("long")), F.lit(0)).alias(n) for n, (c, allowed) in sets.items()]
    counts = df.agg(*outside)
    rows = [F.struct(F.lit(n).alias("check_id"), F.lit(k).cast("long").alias("observed")) for n, k in known]
    rows += [F.struct(F.lit(n).alias("check_id"), F.col(n).alias("observed")) for n in sets]
    long = counts.select(F.explode(F.array(*rows)).alias("r"))
    return long.select("r.check_id", F.when(F.col("r.observed") == 0, "pass").otherwise("fail").alias("status"), "r.observed")


def bucket_states(bars: DataFrame, key: str, ts: str, part: str, whole: str) -> DataFrame:
    """Per key and whole bucket, from the first part of any key to the last: parts expected and observed,
    and whether it is complete, partial or missing. The grid is laid per key and day, not per key."""
    from barwright.operators.bars import bucket_end

    span = bars.agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"))
    keys = bars.select(key).distinct()
    days = span.select("_a", "_z", F.explode(F.expr("sequence(date_trunc('day', _a), _z, interval 1 day)")).alias("_d"))
    ends = days.select("_a", "_z", F.explode(F.expr(f"sequence(_d + interval {part}, _d + interval 1 day, interval {part})")).alias(ts)).where((F.col(ts) > F.col("_a")) & (F.col(ts) <= F.col("_z")))
    kind = dict(bars.dtypes)[ts]
    grid = F.broadcast(keys).join(ends.select(F.col(ts).cast(kind).alias(ts)))
    met = grid.join(bars.groupBy(key, ts).agg(F.lit(True).alias("_s")), [key, ts], "left").groupBy(key, bucket_end(ts, whole).alias("bucket_end"))
    out = met.agg(F.count(F.lit(1)).alias("expected"), F.count("_s").alias("observed"))
    return out.withColumn("state", F.when(F.col("observed") == 0, "missing").when(F.col("observed") < F.col("expected"), "partial").otherwise("complete"))
