"""Column functions: cleaning, parsing, calendars, bar shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Texts that stand for a missing value; fixed values.
MISSING = ("", "nan", "nat", "none", "null")
TRUE_WORDS = ("1", "true", "t", "yes", "y")


def clean_text(c) -> Column:
    """Trimmed; null where nothing or a word for missing remains."""
    t = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~F.lower(t).isin(*MISSING), t)


def clean_date(c) -> Column:
    return F.try_to_date(F.substring(clean_text(c), 1, 10), "yyyy-MM-dd")


def source_date(c, first: int = 2000, last: int = 2200) -> Column:
    """struct(date, sentinel): a date outside the years is a sentinel, not a date."""
    d = clean_date(c)
    inside = F.year(d).between(first, last)
    return F.struct(F.when(inside, d).alias("date"), F.when(~inside, d).alias("sentinel"))


def to_bool(c) -> Column:
    t = F.lower(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))
    return F.coalesce(t.isin(*TRUE_WORDS), F.lit(False))


def to_number(c) -> Column:
    """A double, or null where the text isn't a finite number."""
    n = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def combine_ts(date: str, time: str) -> Column:
    """A timestamp from a date and a time, unless the time has a date already."""
    full = F.when(F.col(time).rlike(r"^\d{4}-\d{2}-\d{2}"), F.col(time)).otherwise(F.concat_ws(" ", date, time))
    return F.try_to_timestamp(full)


#: Texts that end in an offset of their own.
_AWARE = r"(Z|[+-]\d{2}:?\d{2})$"


def localized(c: str, zone: str) -> Column:
    """The UTC instant, without a zone, of a time given as text: of an aware one the instant that it names,
    else a wall clock reading in ``zone``; null where it is no time."""
    aware = F.expr(f"cast(to_utc_timestamp(try_cast(`{c}` as timestamp), current_timezone()) as timestamp_ntz)")
    naive = F.expr(f"convert_timezone('{zone}', 'UTC', try_cast(`{c}` as timestamp_ntz))")
    return F.when(F.trim(c).rlike(_AWARE), aware).otherwise(naive)


def period_of(day, cutoff: str, train: str = "train", test: str = "test") -> Column:
    """The period that a day belongs to: up to and with the cutoff the first one."""
    return F.when((F.col(day) if isinstance(day, str) else day) <= F.lit(cutoff).cast("date"), train).otherwise(test)


def stable_id(*cols) -> Column:
    """24 hex digits of the SHA-256 of the parts joined by pipes; a missing part reads None."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("None")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def contract_code(c: str) -> Column:
    """struct(family, month_code, year_code, perpetual) of codes such as SiH6; others are their own family."""
    found = r"^([A-Za-z]+)([FGHJKMNQUVXZ])(\d{1,2})$"
    hit = F.col(c).rlike(found)
    return F.struct(
        F.when(hit, F.regexp_extract(c, found, 1)).otherwise(F.col(c)).alias("family"),
        F.when(hit, F.regexp_extract(c, found, 2)).alias("month_code"),
        F.when(hit, F.regexp_extract(c, found, 3)).alias("year_code"),
        F.lower(F.col(c)).rlike("(f|perp)$").alias("perpetual"),
    )


def expiries(days: DataFrame, day: str, rule: str = "third_thursday") -> DataFrame:
    """Expiry days of the years that ``day`` covers: third Thursdays of the quarters' last months, or third
    Wednesdays of all months."""
    weekday = {"third_thursday": "THU", "third_wednesday": "WED"}[rule]
    span = days.agg(F.trunc(F.min(day), "year").alias("a"), F.add_months(F.trunc(F.max(day), "year"), 23).alias("b"))
    months = span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    if rule == "third_thursday":
        months = months.where(F.month("month") % 3 == 0)
    return months.select(F.date_add(F.next_day(F.date_sub("month", 1), weekday), 14).alias("expiry"))


def front_expiry(days: DataFrame, day: str, rule: str = "third_thursday") -> DataFrame:
    """days with expiry, the first on or after the day, its distance, and whether it is at most 4 days off."""
    e = F.broadcast(expiries(days, day, rule))  # a few rows per year
    front = days.join(e, F.col("expiry") >= F.col(day)).groupBy(*days.columns).agg(F.min("expiry").alias("expiry"))
    left = F.datediff("expiry", day)
    return (
        front.withColumn("weekday", F.weekday(day))
        .withColumn("is_monday", (F.weekday(day) == 0).cast("int"))
        .withColumn("is_friday", (F.weekday(day) == 4).cast("int"))
        .withColumn("days_to_expiry", left)
        .withColumn("is_expiry_week", left.between(0, 4).cast("int"))
    )


def bar_shape() -> dict[str, Column]:
    """Range, body, where the close lies, wicks and direction of a bar."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = h - l
    return {
        "bar_range": span,
        "body": F.abs(c - o),
        "close_pos": F.try_divide(c - l, span),
        "body_ratio": F.try_divide(F.abs(c - o), span),
        "upper_wick": F.try_divide(h - F.greatest(o, c), span),
        "lower_wick": F.try_divide(F.least(o, c) - l, span),
        "direction": F.signum(c - o).cast("int"),
        "rel_range": F.try_divide(span, o),
    }


def book_features(mid: str, spreads: dict[str, str], sides: dict[str, list[str]]) -> dict[str, Column]:
    """Relative spreads, and depths that count null levels as 0."""
    rel = {f"rel_{k}": F.try_divide(F.col(v), F.col(mid)) for k, v in spreads.items()}
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rel | {f"depth_{k}": sum((zero(c) for c in cols[1:]), zero(cols[0])) for k, cols in sides.items()}


def liquidity_flag(rel_spread: str, most: float) -> Column:
    """1 where the spread is wide, 0 where not; infinite or missing spreads give null."""
    x = F.col(rel_spread)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), (x > most).cast("int"))


def string_list(c: str) -> Column:
    """An array from JSON text or text with commas; blanks are left out."""
    t = F.trim(c)
    items = F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.split(t, ","))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def payload_json(columns: list[str]) -> Column:
    """The row as JSON text, keys in order."""
    return F.to_json(F.struct(*sorted(columns)))


def logistic(b0: float, weights: dict[str, float]) -> Column:
    z = F.lit(b0)
    for name, b in weights.items():
        z = z + F.col(name) * b
    return 1 / (1 + F.exp(-z))


def band(p: Column, low: float, high: float) -> Column:
    return F.when(p < low, "adverse").when(p > high, "favorable").otherwise("neutral")
