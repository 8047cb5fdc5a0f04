"""Regimes, price levels, crossings and event studies on daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barwright.operators import windows as wn
from barwright.operators.daily import weighted_histogram


def regime_r(
    days: DataFrame, key: str, day: str, n: int = 20, calm: float = 0.85, wide: float = 1.25,
    edge: float = 0.3, middle: tuple[float, float] = (0.4, 0.6), body: float = 0.6,
) -> DataFrame:
    """R1 calm and closing in the middle, R2 wide, closing near an end with a large body, R3 wide and
    closing in the middle, R4 the rest and days without a day before; range_ratio is the range against
    the mean of up to n ranges before."""
    span = F.col("high") - F.col("low")
    df = days.withColumn("_s", span)
    base = wn.rolling(F.avg, "_s", key, day, n, 1, lag=1)
    safe = F.greatest("_s", F.lit(1e-12))
    df = (
        df.withColumn("range_ratio", F.when(base.isNotNull(), F.col("_s") / F.greatest(base, F.lit(1e-12))))
        .withColumn("close_pos", (F.col("close") - F.col("low")) / safe).withColumn("body_ratio", F.abs(F.col("close") - F.col("open")) / safe)
    )
    r, c = F.col("range_ratio"), F.col("close_pos")
    mid, ends = c.between(*middle), (c <= edge) | (c >= 1 - edge)
    out = F.when((r <= calm) & mid, "R1").when((r >= wide) & ends & (F.col("body_ratio") >= body), "R2").when((r >= wide) & mid, "R3").otherwise("R4")
    return df.withColumn("regime", out).drop("_s")


def vol_trend(days: DataFrame, key: str, day: str, n: int = 20, min_periods: int = 5) -> DataFrame:
    """LOW, MID or HIGH by the past-only z-score of the relative range; FLAT or TREND by that of the
    trend ratio."""
    span = F.col("high") - F.col("low")
    df = days.withColumn("_v", F.try_divide(span, F.col("open"))).withColumn("_t", F.try_divide(F.abs(F.col("close") - F.col("open")), span))
    df = df.withColumn("vol_z", wn.zscore("_v", key, day, n, min_periods)).withColumn("trend_z", wn.zscore("_t", key, day, n, min_periods))
    vol = F.when(F.col("vol_z") < -0.3, "LOW").when(F.col("vol_z") > 0.7, "HIGH").when(F.col("vol_z").isNotNull(), "MID")
    trend = F.when(F.col("trend_z") < 0, "FLAT").when(F.col("trend_z").isNotNull(), "TREND")
    return df.withColumn("vol_regime", vol).withColumn("trend_regime", trend).drop("_v", "_t")


def regime_transitions(regimes: DataFrame, key: str, day: str) -> DataFrame:
    """Flags for entering and leaving a trend and for a rise in volatility."""
    w = wn.over(key, day)
    rank = F.when(F.col("vol_regime") == "LOW", 0).when(F.col("vol_regime") == "MID", 1).when(F.col("vol_regime") == "HIGH", 2)
    df = regimes.withColumn("_v", rank)
    was, trend = F.lag("trend_regime").over(w), F.col("trend_regime")
    up = F.coalesce(F.col("_v") > F.lag("_v").over(w), F.lit(False))
    enter = F.coalesce((trend == "TREND") & (was == "FLAT"), F.lit(False))
    leave = F.coalesce((trend == "FLAT") & (was == "TREND"), F.lit(False))
    return (
        df.withColumn("enter_trend", enter.cast("int")).withColumn("exit_trend", leave.cast("int")).withColumn("vol_upshift", up.cast("int"))
        .withColumn("any_shift", (enter | leave | up).cast("int")).drop("_v")
    )


def detect_levels(days: DataFrame, key: str, day: str, bins: int = 50, smooth: int = 3) -> DataFrame:
    """Price levels: strict local maxima of the smoothed, recency-weighted histogram of closes."""
    h = weighted_histogram(days, key, day, "close", bins)
    spans = h.groupBy(key).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    grid = spans.select(key, "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(h.select(key, "bin", "weight"), [key, "bin"], "left").na.fill(0.0, ["weight"])
    full = full.withColumn("smooth", wn.centred_mean("weight", key, "bin", smooth))
    peak = full.withColumn("_x", wn.local_extremum("smooth", key, "bin")).where("_x = 1")
    middle = F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins
    return peak.select(key, F.col("bin").alias("level_id"), middle.alias("level_price"), F.col("smooth").alias("strength"))


def level_crossings(days: DataFrame, levels: DataFrame, key: str, day: str) -> DataFrame:
    """Closes that come to lie on the other side of a level, and whether the next close stays there.

    The few levels of a key are joined on the key, pruned by the price band between the two closes.
    """
    w = wn.over(key, day)
    df = days.select(key, day, "close", F.lead("close").over(w).alias("_c1"), F.lead("close", 2).over(w).alias("_c2"), F.lead(day).over(w).alias("crossed_on"))
    lo, hi = F.least("close", "_c1"), F.greatest("close", "_c1")
    hit = df.join(levels, key).where((F.col("level_price") > lo) & (F.col("level_price") <= hi) & F.col("_c1").isNotNull())
    up = F.col("_c1") >= F.col("level_price")
    stays = F.when(up, F.col("_c2") >= F.col("level_price")).otherwise(F.col("_c2") < F.col("level_price"))
    return hit.select(
        key, "crossed_on", "level_id", "level_price", F.when(up, "up").otherwise("down").alias("direction"),
        F.when(F.col("_c2").isNull(), None).when(stays, "confirmed").otherwise("false_break").alias("outcome"),
    )


def approach(
    events: DataFrame, days: DataFrame, key: str, day: str, grid: list[tuple[int, int, float]], atr: str, near: float = 0.25
) -> DataFrame:
    """How price came to a crossed level, for each (n, k, x) of the grid.

    A day touches a level that its range holds or its close lies within ``near`` ATR of the crossing day;
    it leaves the level when it goes against the crossing's direction by x of its own ATR. Over the k days
    before, a touch and a later leave is a rejection, a leave without an earlier touch no state, a touch
    alone a retest; otherwise it is direct if the n days before have no touch, else no state. Without an
    ATR there is no state. The grid is rows of the events, so one join does for all of it.
    """
    numbered = days.withColumn("_i", F.row_number().over(wn.over(key, day)))
    options = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(k).alias("k"), F.lit(float(x)).alias("x")) for n, k, x in grid)))
    here = numbered.select(key, F.col(day).alias("crossed_on"), F.col("_i").alias("_e"), (near * F.col(atr)).alias("_z"))
    at = events.join(here, [key, "crossed_on"])
    most = max(max(n, k) for n, k, _ in grid)
    past = numbered.select(key, "_i", "high", "low", "close", F.col(atr).alias("_a"))
    back = at.withColumn("_i", F.explode(F.sequence(F.col("_e") - most, F.col("_e") - 1))).join(past, [key, "_i"], "left")
    level = F.col("level_price")
    touch = ((F.col("low") <= level) & (F.col("high") >= level)) | (F.abs(F.col("close") - level) <= F.col("_z"))
    off = F.when(F.col("direction") == "up", level - F.col("low")).otherwise(F.col("high") - level)
    back = back.withColumn("_t", touch).withColumn("_off", off).select("*", options.alias("g")).select("*", "g.n", "g.k", "g.x")
    in_k = F.col("_i") >= F.col("_e") - F.col("k")
    per = back.groupBy(key, "crossed_on", "level_id", "direction", "outcome", "n", "k", "x", "_z").agg(
        F.min(F.when(in_k & F.col("_t") & F.col("_a").isNotNull(), F.col("_i"))).alias("_t"),
        F.max(F.when(in_k & (F.col("_off") >= F.col("x") * F.col("_a")), F.col("_i"))).alias("_o"),
        F.coalesce(F.bool_or(F.when(F.col("_i") >= F.col("_e") - F.col("n"), F.col("_t"))), F.lit(False)).alias("_n"),
    )
    state = (
        F.when(F.col("_z").isNull(), None).when(F.col("_o") > F.col("_t"), "rejection").when(F.col("_o").isNotNull(), None)
        .when(F.col("_t").isNotNull(), "retest").when(~F.col("_n"), "direct")
    )
    return per.withColumn("approach_state", state).drop("_t", "_o", "_n", "_z")


def pnl_buckets(days: DataFrame, rules: list[tuple[str, Column]], rest: str = "other") -> DataFrame:
    """Per bucket (the first rule that holds) shares of days, profit and winning days."""
    bucket = F.lit(rest)
    for name, rule in reversed(rules):
        bucket = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(bucket)
    per = days.withColumn("bucket", bucket).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("days"), F.sum("pnl_day").alias("pnl"), F.sum((F.col("pnl_day") > 0).cast("long")).alias("wins")
    )
    total = per.agg(F.sum("days").alias("_d"), F.sum("pnl").alias("_p"), F.sum("wins").alias("_w"))
    return per.join(F.broadcast(total)).select(
        "bucket", "days", "pnl", F.try_divide("days", "_d").alias("day_share"), F.try_divide("pnl", "_p").alias("pnl_share"), F.try_divide("wins", "_w").alias("win_share")
    )


def extreme_days(days: DataFrame, key: str, day: str, q: float, min_history: int, close_below: float) -> DataFrame:
    """Days whose range exceeds the quantile q of all earlier ranges and which close low, with the
    returns of the next two days."""
    w = wn.over(key, day)
    df = days.withColumn("range", F.col("high") - F.col("low"))
    df = wn.with_expanding_quantile(df, "cut", "range", q, [key], day, min_history)
    df = df.withColumn("close_pos", F.try_divide(F.col("close") - F.col("low"), F.col("range")))
    df = df.withColumn("next_1", wn.forward_return("close", key, day, 1)).withColumn("next_2", wn.forward_return("close", key, day, 2))
    df = df.withColumn("inside_next", F.lead((wn.inside_previous(key, day)).cast("int")).over(w))
    return df.where((F.col("range") > F.col("cut")) & (F.col("close_pos") <= close_below)).select(
        key, day, "range", "cut", "close_pos", "next_1", "next_2", "inside_next"
    )


def compression_breakouts(days: DataFrame, key: str, day: str, q: float, min_history: int) -> DataFrame:
    """D0 an extreme range, D1 a range below half of it, D2 a break of D1's range: which side, and the
    result from the break to D2's close."""
    w = wn.over(key, day)
    df = wn.with_expanding_quantile(days.withColumn("range", F.col("high") - F.col("low")), "cut", "range", q, [key], day, min_history)
    nxt = {f"{c}{k}": F.lead(c, k).over(w) for c in ("high", "low", "close", "range") for k in (1, 2)}
    df = df.withColumns(nxt).withColumn("d2", F.lead(day, 2).over(w))
    df = df.where((F.col("range") > F.col("cut")) & (F.col("range1") < F.col("range") / 2) & F.col("d2").isNotNull())
    up, down = F.col("high2") > F.col("high1"), F.col("low2") < F.col("low1")
    side = F.when(up & down, "both").when(up, "up").when(down, "down").otherwise("none")
    result = F.when(side == "up", F.col("close2") - F.col("high1")).when(side == "down", F.col("low1") - F.col("close2"))
    return df.select(key, F.col(day).alias("d0"), "d2", side.alias("break_side"), result.alias("result"))


#: Tags of volume patterns; fixed values.
TAGS = (
    "ClimacticVolume", "NoDemand", "NoSupply", "StoppingVolume", "TestShakeout", "EffortVsResult", "Absorption",
    "VolumeDivergence", "OIdiv_up_price_down_oi", "OIdiv_down_price_up_oi",
)


def volume_patterns(bars: DataFrame, key: str, order: str, n: int = 20, oi: str | None = None) -> DataFrame:
    """bars with tags, an array: volume against range, wicks, the last bars' direction and open interest.

    Loudness is the z-score of volume over n bars, narrow is a range in the lowest quarter of n bars; both
    are unknown before n bars. The direction is that of the three bars before. Without ``oi`` the last two
    tags don't occur.
    """
    w = wn.over(key, order)
    lag = lambda c, k=1: F.lag(c, k).over(w)
    df = bars.withColumn("_s", F.col("high") - F.col("low")).withColumn("_i", F.row_number().over(w))
    mean, spread = (wn.rolling(f, "volume", key, order, n) for f in (F.avg, F.stddev_pop))
    df = df.withColumn("_m", mean).withColumn("_z", (F.col("volume") - mean) / F.nullif(spread, F.lit(0.0)))
    df = df.withColumn("_q", wn.rolling(lambda c: F.percentile(c, F.lit(0.25)), "_s", key, order, n))
    three = wn.over(key, order, -2, 0)
    df = df.withColumn("_z3", F.min("_z").over(three)).withColumn("_s3", F.avg("_s").over(three)).withColumn("_h5", F.max("high").over(wn.over(key, order, -5, -1)))
    v, s, z, c = (F.col(x) for x in ("volume", "_s", "_z", "close"))
    trend, part = lag("close") - lag("close", 3), s + 1e-9
    up, down, pos = (F.col("high") - F.greatest("open", "close")) / part, (F.least("open", "close") - F.col("low")) / part, (c - F.col("low")) / part
    narrow, quiet = s <= F.col("_q"), v <= 0.7 * F.col("_m")
    rules = [
        (z >= 2) & (s > 0) & (((trend > 0) & (up > 0.35)) | ((trend < 0) & (down > 0.35))),
        narrow & quiet & (c >= F.col("open")),
        narrow & quiet & (c < F.col("open")),
        (z >= 1.5) & (s > 0) & (((trend < 0) & (pos > 0.6)) | ((trend > 0) & (pos < 0.4))),
        (F.col("low") < lag("low")) & (c > lag("close")) & (F.col("_m") > 0) & (v < 0.9 * F.col("_m")),
        (z >= 1.2) & narrow,
        (F.col("_i") >= 3) & (F.col("_z3") >= 1) & (F.abs(c - lag("close", 2)) <= 0.8 * F.col("_s3")),
        (F.col("_i") >= 6) & (F.col("high") >= F.col("_h5")) & (v < lag("volume")),
    ]
    if oi:
        rules += [(c > lag("close")) & (F.col(oi) < lag(oi)), (c < lag("close")) & (F.col(oi) > lag(oi))]
    flags = df.withColumns({f"_f{k}": F.coalesce(r, F.lit(False)) for k, r in enumerate(rules)})
    found = F.filter(F.array(*(F.when(F.col(f"_f{k}"), TAGS[k]) for k in range(len(rules)))), lambda x: x.isNotNull())
    return flags.withColumn("tags", found).select(*bars.columns, "tags")
