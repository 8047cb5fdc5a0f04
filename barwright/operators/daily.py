"""Day features, activity, pivots and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barwright.operators import blocked, windows as wn


def intraday_features(bars: DataFrame, key: str, day: str, order: str) -> DataFrame:
    """Per day: range, rel_range, trend_ratio, sign flips, lag-1 autocorrelation of log returns (from 4 of
    them), their deviation (from 3), local extrema, and the first half's share of the day's move."""
    w = wn.over([key, day], order)
    df = bars.withColumn("_r", wn.log_return("close", w)).withColumn("_d", F.signum(wn.diff("close", w)))
    df = df.withColumn("_s", F.last(F.when(F.col("_d") != 0, F.col("_d")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    df = (
        df.withColumn("_p", F.lag("_r").over(w))
        .withColumn("_f", (F.col("_s") != F.lag("_s").over(w)).cast("int"))
        .withColumn("_x", F.abs(wn.local_extremum("close", [key, day], order)))
        .withColumn("_i", F.row_number().over(w))
        .withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key, day)))
    )
    half = F.max_by("close", F.when(F.col("_i") <= F.ceil(F.col("_n") / 2), F.col("_i")))
    out = df.groupBy(key, day).agg(
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.count(F.lit(1)).alias("bars"),
        F.coalesce(F.sum("_f"), F.lit(0)).alias("sign_flips"),
        F.when(F.count("_r") >= 3, F.stddev_samp("_r")).alias("ret_std"),
        F.when(F.count(F.when(F.col("_p").isNotNull(), F.col("_r"))) >= 3, F.corr("_r", "_p")).alias("acf1"),
        F.sum("_x").alias("local_extrema"),
        half.alias("_half"),
    )
    move = F.col("close") - F.col("open")
    return (
        out.withColumn("range", F.col("high") - F.col("low"))
        .withColumn("rel_range", F.try_divide("range", "open"))
        .withColumn("trend_ratio", F.try_divide(F.abs(move), F.col("range")))
        .withColumn("first_half_share", F.try_divide(F.col("_half") - F.col("open"), move))
        .drop("_half")
    )


def net_position(df: DataFrame, key: str, day: str, order, long: Column, short: Column) -> DataFrame:
    """Per day the first and last net position, its change, and the imbalance at the end."""
    net = df.withColumn("_net", long - short).withColumn("_gross", long + short)
    return (
        net.groupBy(key, day)
        .agg(F.min_by("_net", order).alias("net_open"), F.max_by("_net", order).alias("net_close"), F.max_by("_gross", order).alias("_g"))
        .withColumn("net_change", F.col("net_close") - F.col("net_open"))
        .withColumn("imbalance", F.try_divide("net_close", "_g"))
        .drop("_g")
    )


def activity(rows: DataFrame, key: str, day: str, volume: str, value: str) -> DataFrame:
    """Per key: active and zero-volume days, medians of the daily sums."""
    days = rows.groupBy(key, day).agg(F.sum(volume).alias("volume"), F.sum(value).alias("value"), F.count(F.lit(1)).alias("n"))
    return days.groupBy(key).agg(
        F.sum((F.col("volume") > 0).cast("long")).alias("active_days"),
        F.sum((F.col("volume") <= 0).cast("long")).alias("zero_days"),
        F.median("volume").alias("median_volume"),
        F.median("value").alias("median_value"),
        F.median("n").alias("median_trades"),
    )


def pivot_last(df: DataFrame, keys: list[str], group: str, groups: list[str], value: str, order) -> DataFrame:
    """Wide form: per key one column per group with its last value, and the sum of their sizes."""
    wide = df.groupBy(*keys).pivot(group, groups).agg(F.max_by(value, order))
    total = sum((F.coalesce(F.abs(F.col(g)), F.lit(0)) for g in groups[1:]), F.coalesce(F.abs(F.col(groups[0])), F.lit(0)))
    return wide.withColumn("total", total)


def group_shares(df: DataFrame, keys: list[str], group: str, groups: list[str], value: str, order, along: str, within: list[str] = ()) -> DataFrame:
    """Wide form with each group's share of the total size, and the total's change from row to row."""
    wide = df.groupBy(*keys).pivot(group, groups).agg(F.max_by(value, order))
    total = F.abs(F.col(groups[0]))
    for g in groups[1:]:
        total = total + F.abs(F.col(g))
    wide = wide.withColumn("oi_total", total)
    shares = {f"{g}_share": F.try_divide(F.abs(F.col(g)), F.nullif("oi_total", F.lit(0.0))) for g in groups}
    w = W.partitionBy(*(within or [F.lit(0)])).orderBy(along)  # one row per bucket, of one series or of each of within
    return wide.withColumns(shares).withColumn("oi_delta", F.col("oi_total") - F.lag("oi_total").over(w))


def last_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last whole row of each key."""
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def daily_mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value per key; the least of those that tie."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    best = W.partitionBy(*keys).orderBy(F.desc("n"), column)
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def period_report(days: DataFrame, keys: list[str], day: str, period: str, stopped: str | None = None) -> DataFrame:
    """Per calendar period: days, profit, mean, win rate, and whether it was profitable; with a column of
    stopped trades also trades and the rate of these."""
    more = [F.count(F.lit(1)).alias("trades"), F.avg(F.col(stopped).cast("double")).alias("stop_rate")] if stopped else []
    return days.groupBy(*keys, F.date_trunc(period, day).cast("date").alias("period")).agg(
        F.count_distinct(day).alias("days"),
        F.sum("pnl_day").alias("net"),
        F.avg("pnl_day").alias("mean"),
        F.avg((F.col("pnl_day") > 0).cast("double")).alias("win_rate"),
        (F.sum("pnl_day") > 0).alias("profitable"),
        *more,
    )


def profit_factor(pnl: str) -> Column:
    """An aggregate: gains over losses, infinite without losses."""
    gain, loss = (F.sum(F.when(c, F.abs(pnl)).otherwise(0.0)) for c in (F.col(pnl) > 0, F.col(pnl) < 0))
    return F.when(loss == 0, F.lit(float("inf"))).otherwise(F.try_divide(gain, loss))


def trade_stats(days: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Profit factor (infinite without losses), win rate and worst drawdown of a series of results; keys
    may hold a period (see scalar.period_of), whose equity then starts anew."""
    curve = blocked.drawdown(days, "pnl_day", keys, [order])
    return curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        profit_factor("pnl_day").alias("profit_factor"),
        F.avg((F.col("pnl_day") > 0).cast("double")).alias("win_rate"),
        F.min("drawdown").alias("max_drawdown"),
    )


def status_counts(df: DataFrame, family: str, status: str) -> DataFrame:
    """Counts per family and status, per family, and over all (nulls mark what is summed up)."""
    return df.rollup(family, status).agg(F.count(F.lit(1)).alias("n"))


def session_table(bars: DataFrame, key: str, day: str, order) -> DataFrame:
    """Per key and session its index, weekday and bar."""
    s = bars.groupBy(key, day).agg(
        F.count(F.lit(1)).alias("bar_count"),
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
    )
    return (
        s.withColumn("session_index", F.row_number().over(wn.over(key, day)))
        .withColumn("weekday", F.weekday(day))
        .withColumn("is_saturday", F.weekday(day) == 5)
    )


def weighted_histogram(df: DataFrame, key: str, order: str, value: str, bins: int, decay: float = 3.0) -> DataFrame:
    """Per key equal-width bins of a value, rows weighted exp(-decay) for the oldest to 1 for the newest."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    i = F.row_number().over(wn.over(key, order)) - 1
    lo, hi = (f(value).over(W.partitionBy(key)) for f in (F.min, F.max))
    df = df.withColumn("_w", F.exp(-decay + decay * F.try_divide(i, n - 1))).withColumn("_lo", lo).withColumn("_hi", hi)
    place = F.least(F.floor(F.try_divide((F.col(value) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    return df.withColumn("bin", place.cast("int")).groupBy(key, "bin").agg(
        F.sum("_w").alias("weight"), F.count(F.lit(1)).alias("n"), F.first("_lo").alias("low"), F.first("_hi").alias("high")
    )
