"""Event packages over grids of parameters, and pipelines of registered builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barwright.operators import windows as wn


def _cuts(days: DataFrame, key: str, day: str, qs: list[float], least: int) -> DataFrame:
    """days with range and cut_0, cut_1, ...: the quantiles of all earlier ranges."""
    df = days.withColumn("range", F.col("high") - F.col("low"))
    for k, q in enumerate(qs):
        df = wn.with_expanding_quantile(df, f"cut_{k}", "range", q, [key], day, least)
    return df


def downside_events(days: DataFrame, key: str, day: str, qs: list[float], locations: list[float], least: int) -> DataFrame:
    """One row per day with a next day and per (q, loc) of the grid: hit says whether its range exceeds the
    quantile of the ranges before and it closes in the lowest part ``loc`` of its range."""
    df = _cuts(days, key, day, qs, least).withColumn("next_1", wn.forward_return("close", key, day))
    df = df.where("next_1 is not null").withColumn("_c", F.try_divide(F.col("close") - F.col("low"), F.col("range")))
    grid = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.lit(x).alias("loc"), F.col(f"cut_{k}").alias("cut")) for k, q in enumerate(qs) for x in locations)))
    long = df.select(key, day, "range", "next_1", "_c", grid.alias("g")).select(key, day, "range", "next_1", "_c", "g.*")
    return long.withColumn("hit", F.coalesce((F.col("range") > F.col("cut")) & (F.col("_c") <= F.col("loc")), F.lit(False))).drop("_c")


def downside_fragility(days: DataFrame, key: str, day: str, qs: list[float], locations: list[float], least: int) -> DataFrame:
    """Per key and (q, loc): events, the next day's mean and median return, how often it fell, and that
    against all days. One pass over the grid's rows."""
    e = downside_events(days, key, day, qs, locations, least)
    fell, hit = (F.col("next_1") < 0).cast("double"), F.col("hit")
    out = e.groupBy(key, "q", "loc").agg(
        F.sum(hit.cast("long")).alias("n"), F.avg(F.when(hit, F.col("next_1"))).alias("mean_next"), F.median(F.when(hit, F.col("next_1"))).alias("median_next"),
        F.avg(F.when(hit, fell)).alias("down_rate"), F.avg(fell).alias("base_rate"),
    )
    return out.where("n > 0").withColumn("lift", F.try_divide("down_rate", "base_rate"))


def dependence(events: DataFrame, key: str, day: str, apart: int) -> DataFrame:
    """Per key how far its hits hang together: clusters of hits at most ``apart`` rows from the one before,
    the largest one's share, and the share of the year with most."""
    w = W.partitionBy(key).orderBy(day)
    hits = events.withColumn("_i", F.row_number().over(w)).where("hit")
    new = F.when(F.col("_i") - F.lag("_i").over(w) <= apart, 0).otherwise(1)
    named = hits.withColumn("_new", new).withColumn("_cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    clusters = named.groupBy(key, "_cluster").agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg(
        F.sum("_n").alias("events"), F.count(F.lit(1)).alias("clusters"), F.max("_n").alias("largest_cluster")
    )
    years = hits.groupBy(key, F.year(day).alias("_y")).agg(F.count(F.lit(1)).alias("_n")).groupBy(key).agg(F.max("_n").alias("_top"))
    met = clusters.join(years, key)
    return met.select(key, "events", "clusters", "largest_cluster", (F.col("largest_cluster") / F.col("events")).alias("largest_share"), (F.col("_top") / F.col("events")).alias("top_year_share"))


def breakout_fragility(days: DataFrame, key: str, day: str, qs: list[float], squeezes: list[float], least: int) -> DataFrame:
    """Per (q, squeeze) and side: days whose range exceeds the quantile of the ranges before, followed by
    one of less than ``squeeze`` of it, followed by a break of that one. The break is filled at the level,
    or at the open where that lies beyond it, and left at the close."""
    w = wn.over(key, day)
    df = _cuts(days, key, day, qs, least)
    ahead = [("high", 1), ("low", 1), ("range", 1), ("high", 2), ("low", 2), ("open", 2), ("close", 2)]
    df = df.withColumns({f"{c}{k}": F.lead(c, k).over(w) for c, k in ahead})
    grid = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.lit(s).alias("squeeze"), F.col(f"cut_{k}").alias("cut")) for k, q in enumerate(qs) for s in squeezes)))
    long = df.select("range", *(f"{c}{k}" for c, k in ahead), grid.alias("g")).select("*", "g.*")
    long = long.where((F.col("range") > F.col("cut")) & (F.col("range1") < F.col("squeeze") * F.col("range")) & F.col("close2").isNotNull())
    up, down = F.col("high2") > F.col("high1"), F.col("low2") < F.col("low1")
    side = F.when(up & down, "both").when(up, "up").when(down, "down").otherwise("none")
    result = F.when(side == "up", F.col("close2") - F.greatest("high1", "open2")).when(side == "down", F.least("low1", "open2") - F.col("close2"))
    long = long.withColumn("side", side).withColumn("_r", result)
    return long.groupBy("q", "squeeze", "side").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_r").alias("mean_result"), F.median("_r").alias("median_result"), F.avg((F.col("_r") > 0).cast("double")).alias("win_rate")
    )


def built(bars: DataFrame, keys: list[str], order: str, features: dict[str, Callable[[], Column]], signal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """bars with a caller's features, the signal that its builder adds (-1, 0 or 1), and the position, the
    signal of the bar before. A builder that adds no signal, or other values, stops the run."""
    from barwright.operators.quality import CheckFailed

    df = signal(bars.withColumns({name: make() for name, make in features.items()}))
    if "signal" not in df.columns:
        raise CheckFailed("builder_added_no_signal")
    checked = F.when(F.col("signal").isin(-1, 0, 1), F.col("signal")).otherwise(F.raise_error(F.lit("signal_outside_domain")).cast("int"))
    df = df.withColumn("signal", checked.cast("int"))
    return df.withColumn("position", F.coalesce(F.lag("signal").over(wn.over(keys, order)), F.lit(0)))
