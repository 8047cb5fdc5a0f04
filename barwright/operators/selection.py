"""Exact quantiles by distributed selection: no group's values come together in one buffer or task.

Equal values are counted first. A mergeable sketch per group gives splitters that cut its values into ranges; the
ranges' exact counts, a few per group, say in which range each wanted rank lies. Only those ranges are ordered,
each in a task of its own, and the two neighbours of every rank are read from the running counts. The sketch
decides how even the ranges are, never the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Ranges that a group's values are cut into, and the accuracy of the sketch that cuts them.
RANGES, ACCURACY = 256, 4096


def quantiles(df: DataFrame, column: str, qs: list[float], by: list[str] = (), ranges: int = RANGES) -> DataFrame:
    """by, n (values), q (array of the quantiles, in the order of ``qs``): interpolated between the two values
    whose ranks enclose q * (n - 1), as percentile() does. Null values don't count, NaN is the greatest; a group
    without values isn't there. Null groups are groups like others.
    """
    by, x = list(by), F.col(column).cast("double")
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("none"))
    counts = df.where(F.col(column).isNotNull()).groupBy(key.alias("_key"), x.alias("_x")).agg(F.count(F.lit(1)).alias("_m"))
    cuts = [k / ranges for k in range(1, ranges)] or [0.5]
    # distinct values are sketched: a value that stands there often is one row, and fills a range by itself
    groups = counts.groupBy("_key").agg(F.percentile_approx("_x", cuts, ACCURACY).alias("_cuts"), F.sum("_m").alias("n"))
    cut = counts.join(groups.select(F.col("_key").alias("_of"), F.array_distinct("_cuts").alias("_cuts")), F.col("_key") == F.col("_of"))
    cut = cut.select("_key", "_x", "_m", F.size(F.filter("_cuts", lambda c: c < F.col("_x"))).alias("_range"))
    upto = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy("_key", "_range").agg(F.sum("_m").alias("_in")).withColumn("_from", F.coalesce(F.sum("_in").over(upto), F.lit(0)))
    sums = sums.join(groups.select(F.col("_key").alias("_of"), "n"), F.col("_key") == F.col("_of")).drop("_of")
    places = [F.lit(q) * (F.col("n") - 1) for q in qs]
    ranks = [f(p).cast("long") for p in places for f in (F.floor, F.ceil)]
    hit = F.lit(False)
    for r in ranks:
        hit = hit | ((r >= F.col("_from")) & (r < F.col("_from") + F.col("_in")))
    wanted = sums.where(hit).select(F.col("_key").alias("_of"), F.col("_range").alias("_at"), "_from", "n")
    some = cut.join(wanted, (F.col("_key") == F.col("_of")) & (F.col("_range") == F.col("_at")))
    run = W.partitionBy("_key", "_range").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    some = some.withColumn("_end", F.col("_from") + F.sum("_m").over(run))
    def value(r):
        return F.max(F.when((r < F.col("_end")) & (r >= F.col("_end") - F.col("_m")), F.col("_x")))

    found = some.groupBy("_key").agg(F.max("n").alias("n"), *(value(r).alias(f"_v{k}") for k, r in enumerate(ranks)))
    out = []
    for k, p in enumerate(places):
        low, high = F.col(f"_v{2 * k}"), F.col(f"_v{2 * k + 1}")
        out.append(F.when(low == high, low).otherwise(low + (p - F.floor(p)) * (high - low)))
    return found.select(*(F.col(f"_key.{c}").alias(c) for c in by), "n", F.array(*out).alias("q"))
