"""Comparisons of distributions: rank statistics, lifts, buckets, transition tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from barwright.operators.selection import quantiles


def long_form(df: DataFrame, keep: list[str], metrics: list[str]) -> DataFrame:
    """(keep, metric, value), one row per metric whose value isn't null."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.metric", "p.value").where("value is not null")


def compare_groups(df: DataFrame, group: str, a, b, metrics: list[str], by: list[str] = ()) -> DataFrame:
    """Per metric the groups' sizes and medians, Cliff's delta, and the parts of a rank test.

    Equal values are counted first, so the ranking window runs over distinct values, and no pair of rows
    is ever formed: delta = 2 U / (n m) - 1 with average ranks.
    """
    keys = [*by, "metric"]
    rows = long_form(df.where(F.col(group).isin(a, b)), [*by, group], metrics)
    halves = quantiles(rows, "value", [0.5], [*keys, group])
    medians = halves.groupBy(*keys).agg(*(F.max(F.when(F.col(group) == x, F.col("q")[0])).alias(n) for x, n in ((a, "median_a"), (b, "median_b"))))
    per = rows.groupBy(*keys, "value").agg(
        F.sum((F.col(group) == a).cast("long")).alias("na"), F.sum((F.col(group) == b).cast("long")).alias("nb")
    )
    below = W.partitionBy(*keys).orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    ranked = per.withColumn("before", F.coalesce(F.sum(F.col("na") + F.col("nb")).over(below), F.lit(0)))
    t = F.col("na") + F.col("nb")
    stats = ranked.groupBy(*keys).agg(
        F.sum("na").alias("n_a"),
        F.sum("nb").alias("n_b"),
        F.sum(F.col("na") * (F.col("before") + (t + 1) / 2)).alias("rank_sum"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n, m = F.col("n_a"), F.col("n_b")
    u = F.col("rank_sum") - n * (n + 1) / 2
    return stats.withColumn("u", u).withColumn("cliffs_delta", F.try_divide(2 * u, n * m) - 1).join(medians, keys).select(
        *keys, "n_a", "n_b", "median_a", "median_b", "u", "ties", "cliffs_delta"
    )


def with_p_value(compared: DataFrame, at_least: int = 10) -> DataFrame:
    """Two-sided p of the rank test: normal, corrected for ties and continuity; null for small groups."""
    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))

    n, m = F.col("n_a"), F.col("n_b")
    total = n + m
    variance = n * m / 12.0 * (total + 1 - F.col("ties") / (total * (total - 1)))
    z = F.greatest(F.abs(F.col("u") - n * m / 2.0) - 0.5, F.lit(0.0)) / F.sqrt(variance)
    return compared.withColumn("p_value", F.when((n >= at_least) & (m >= at_least), tail(z)))


def lift_table(events: DataFrame, flags: list[str], good: str, period: str) -> DataFrame:
    """Per event and period: frequency, chance of a good day given the event, its lift over all days, and
    whether frequency is at least 10 % and lift above 1 in every period."""
    days = events.groupBy(period).agg(F.count(F.lit(1)).alias("days"), F.avg(F.col(good).cast("double")).alias("base"))
    rows = long_form(events, [period, good], flags).where("value = 1")
    per = rows.groupBy("metric", period).agg(F.count(F.lit(1)).alias("hits"), F.avg(F.col(good).cast("double")).alias("p_good"))
    table = per.join(F.broadcast(days), period).select(
        F.col("metric").alias("event"),
        period,
        "hits",
        (F.col("hits") / F.col("days")).alias("freq"),
        "p_good",
        F.try_divide("p_good", "base").alias("lift"),
    )
    good_one = (F.col("freq") >= 0.1) & (F.col("lift") > 1)
    return table.withColumn("passed", F.bool_and(F.coalesce(good_one, F.lit(False))).over(W.partitionBy("event")))


def quantile_edges(df: DataFrame, column: str, parts: int) -> DataFrame:
    """(edges): one row with the column's quantiles in equal steps, least and greatest included."""
    return quantiles(df, column, [k / parts for k in range(parts + 1)]).select(F.col("q").alias("edges"))


def quintiles(df: DataFrame, column: str, value: str, parts: int = 5) -> DataFrame:
    """Right-closed quantile buckets of a column with count, mean, median and sum of another."""
    edges = F.broadcast(quantile_edges(df, column, parts))  # one row
    inner = F.slice("edges", 2, parts - 1)
    bucket = F.size(F.filter(inner, lambda e: F.col(column) > e)) + 1
    rows = df.where(F.col(column).isNotNull()).join(edges).withColumn("bucket", bucket)
    medians = quantiles(rows, value, [0.5], ["bucket"]).select("bucket", F.col("q")[0].alias("median"))
    sums = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
    return sums.join(medians, "bucket", "left").select("bucket", "n", "mean", "median", "total")


def transitions(df: DataFrame, label: str, keys, order) -> DataFrame:
    """(label_from, label_to, n, p): how often each label follows another within a key."""
    from barwright.operators.windows import over

    nxt = F.lead(label).over(over(keys, order))
    pairs = df.select(F.col(label).alias("label_from"), nxt.alias("label_to")).where("label_to is not null")
    counts = pairs.groupBy("label_from", "label_to").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("label_from")))


def run_verdict(df: DataFrame, good: str, key: str, order: str, margin: float = 0.05) -> DataFrame:
    """Per key: the share of good rows, how often one follows its like, mean lengths of runs and those that
    independent rows would give, and a verdict: CLUSTERED where good rows follow good ones by ``margin``
    more than their share and runs are longer, ALTERNATING where they do so by that much less."""
    from barwright.operators.blocked import runs
    from barwright.operators.windows import over

    d = runs(df, good, [key], [order]).withColumn("_n", F.lead(good).over(over(key, order)))
    g, nxt = F.col(good), F.col("_n")
    run = F.when(F.col("run_pos") == 1, F.col("run_len"))
    out = d.groupBy(key).agg(
        F.avg(g.cast("double")).alias("p_good"), F.avg(F.when(g, nxt.cast("double"))).alias("p_good_good"), F.avg(F.when(~g, (~nxt).cast("double"))).alias("p_bad_bad"),
        F.avg(F.when(g, run)).alias("mean_good_run"), F.avg(F.when(~g, run)).alias("mean_bad_run"),
    )
    out = out.withColumn("iid_good_run", F.try_divide(F.lit(1.0), 1 - F.col("p_good"))).withColumn("iid_bad_run", F.try_divide(F.lit(1.0), F.col("p_good")))
    more = F.col("p_good_good") - F.col("p_good")
    verdict = F.when((more >= margin) & (F.col("mean_good_run") > F.col("iid_good_run")), "CLUSTERED").when(-more >= margin, "ALTERNATING").otherwise("IID_LIKE")
    return out.withColumn("verdict", verdict)


def beta_posterior(df: DataFrame, keys: list[str], hit: str, a: float, b: float, count: str = "n") -> DataFrame:
    """(k + a) / (n + a + b) per group."""
    k, n = F.sum(F.col(hit).cast("long")), F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias(count), k.alias("hits"), ((k + a) / (n + a + b)).alias("p"))


def concentration(df: DataFrame, part) -> DataFrame:
    """(part, n, share): each part's share of all rows."""
    counts = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total)).select("part", "n", (F.col("n") / F.col("all")).alias("share"))
