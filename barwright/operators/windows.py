"""Window analytics over a key and an order: returns, rolling and expanding statistics, runs, fills."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def over(keys, order, start=None, end=0):
    w = W.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*([order] if isinstance(order, str) else order))
    return w if start is None else w.rowsBetween(start, end)


def diff(c: str, w) -> Column:
    return F.col(c) - F.lag(c).over(w)


def pct_change(c: str, w) -> Column:
    return F.try_divide(F.col(c), F.lag(c).over(w)) - 1


def log_return(c: str, w) -> Column:
    return F.ln(F.col(c) / F.lag(c).over(w))


def gated(value: Column, count: Column, at_least: int) -> Column:
    """Null until the frame has enough values that aren't null."""
    return F.when(count >= at_least, value)


def rolling(fn, c: str, keys, order, n: int, min_periods: int | None = None, lag: int = 0) -> Column:
    """fn over the last n rows, the current one included unless lag says otherwise."""
    w = over(keys, order, -(n - 1) - lag, -lag)
    return gated(fn(c).over(w), F.count(c).over(w), n if min_periods is None else min_periods)


def zscore(c: str, keys, order, n: int, min_periods: int, past_only: bool = True) -> Column:
    """Distance from the mean of n rows in population deviations; null where these are 0."""
    lag = 1 if past_only else 0
    m = rolling(F.avg, c, keys, order, n, min_periods, lag)
    s = rolling(F.stddev_pop, c, keys, order, n, min_periods, lag)
    return F.when(s > 0, (F.col(c) - m) / s)


def expanding(fn, c: str, keys, order, min_history: int, include_current: bool = False, lag: int = 0) -> Column:
    w = over(keys, order, W.unboundedPreceding, (0 if include_current else -1) - lag)
    return gated(fn(c).over(w), F.count(c).over(w), min_history)


def with_expanding_quantile(df: DataFrame, name: str, c: str, q: float, keys: list[str], order: str, min_history: int, lag: int = 0) -> DataFrame:
    """df with the interpolated quantile of all rows of the key before this one (and before ``lag`` more);
    null values don't count, and below min_history of them there is none. See orderstats: no task holds a key.
    """
    from barwright.operators.orderstats import with_past_quantile

    return with_past_quantile(df, name, c, q, keys, order, max(min_history, 1), lag)


def true_range(keys, order) -> Column:
    prior = F.lag("close").over(over(keys, order))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))


def with_atr(bars: DataFrame, keys, order, n: int = 14, min_periods: int = 5) -> DataFrame:
    return bars.withColumn("tr", true_range(keys, order)).withColumn("atr", rolling(F.avg, "tr", keys, order, n, min_periods))


def crossed(a: str, b: str, keys, order) -> Column:
    """'up' where a comes to lie above b, 'down' where it comes to lie below; else null."""
    gap = F.col(a) - F.col(b)
    before = F.lag(F.col(a) - F.col(b)).over(over(keys, order))
    return F.when((gap > 0) & (before <= 0), "up").when((gap < 0) & (before >= 0), "down")


def forward_return(c: str, keys, order, n: int = 1) -> Column:
    return F.try_divide(F.lead(c, n).over(over(keys, order)), F.col(c)) - 1


def inside_previous(keys, order) -> Column:
    w = over(keys, order)
    return F.coalesce((F.col("high") <= F.lag("high").over(w)) & (F.col("low") >= F.lag("low").over(w)), F.lit(False))


def local_extremum(c: str, keys, order) -> Column:
    """1 at strict local maxima, -1 at strict local minima, else 0."""
    w = over(keys, order)
    a, b = F.lag(c).over(w), F.lead(c).over(w)
    top, low = (F.col(c) > a) & (F.col(c) > b), (F.col(c) < a) & (F.col(c) < b)
    return F.when(top, 1).when(low, -1).otherwise(0)


def centred_mean(c: str, keys, order, n: int) -> Column:
    k = n // 2
    return F.avg(c).over(over(keys, order, -k, k))


def regular_grid(df: DataFrame, key: str, ts: str, every: str, values: list[str]) -> DataFrame:
    """One row per key and boundary from the first to the last bucket, values carried forward."""
    from barwright.operators.bars import bucket_end
    from barwright.operators.blocked import filled

    b = df.withColumn("grid", bucket_end(ts, every))
    last = b.groupBy(key, "grid").agg(*(F.max_by(v, ts).alias(v) for v in values))
    spans = last.groupBy(key).agg(F.min("grid").alias("_a"), F.max("grid").alias("_b"))
    grid = spans.select(key, F.explode(F.expr(f"sequence(_a, _b, interval {every})")).alias("grid"))
    full = grid.join(last, [key, "grid"], "left")
    return filled(full, values, [key], ["grid"]).select(key, "grid", *values)


def overlaps(df: DataFrame, keys, start: str, end: str) -> Column:
    """Whether a validity window begins before an earlier one of its key has ended."""
    before = F.max(F.coalesce(F.col(end), F.to_date(F.lit("9999-12-31")))).over(over(keys, start, W.unboundedPreceding, -1))
    return F.coalesce(before >= F.col(start), F.lit(False))


def lead_lag(df: DataFrame, a: str, b: str, order: str, lags: range, min_n: int = 10, block: int = 4096) -> DataFrame:
    """Per lag k the correlation of a with b k rows later, its n and t statistic; null below min_n.

    Rows are numbered by a blocked scan and cut into blocks of numbers. A block's task gets its own rows' a and, of
    the neighbours too, the b that its lags reach; it adds up products for all lags at once, so what is shuffled is
    rows, twice, and a few sums per block and lag. Pairs with a null on either side don't count.
    """
    from barwright.operators.blocked import scan

    low, high, shift = min(lags), max(lags), df.agg(F.avg(a), F.avg(b)).first()
    size = max(block, high - low + 1)
    rows = scan(df.select(order, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")), [], [order], {"_i": ("row", None)})
    left = rows.where("_a is not null").select(F.floor(F.col("_i") / size).alias("_at"), F.col("_i").alias("_k"), (F.col("_a") - F.lit(shift[0])).alias("_x"))
    blocks = F.sequence(F.floor((F.col("_i") - high) / size), F.floor((F.col("_i") - low) / size))
    right = rows.where("_b is not null").select(F.explode(blocks).alias("_to"), F.col("_i").alias("_j"), (F.col("_b") - F.lit(shift[1])).alias("_y"))
    steps = np.array(list(lags))

    def sums(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(theirs):
            start = int(mine["_k"].min()) + low
            wide = np.full(int(mine["_k"].max()) + high - start + 1, np.nan)
            at = theirs["_j"].to_numpy() - start
            inside = (at >= 0) & (at < len(wide))
            wide[at[inside]] = theirs["_y"].to_numpy()[inside]
            i, x = mine["_k"].to_numpy() - start, mine["_x"].to_numpy()
            for k in steps:
                y = wide[i + k]
                met = ~np.isnan(y)
                u, v = x[met], y[met]
                out.append((int(k), int(met.sum()), u.sum(), v.sum(), (u * u).sum(), (v * v).sum(), (u * v).sum()))
        return pd.DataFrame(out, columns=["lag", "n", "x", "y", "xx", "yy", "xy"])

    met = left.groupBy("_at").cogroup(right.groupBy("_to")).applyInPandas(sums, "lag int, n long, x double, y double, xx double, yy double, xy double")
    got = met.groupBy("lag").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy"))).where("n > 0")
    n = F.col("n")
    spread = [F.greatest(n * F.col(f"{c}{c}") - F.col(c) * F.col(c), F.lit(0.0)) for c in "xy"]
    r = F.when(n >= min_n, F.try_divide(n * F.col("xy") - F.col("x") * F.col("y"), F.sqrt(spread[0]) * F.sqrt(spread[1])))
    return got.select("lag", "n", r.alias("corr")).withColumn("t_stat", F.col("corr") * F.sqrt(F.try_divide(n - 2, 1 - F.col("corr") * F.col("corr"))))
