"""Exponential averages as a blocked scan.

y_t = a x_t + (1 - a) y_{t-1} is affine in y_{t-1}, so a block of rows maps its entry value y to
(1 - a)^n y + b. Blocks are cut by time, a day or a month of a key, so no rows need to be numbered; each
block's b is folded in parallel, the blocks of a key are chained by their summaries alone, a few numbers
each, and then expanded in parallel, all blocks of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def time_block(order: str, kind: str) -> Column:
    """The block of a row: its month for dates, its day for timestamps, else a thousand steps."""
    if kind == "date":
        return F.date_trunc("month", order).cast("long")
    if kind.startswith("timestamp"):
        return F.datediff(order, F.lit("1970-01-01")).cast("long")
    return F.floor(F.col(order) / 1000).cast("long")


def _padded(xs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The lists as rows of one matrix, filled up with NaN, and their lengths."""
    size = np.array([len(x) for x in xs])
    out = np.full((len(xs), size.max() if len(size) else 0), np.nan)
    for k, x in enumerate(xs):
        out[k, : size[k]] = x
    return out, size


def _run(x: np.ndarray, y: np.ndarray, a: float) -> np.ndarray:
    """The averages of every row of x, entered with y; NaN carries the average on."""
    out = np.empty_like(x)
    for k in range(x.shape[1]):
        # an average of equal values is that value, exactly
        y = np.where(np.isnan(x[:, k]) | (x[:, k] == y), y, a * x[:, k] + (1 - a) * y)
        out[:, k] = y
    return out


def _fold(rates: list[float]):
    """Of each block and rate the average at its end when entered with 0."""
    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        x, _ = _padded(xs)
        ends = [_run(x, np.zeros(len(x)), a)[:, -1] if x.size else np.zeros(len(x)) for a in rates]
        return pd.Series(list(np.array(ends).T))

    return run


def _entries(rates: list[float]):
    """Per key and block the entry values, from the blocks' maps in order."""
    @F.pandas_udf("array<array<double>>")
    def run(live: pd.Series, ends: pd.Series, seed: pd.Series) -> pd.Series:
        keep, out = 1 - np.array(rates), []
        for n, b, y in zip(live, ends, seed):
            at, y = [], np.full(len(rates), y, dtype=float)
            for k in range(len(n)):
                at.append(y)
                y = keep ** n[k] * y + b[k]
            out.append(at)
        return pd.Series(out)

    return run


def _expand(rates: list[float]):
    """Of each block and rate the averages of its rows."""
    @F.pandas_udf("array<array<double>>")
    def run(xs: pd.Series, entry: pd.Series) -> pd.Series:
        x, size = _padded(xs)
        at = np.array(entry.tolist(), dtype=float).reshape(len(x), len(rates))
        ys = [_run(x, at[:, k], a) for k, a in enumerate(rates)]
        return pd.Series([[y[i, :n] for y in ys] for i, n in enumerate(size)])

    return run


def with_ema(df: DataFrame, keys: list[str], order: list[str], column: str, spans: dict[str, int], block: Column | None = None) -> DataFrame:
    """df with one column per name in spans: the average of that span, seeded with the first value.

    Rows whose value is null keep the average before them; a key's leading nulls are treated as its first
    value, and a key of nulls alone has no average. ``block`` must not decrease with the order (see
    time_block); a task holds one block's rows, and one key's summaries of blocks.
    """
    block = time_block(order[0], dict(df.dtypes)[order[0]]) if block is None else block
    key = F.struct(*keys).alias("_key") if keys else F.lit(0).alias("_key")
    row = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.struct(*df.columns).alias("r"))
    rows = df.groupBy(key, block.alias("_block")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    rows = rows.withColumn("_x", F.transform("_rows", lambda r: r["r"][column].cast("double")))
    live = F.filter("_x", lambda x: x.isNotNull() & ~F.isnan(x))
    rates = [2.0 / (n + 1) for n in spans.values()]
    steps = [F.col("_block").alias("block"), F.get(live, F.lit(0)).alias("first"), F.size(live).alias("n"), _fold(rates)("_x").alias("b")]
    few = rows.select("_key", *steps).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("block", "first", "n", "b"))).alias("s"))
    seed = F.get(F.filter(F.transform("s", lambda s: s["first"]), lambda x: x.isNotNull()), F.lit(0))
    entries = _entries(rates)(F.transform("s", lambda s: s["n"]), F.transform("s", lambda s: s["b"]), seed).alias("e")
    chained = few.select("_key", F.transform("s", lambda s: s["block"]).alias("block"), entries)
    at = chained.select(F.col("_key").alias("_own"), F.explode(F.arrays_zip("block", "e")).alias("z")).select("_own", F.col("z.block").alias("_at"), F.col("z.e").alias("e"))
    met = rows.join(at, rows["_key"].eqNullSafe(at["_own"]) & (rows["_block"] == at["_at"]))
    ys = met.select("_rows", _expand(rates)("_x", "e").alias("ys"))
    zipped = ys.select(F.explode(F.arrays_zip("_rows", *(F.col("ys")[k].alias(f"y{k}") for k in range(len(rates))))).alias("z"))
    value = [F.when(~F.isnan(f"z.y{k}"), F.col(f"z.y{k}")).alias(n) for k, n in enumerate(spans)]
    return zipped.select(*(F.col(f"z._rows.r.{c}").alias(c) for c in df.columns), *value)


def with_states(df: DataFrame, keys: list[str], order: list[str], column: str, name: str, states: list[int], start: int, step) -> DataFrame:
    """df with ``name``, the state after each row: step(states, values) of the state before and the row's value.

    States are few, so a block of rows is a map from each of them to one: all blocks' maps are made side by side,
    a key's maps are chained from ``start``, and all blocks run once more from the states they are entered with.
    ``step`` takes and returns arrays; rows whose value is null or NaN keep the state.
    """

    def folded(x: np.ndarray, p: np.ndarray, keep: bool) -> np.ndarray:
        every = []
        for k in range(x.shape[1]):
            p = np.where(np.isnan(x[:, k]), p, step(p, np.nan_to_num(x[:, k])))
            if keep:
                every.append(p)
        return np.stack(every, axis=1) if keep and every else p

    @F.pandas_udf("array<int>")
    def maps(xs: pd.Series) -> pd.Series:
        x, _ = _padded(xs)
        return pd.Series(list(np.stack([folded(x, np.full(len(x), p), False) for p in states], axis=1)))

    @F.pandas_udf("array<int>")
    def chained(all_maps: pd.Series) -> pd.Series:
        out, at = [], {p: k for k, p in enumerate(states)}
        for blocks in all_maps:
            p, entered = start, []
            for m in blocks:
                entered.append(p)
                p = int(m[at[p]])
            out.append(entered)
        return pd.Series(out)

    @F.pandas_udf("array<int>")
    def expanded(xs: pd.Series, entry: pd.Series) -> pd.Series:
        x, size = _padded(xs)
        p = folded(x, entry.to_numpy(), True)
        return pd.Series([p[i, :n] for i, n in enumerate(size)])

    block = time_block(order[0], dict(df.dtypes)[order[0]])
    row = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.struct(*df.columns).alias("r"))
    rows = df.groupBy(F.struct(*keys).alias("_key"), block.alias("_block")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    rows = rows.withColumn("_x", F.transform("_rows", lambda r: r["r"][column].cast("double")))
    few = rows.select("_key", F.struct(F.col("_block").alias("block"), maps("_x").alias("m")).alias("b")).groupBy("_key").agg(F.array_sort(F.collect_list("b")).alias("b"))
    entered = few.select(F.col("_key").alias("_of"), F.explode(F.arrays_zip(F.col("b.block").alias("at"), chained(F.col("b.m")).alias("p"))).alias("z"))
    met = rows.join(entered, (rows["_key"] == entered["_of"]) & (rows["_block"] == entered["z.at"]))
    zipped = met.select(F.explode(F.arrays_zip("_rows", expanded("_x", F.col("z.p")).alias("s"))).alias("z"))
    return zipped.select(*(F.col(f"z._rows.r.{c}").alias(c) for c in df.columns), F.col("z.s").alias(name))


def with_ew_stats(
    df: DataFrame, keys: list[str], order: list[str], column: str, span: int, min_periods: int, fallback: int | None = None
) -> DataFrame:
    """df with ew_mean, ew_std (unbiased) and ew_z of an exponential window seeded with the first value.

    The mean is an average of the values; the variance is the same average of (1 - a) (x - mean before)^2,
    from 0; its bias is made up for by the sum of squared weights, which after n values is
    q^n + a (1 - q^n) / (2 - a) with q = (1 - a)^2. All are null before min_periods values. Where there is
    no score and ``fallback`` is given, mean, deviation (population) and score of the last so many rows
    take their place, from 3 values on.
    """
    from barwright.operators import windows as wn
    from barwright.operators.blocked import scan

    a, q = 2.0 / (span + 1), (1 - 2.0 / (span + 1)) ** 2
    x = F.col(column)
    df = with_ema(df, keys, order, column, {"ew_mean": span})
    df = scan(df, keys, order, {"_n": ("count", column), "_was": ("lag", "ew_mean")}).withColumn("_z", (1 - a) * (x - F.col("_was")) ** 2).drop("_was")
    df = with_ema(df.withColumn("_z", F.when(x.isNotNull(), F.when(F.col("_n") == 1, 0.0).otherwise(F.col("_z")))), keys, order, "_z", {"_v": span})
    squares = F.pow(F.lit(q), F.col("_n") - 1) + a * (1 - F.pow(F.lit(q), F.col("_n") - 1)) / (2 - a)
    enough = F.col("_n") >= min_periods
    std = F.when(enough & (F.col("_n") > 1), F.sqrt(F.col("_v") / (1 - squares)))
    df = df.withColumn("_std", std).withColumn("_mean", F.when(enough, F.col("ew_mean")))
    df = df.withColumn("_score", F.when(F.col("_std") > 0, (x - F.col("_mean")) / F.col("_std")))
    mean, dev, score = (F.col(c) for c in ("_mean", "_std", "_score"))
    if fallback is not None:
        m, s = (wn.rolling(f, column, keys, order, fallback, 3) for f in (F.avg, F.stddev_pop))
        df = df.withColumn("_fm", m).withColumn("_fs", s)
        none = score.isNull()
        mean, dev = F.when(none, F.col("_fm")).otherwise(mean), F.when(none, F.col("_fs")).otherwise(dev)
        score = F.coalesce(score, F.when(F.col("_fs") > 0, (x - F.col("_fm")) / F.col("_fs")))
    return df.withColumns({"ew_mean": mean, "ew_std": dev, "ew_z": score}).drop("_n", "_z", "_v", "_std", "_mean", "_score", "_fm", "_fs")
