"""Quantiles of all earlier rows, offline: two levels of a tree over values, cut by time blocks.

A key's values are cut into ranges. Upper level: each time block knows how many earlier values every range holds,
and running through its rows tells, for each row, in which range its wanted rank lies and where within that range.
Lower level: each range runs through its own values and the questions sent to it, in time order. A task holds one
block of rows, or one range of values.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from barwright.operators.blocked import scan

#: Rows of a time block, and ranges of values of a key.
BLOCK, RANGES = 4096, 128


def with_past_quantile(
    df: DataFrame, name: str, c: str, q: float, keys: list[str], order: str, least: int, lag: int = 0, block: int = BLOCK, ranges: int = RANGES
) -> DataFrame:
    """df with ``name``, the interpolated quantile of c over the key's rows before this one and ``lag`` more; null
    where fewer than ``least`` of them have a value. Nulls and NaN are no values; null keys are keys like others.
    """
    x = F.col(c).cast("double")
    rows = scan(df, keys, [order], {"_i": ("row", None)}).withColumn("_key", F.struct(*keys))
    facts = rows.select("_key", "_i", F.when(~F.isnan(x), x).alias("_x"))
    cuts = facts.where("_x is not null").groupBy(F.col("_key").alias("_of")).agg(
        F.array_distinct(F.percentile_approx("_x", [k / ranges for k in range(1, ranges)], 4096)).alias("_cuts")
    )
    facts = facts.join(cuts, F.col("_key") == F.col("_of"), "left").select("_key", "_i", "_x", F.size(F.filter("_cuts", lambda v: v < F.col("_x"))).alias("_v"))
    values = facts.where("_x is not null").select("_key", F.col("_i").alias("_p"), F.floor(F.col("_i") / block).alias("_b"), "_v", "_x")
    # a row asks for what stands at its number less the lag, so it sees the values numbered below that
    asks = facts.select("_key", (F.col("_i") - lag).alias("_p"), F.floor((F.col("_i") - lag) / block).alias("_b"), "_i").where("_p > 0")
    counts = values.groupBy("_key", "_b", "_v").agg(F.count(F.lit(1)).alias("n"))
    # of each block that is asked or holds values the counts of all ranges before it
    blocks = asks.select("_key", "_b").union(values.select("_key", "_b")).distinct()
    arrays = counts.groupBy("_key", "_b").agg(F.map_from_entries(F.collect_list(F.struct("_v", "n"))).alias("m"))
    zero = F.array_repeat(F.lit(0).cast("long"), ranges)
    own = blocks.join(arrays.select(F.col("_key").alias("_of"), F.col("_b").alias("_to"), "m"), (F.col("_key") == F.col("_of")) & (F.col("_b") == F.col("_to")), "left")
    flat = own.select("_key", "_b", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(ranges - 1)), lambda v: F.coalesce(F.col("m")[v], F.lit(0)))).alias("v", "n"))
    before = W.partitionBy("_key", "v").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    flat = flat.withColumn("s", F.coalesce(F.sum("n").over(before), F.lit(0)))
    entry = flat.groupBy("_key", "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("v", "s"))), lambda e: e["s"]).alias("_counts"))
    both = values.select("_key", "_b", "_p", F.col("_v").cast("int").alias("_v"), F.lit(None).cast("long").alias("_i"), F.lit(None).cast("array<long>").alias("_counts")).unionByName(
        asks.select("_key", "_b", "_p", F.lit(None).cast("int").alias("_v"), "_i", F.lit(None).cast("array<long>").alias("_counts"))
    ).unionByName(entry.select("_key", "_b", F.lit(-1).cast("long").alias("_p"), F.lit(None).cast("int").alias("_v"), F.lit(None).cast("long").alias("_i"), F.coalesce("_counts", zero).alias("_counts")))
    both = both.withColumn("_g", F.xxhash64("_key")).select("_g", F.to_json("_key", {"ignoreNullFields": "false"}).alias("_k"), "_b", "_p", "_v", "_i", "_counts")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        """The questions of one block: the range of each of the two ranks, and the rank within it."""
        held = next(iter(pdf["_counts"].dropna()), None)
        counts = np.zeros(ranges, np.int64) if held is None else np.array(held, dtype=np.int64)
        rest, out = pdf[pdf["_counts"].isna()], []
        asked = rest["_i"].notna().to_numpy()
        # at one number the question comes first: it sees what lies below
        at = np.lexsort((~asked, rest["_p"].to_numpy()))
        number, value = rest["_i"].to_numpy(), rest["_v"].to_numpy()
        for j in at:
            if not asked[j]:
                counts[int(value[j])] += 1
                continue
            upto = counts.cumsum()
            n = int(upto[-1])
            if n < least:
                continue
            rank = q * (n - 1)
            for side, r in ((0, int(rank)), (1, min(int(rank) + 1, n - 1))):
                v = int(np.searchsorted(upto, r, side="right"))
                out.append((pdf["_k"].iloc[0], int(number[j]), int(rest["_p"].iloc[j]), v, r - int(upto[v - 1] if v else 0), side, rank - int(rank)))
        return pd.DataFrame(out, columns=["_k", "_i", "_p", "_v", "_r", "_side", "_part"])

    asked = both.groupBy("_g", "_k", "_b").applyInPandas(place, "_k string, _i long, _p long, _v int, _r long, _side int, _part double")
    told = values.select(F.to_json("_key", {"ignoreNullFields": "false"}).alias("_k"), F.col("_v").cast("int").alias("_v"), "_p", "_x")
    lower = told.select("_k", "_v", "_p", "_x", *(F.lit(None).cast(t).alias(n) for n, t in (("_i", "long"), ("_r", "long"), ("_side", "int"), ("_part", "double")))).unionByName(
        asked.select("_k", "_v", "_p", F.lit(None).cast("double").alias("_x"), "_i", "_r", "_side", "_part")
    )

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        """The values of one range, and what was asked of it, in time order."""
        ask = pdf["_i"].notna().to_numpy()
        at, held, out = np.lexsort((~ask, pdf["_p"].to_numpy())), [], []
        x, i, r, side, part = (pdf[n].to_numpy() for n in ("_x", "_i", "_r", "_side", "_part"))
        for j in at:
            if ask[j]:
                out.append((pdf["_k"].iloc[0], int(i[j]), int(side[j]), held[int(r[j])], float(part[j])))
            else:
                insort(held, x[j])
        return pd.DataFrame(out, columns=["_k", "_i", "_side", "_x", "_part"])

    found = lower.groupBy("_k", "_v").applyInPandas(answer, "_k string, _i long, _side int, _x double, _part double")
    low, high = (F.max(F.when(F.col("_side") == k, F.col("_x"))) for k in (0, 1))
    per = found.groupBy(F.col("_k").alias("_of"), F.col("_i").alias("_at")).agg(low.alias("_low"), high.alias("_high"), F.max("_part").alias("_part"))
    met = rows.withColumn("_k", F.to_json("_key", {"ignoreNullFields": "false"})).join(per, (F.col("_k") == F.col("_of")) & (F.col("_i") == F.col("_at")), "left")
    return met.select(*df.columns, (F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))).alias(name))
