"""Running values over a key and an order as blocked scans: no task holds a key's rows.

Rows are cut into blocks of a key's time. Each block is summed up by itself, the summaries of a key, one row per
block, are chained in order, and every block then runs through its rows from the value at which it is entered.
Any associative summary can be scanned so: sums, extremes, counts, last values, neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barwright.operators.recurrence import time_block

#: Kinds of running values: of all rows of the key up to and with this one, nulls left out; "lag" is the value of
#: the row before, null or not, "row" the row's number from 1.
KINDS = ("sum", "count", "max", "min", "last", "lag", "row")


def scan(df: DataFrame, keys: list[str], order: list[str], running: dict[str, tuple[str, str | None]], block: Column | None = None) -> DataFrame:
    """df with one column per name in ``running``, each a (kind, column).

    ``block`` must not decrease with the order (see time_block); a task holds one block's rows, and one key's
    summaries. Rows of equal order have no order among themselves. Null keys are keys like others.
    """
    block = time_block(order[0], dict(df.dtypes)[order[0]]) if block is None else block
    cut = df.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("none"))).withColumn("_block", block)
    inside = W.partitionBy("_key", "_block").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("_key").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    place = F.struct(*order)
    summaries, entries, inner, whole = [], [], {}, []
    for name, (kind, c) in running.items():
        own, at = f"_in_{name}", f"_at_{name}"
        if kind in ("sum", "max", "min"):
            f = getattr(F, kind)
            inner[own], summary, entry = f(c).over(upto), f(c), f(own).over(before)
            value = F.when(F.col(at).isNull(), F.col(own)).when(F.col(own).isNull(), F.col(at))
            value = value.otherwise({"sum": F.col(at) + F.col(own), "max": F.greatest(at, own), "min": F.least(at, own)}[kind])
        elif kind == "count":
            inner[own], summary, entry = F.count(c).over(upto), F.count(c), F.sum(own).over(before)
            value = F.col(own) + F.coalesce(at, F.lit(0))
        elif kind == "row":
            inner[own], summary, entry = F.row_number().over(inside).cast("long"), F.count(F.lit(1)), F.sum(own).over(before)
            value = F.col(own) + F.coalesce(at, F.lit(0))
        elif kind == "last":
            inner[own] = F.last(c, ignorenulls=True).over(upto)
            summary, entry = F.max_by(c, F.when(F.col(c).isNotNull(), place)), F.last(own, ignorenulls=True).over(before)
            value = F.coalesce(own, at)
        elif kind == "lag":
            # boxed, so that a null that stands there differs from no row before
            inner[own] = F.lag(F.struct(c)).over(inside)
            summary, entry = F.max_by(F.struct(c), place), F.last(own, ignorenulls=True).over(before)
            value = F.coalesce(own, at)[c]
        else:
            raise ValueError(f"no such kind: {kind}")
        summaries.append(summary.alias(own))
        entries.append(entry.alias(at))
        whole.append(value.alias(name))
    few = cut.groupBy("_key", "_block").agg(*summaries).select(F.col("_key").alias("_of"), F.col("_block").alias("_to"), *entries)
    rows = cut.withColumns(inner)
    met = rows.join(few, (rows["_key"] == few["_of"]) & (rows["_block"] == few["_to"]))
    kept = [F.col(c) for c in df.columns if c not in running]
    return met.select(*kept, *whole)


def drawdown(df: DataFrame, pnl: str, keys: list[str], order: list[str]) -> DataFrame:
    """df with running equity, its peak, and the drawdown from it (0 or negative)."""
    df = scan(df, keys, order, {"equity": ("sum", pnl)})
    return scan(df, keys, order, {"peak": ("max", "equity")}).withColumn("drawdown", F.col("equity") - F.col("peak"))


def filled(df: DataFrame, columns: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """df with nulls of the columns filled by the last value before them."""
    out = scan(df, keys, order, {f"_f_{c}": ("last", c) for c in columns})
    return out.withColumns({c: F.col(f"_f_{c}") for c in columns}).drop(*(f"_f_{c}" for c in columns))


def held(df: DataFrame, name: str, c: str, keys: list[str], order: list[str]) -> DataFrame:
    """df with ``name``: c where it isn't 0 or null, else the last such value; 0 at the start."""
    df = scan(df.withColumn("_h", F.when(F.col(c) != 0, F.col(c))), keys, order, {name: ("last", "_h")})
    return df.withColumn(name, F.coalesce(name, F.lit(0))).drop("_h")


def runs(df: DataFrame, label: str, keys: list[str], order: list[str]) -> DataFrame:
    """Runs of equal labels (nulls are equal): run_id (from 1), run_pos (from 1), run_len, place (single, start,
    mid, end). A run is known by its first row's number and its length, counted before anything is shuffled."""
    at = scan(df, keys, order, {"_row": ("row", None), "_was": ("lag", label)})
    changed = F.when((F.col("_row") > 1) & F.col(label).eqNullSafe(F.col("_was")), 0).otherwise(1)
    at = scan(at.withColumn("_c", changed), keys, order, {"run_id": ("sum", "_c")}).withColumn("_key", F.struct(*keys))
    whole = at.groupBy(F.col("_key").alias("_of"), F.col("run_id").alias("_id")).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("run_len"))
    met = at.join(whole, (at["_key"] == whole["_of"]) & (at["run_id"] == whole["_id"])).withColumn("run_pos", (F.col("_row") - F.col("_first") + 1).cast("int"))
    place = (
        F.when(F.col("run_len") == 1, "single").when(F.col("run_pos") == 1, "start")
        .when(F.col("run_pos") == F.col("run_len"), "end").otherwise("mid")
    )
    return met.select(*(c for c in df.columns), "run_id", "run_pos", "run_len", place.alias("place"))
