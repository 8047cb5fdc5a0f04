"""Bars from ticks and bars: right-closed and right-labelled buckets, session buckets, last and mean values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

_UNITS = {"m": "minutes", "h": "hours", "d": "days"}


def duration(timeframe: str) -> str:
    """'15m', '4h', '1d' as an interval; others raise."""
    found = re.fullmatch(r"([1-9]\d*)([mhd])", timeframe)
    if not found:
        raise ValueError(f"unsupported_timeframe: {timeframe}")
    return f"{found[1]} {_UNITS[found[2]]}"


def bucket_end(ts: str | Column, every: str) -> Column:
    """The end of the right-closed bucket (end - every, end] that holds ts."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.window(ts - F.expr("interval 1 microsecond"), every)["end"]


def ceil_bucket(ts: str, every: str) -> Column:
    """The next boundary, or ts itself where it lies on one."""
    return bucket_end(ts, every)


def next_bucket(ts: str, every: str) -> Column:
    """The next boundary after ts, also where ts lies on one."""
    return F.window(ts, every)["end"]


def ticks_to_bars(ticks: DataFrame, every: str, key: str = "instrument", order=("ts", "trade_id")) -> DataFrame:
    """Right-closed, right-labelled OHLCV with turnover; turnover is null where all of it is."""
    at = F.struct(*order)
    return (
        ticks.groupBy(key, bucket_end("ts", every).alias("bar_end"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("qty").alias("volume"),
            F.sum("turnover").alias("turnover"),
        )
    )


def resample(bars: DataFrame, timeframe: str, key: str = "instrument", ts: str = "bar_end") -> DataFrame:
    """Coarser bars from finer ones; buckets without bars don't exist."""
    return (
        bars.groupBy(key, bucket_end(ts, duration(timeframe)).alias("bar_end"))
        .agg(
            F.min_by("open", ts).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", ts).alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("source_bars"),
        )
    )


def session_bucket(ts: Column, start: Column, end: Column, minutes: int) -> Column:
    """The end of the bucket anchored at the session's start and clipped at its end."""
    span = F.unix_timestamp(ts) - F.unix_timestamp(start)
    n = F.greatest(F.ceil(span / (minutes * 60)), F.lit(1))
    return F.least(F.timestamp_add("MINUTE", (n * minutes).cast("int"), start), end)


def last_in_bucket(df: DataFrame, every: str, columns: list[str], key: list[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Per left-labelled bucket and column the last value that isn't null."""
    at = F.struct(ts, tie) if tie else F.col(ts)
    lasts = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns]
    return df.groupBy(*key, F.window(ts, every)["start"].alias("bucket")).agg(*lasts)


def mean_in_bucket(df: DataFrame, every: str, means: list[str], lasts: list[str], key: list[str], ts: str = "ts") -> DataFrame:
    """Per left-labelled bucket means of some columns and the last values of others."""
    return df.groupBy(*key, F.window(ts, every)["start"].alias("bucket")).agg(
        *(F.avg(c).alias(f"{c}_mean") for c in means), *(F.max_by(c, ts).alias(f"{c}_last") for c in lasts)
    )


def continuous_days(bars: DataFrame, keys: list[str], order: str, contract: str, boundary: str) -> DataFrame:
    """One daily bar per key with the contracts in order of appearance and whether a roll lies inside.

    Each contract is summed up first, so what is gathered per key is its contracts, not its rows.
    """
    by_contract = bars.groupBy(*keys, F.col(contract).alias("_contract")).agg(
        F.min(order).alias("_first"),
        F.max(order).alias("_last"),
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("bar_count"),
        F.bool_or(boundary).alias("has_roll_boundary"),
    )
    lineage = F.transform(F.array_sort(F.collect_list(F.struct("_first", "_contract"))), lambda x: x["_contract"])
    return by_contract.groupBy(*keys).agg(
        F.min_by("open", "_first").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "_last").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("bar_count").alias("bar_count"),
        lineage.alias("source_contracts"),
        F.bool_or("has_roll_boundary").alias("has_roll_boundary"),
    )


def book_top(levels: DataFrame, snapshot: list[str], side: str, price: str, size: str, n: int) -> DataFrame:
    """Per snapshot the best bid and ask, depth of the top n levels of each side, spread and mid.

    side is 'B' or 'S'; bids rank by falling price, asks by rising.
    """
    from pyspark.sql import Window as W

    signed = F.when(F.col(side) == "B", -F.col(price)).otherwise(F.col(price))
    rank = F.row_number().over(W.partitionBy(*snapshot, side).orderBy(signed, F.desc(size)))
    top = levels.withColumn("_r", rank).where(F.col("_r") <= n)
    bid, ask = F.col(side) == "B", F.col(side) == "S"
    return (
        top.groupBy(*snapshot)
        .agg(
            F.max(F.when(bid, F.col(price))).alias("best_bid"),
            F.min(F.when(ask, F.col(price))).alias("best_ask"),
            F.sum(F.when(bid, F.col(size))).alias("bid_depth"),
            F.sum(F.when(ask, F.col(size))).alias("ask_depth"),
        )
        .withColumn("spread", F.col("best_ask") - F.col("best_bid"))
        .withColumn("mid", (F.col("best_ask") + F.col("best_bid")) / 2)
        .withColumn("rel_spread", F.try_divide("spread", "mid"))
    )
