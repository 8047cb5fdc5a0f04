"""Incremental bars and positions with Structured Streaming: the batch operators' twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def tick_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Ticks from files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(ticks: DataFrame, late: str, ids=("trade_id",)) -> DataFrame:
    """Each trade once, as long as its repeats come within the watermark."""
    return ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(list(ids))


def stream_bars(ticks: DataFrame, every: str, late: str, key: str = "instrument", ids: tuple[str, ...] = ()) -> DataFrame:
    """Right-closed bars. In update mode they are partial, in append mode final once the watermark has
    passed; rows later than the watermark are dropped, and rows that repeat ids within it count once."""
    at = F.struct("ts", "trade_id")
    kind = dict(ticks.dtypes)["ts"]
    moved = ticks.withColumn("ts", (F.col("ts") - F.expr("interval 1 microsecond")).cast("timestamp"))  # closes the bucket on the right
    w = F.window("ts", every)
    moved = moved.withWatermark("ts", late)
    if ids:
        moved = moved.dropDuplicatesWithinWatermark(list(ids))
    return (
        moved.groupBy(key, w.alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("qty").alias("volume"),
            F.sum("turnover").alias("turnover"),
        )
        .select(key, F.col("w.end").cast(kind).alias("bar_end"), "open", "high", "low", "close", "volume", "turnover")
    )


def stream_means(quotes: DataFrame, every: str, late: str, key: str = "instrument") -> DataFrame:
    """Left-labelled means and last values of quotes."""
    kind = dict(quotes.dtypes)["ts"]
    return (
        quotes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(key, F.window("ts", every).alias("w"))
        .agg(F.avg("price").alias("price_mean"), F.max_by("price", "ts").alias("price_last"))
        .select(key, F.col("w.start").cast(kind).alias("bucket"), "price_mean", "price_last")
    )


POSITION_OUT = "instrument string, bar_end timestamp_ntz, close double, ema_fast double, ema_slow double, position int, pnl double, cum_pnl double"


class EmaPosition(StatefulProcessor):
    """Per instrument: both averages, bars seen, the position held and the target pending for the next bar.

    A target set at one close is taken at the next close; half the round trip's commission is paid for
    entering or leaving, all of it for a reversal. Bars at or before the last one seen are ignored.
    """

    def __init__(self, fast: int, slow: int, warm_up: int, round_trip: float):
        self.fast, self.slow, self.warm_up, self.round_trip = 2 / (fast + 1), 2 / (slow + 1), warm_up, round_trip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "position", "last timestamp_ntz, ema_fast double, ema_slow double, bars int, position int, target int, close double, cum_pnl double"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("bar_end")
        if self.state.exists():
            last, ef, es, seen, position, target, close, cum = self.state.get()
        else:
            last, ef, es, seen, position, target, close, cum = None, None, None, 0, 0, 0, None, 0.0
        out = []
        for end, c in zip(bars["bar_end"], bars["close"]):
            if last is not None and end <= pd.Timestamp(last):
                continue
            gained = position * (c - close) if close is not None else 0.0
            gained -= abs(target - position) * self.round_trip / 2
            position = target
            ef = c if ef is None else self.fast * c + (1 - self.fast) * ef
            es = c if es is None else self.slow * c + (1 - self.slow) * es
            seen += 1
            if seen >= self.warm_up:
                target = (ef > es) - (ef < es)
            last, close, cum = end, c, cum + gained
            out.append((key[0], end, c, ef, es, position, gained, cum))
        if out:
            self.state.update((pd.Timestamp(last).to_pydatetime(), ef, es, seen, int(position), int(target), close, cum))
        yield pd.DataFrame(out, columns=["instrument", "bar_end", "close", "ema_fast", "ema_slow", "position", "pnl", "cum_pnl"])

    def close(self) -> None:
        pass


def stream_positions(bars: DataFrame, fast: int = 5, slow: int = 12, warm_up: int = 12, round_trip: float = 0.1) -> DataFrame:
    """Positions and profit bar by bar; needs the RocksDB state store."""
    return bars.groupBy("instrument").transformWithStateInPandas(
        statefulProcessor=EmaPosition(fast, slow, warm_up, round_trip), outputStructType=POSITION_OUT, outputMode="Append", timeMode="None"
    )


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there now, and returns when it is written."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").option("path", target).trigger(availableNow=True).start().awaitTermination()


def last_versions(stream: DataFrame, keys: list[str], target: str, checkpoint: str) -> DataFrame:
    """Runs a stream of changing rows in update mode and returns each key's last version.

    Every batch keeps the rows that it changed, under its number; a batch that is run again replaces them.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    versions = stream.sparkSession.read.option("basePath", target).parquet(f"{target}/batch=*")
    rest = [c for c in stream.columns if c not in keys]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l"))
    return last.select(*keys, *(F.col(f"_l.{c}").alias(c) for c in rest))


class Smoothed(StatefulProcessor):
    """Per instrument the exponential average of the means that came so far, in the order of buckets."""

    def __init__(self, span: int):
        self.rate = 2 / (span + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("smoothed", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        means = pd.concat(list(rows)).sort_values("bucket")
        value = self.state.get()[0] if self.state.exists() else None
        out = []
        for x in means["price_mean"]:
            value = x if value is None else value + self.rate * (x - value)
            out.append(value)
        self.state.update((float(value),))
        yield means.assign(smooth=out)[["instrument", "bucket", "price_mean", "price_last", "smooth"]]

    def close(self) -> None:
        pass


def stream_smoothed(means: DataFrame, span: int) -> DataFrame:
    """means with their smoothed value; needs the RocksDB state store."""
    kind = dict(means.dtypes)["bucket"]
    return means.groupBy("instrument").transformWithStateInPandas(
        statefulProcessor=Smoothed(span), outputStructType=f"instrument string, bucket {kind}, price_mean double, price_last double, smooth double", outputMode="Append", timeMode="None"
    )


def pivot_each_batch(stream: DataFrame, group: str, groups: list[str], value: str, every: str, target: str, checkpoint: str) -> None:
    """Long rows accumulated day by day as wide buckets, one column per group: one row per bucket on each
    day's grid from its first to its last bucket, values carried forward within the day.

    Each batch stores its last value per bucket and group, then writes the days that it touches anew from
    all that is stored of them. ``target``/days is the table, ``target``/parts what is stored.
    """
    from barwright.operators.blocked import filled
    from barwright.operators.daily import pivot_last

    day, columns = F.to_date("bucket").alias("day"), [*groups, "total"]

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = batch.select(F.window("ts", every)["start"].alias("bucket"), F.col(group).alias("_g"), F.col("ts").alias("_at"), F.col(value).alias("_v"))
        last = last.groupBy("bucket", "_g").agg(F.max_by("_v", "_at").alias("_v"), F.max("_at").alias("_at")).select("*", day)
        # a batch that is run again replaces its own rows
        mine = f"{target}/parts/batch={batch_id}"
        last.write.mode("overwrite").partitionBy("day").parquet(mine)
        kinds = last.schema
        parts = spark.read.schema(kinds).parquet(f"{target}/parts")
        days = spark.read.schema(kinds).parquet(mine).select("day").distinct()
        parts = parts.join(F.broadcast(days), "day", "left_semi")
        wide = pivot_last(parts, ["day", "bucket"], "_g", groups, "_v", F.col("_at"))
        spans = wide.groupBy("day").agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_b"))
        grid = spans.select("day", F.explode(F.expr(f"sequence(_a, _b, interval {every})")).alias("bucket"))
        full = grid.join(wide, ["day", "bucket"], "left")
        full = filled(full, columns, ["day"], ["bucket"]).select("day", "bucket", *columns)
        full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{target}/days")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
