"""Bar-shaped views over the relational test tables, and the same views as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barwright.operators import bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trades: (instrument, ts, price, qty, turnover, trade_id, user_id)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"),
        "ts",
        F.col("value").alias("price"),
        F.lit(1).cast("long").alias("qty"),
        F.col("value").alias("turnover"),
        F.col("event_id").alias("trade_id"),
        "user_id",
    )


def event_bars(spark: SparkSession, sf_dir: str, every: str = "1 hour") -> DataFrame:
    return bars.ticks_to_bars(ticks(spark, sf_dir), every)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trades of six instruments, ordered within a day by order and line."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("instrument"),
        F.to_date("l_shipdate").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: instrument, trade_date, open, high, low, close, volume, n."""
    return (
        trades(spark, sf_dir)
        .groupBy("instrument", "trade_date")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("qty").alias("volume"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second feed: per order date the mean total price and the number of orders."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("trade_date"))
        .agg(F.avg("o_totalprice").alias("fx"), F.count(F.lit(1)).alias("orders"))
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days on which any instrument trades."""
    return trades(spark, sf_dir).select("trade_date").distinct()


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract per instrument and calendar quarter: secid, family, anchor (its last day)."""
    quarter = F.date_trunc("quarter", "trade_date").cast("date")
    return (
        trades(spark, sf_dir)
        .select(F.col("instrument").alias("family"), quarter.alias("start"))
        .distinct()
        .select(
            "family",
            F.concat_ws("_", "family", F.date_format("start", "yyyy"), F.quarter("start").cast("string")).alias("secid"),
            F.date_sub(F.add_months("start", 3), 1).alias("anchor"),
        )
    )


#: The same views for a SQL engine; each may use those named before it.
VIEWS = {
    "ticks": """select event_type as instrument, ts, value as price, 1 as qty, value as turnover,
        event_id as trade_id, user_id from events""",
    "bars_1h": """select instrument, time_bucket(interval '1 hour', ts - interval '1 microsecond') + interval '1 hour' as bar_end,
        arg_min(price, ts) as open, max(price) as high, min(price) as low, arg_max(price, ts) as close,
        count(*) as volume, sum(turnover) as turnover from ticks group by all""",
    "trades": """select l_returnflag || l_linestatus as instrument, cast(l_shipdate as date) as trade_date,
        l_extendedprice / l_quantity as price, l_quantity as qty,
        row_number() over (partition by l_returnflag, l_linestatus, l_shipdate
            order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as seq from lineitem""",
    "day_bars": """select instrument, trade_date, arg_min(price, seq) as open, max(price) as high, min(price) as low,
        arg_max(price, seq) as close, sum(qty) as volume, count(*) as n from trades group by all""",
    "order_days": """select cast(o_orderdate as date) as trade_date, avg(o_totalprice) as fx, count(*) as orders
        from orders group by all""",
    "sessions": "select distinct trade_date from trades",
    "contracts": """select family, family || '_' || year(start) || '_' || quarter(start) as secid,
        cast(start + interval 3 month - interval 1 day as date) as anchor
        from (select distinct instrument as family, cast(date_trunc('quarter', trade_date) as date) as start from trades)""",
}
_NEEDS = {
    "bars_1h": ["ticks"],
    "day_bars": ["trades"],
    "sessions": ["trades"],
    "contracts": ["trades"],
}


def sql(*parts: str, recursive: bool = False, **views: str) -> str:
    """A statement over the named views: sql("day_bars", "select ...", extra="select ...").

    A body that begins with a comma goes on with views of its own.
    """
    *names, body = parts
    needed: dict[str, str] = {}
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            needed[n] = VIEWS[n]
    needed |= views
    heads = ", ".join(f"{n if '(' in n else n} as ({q})" for n, q in needed.items())
    return f"with {'recursive ' if recursive else ''}{heads}{'' if body.startswith(',') else ' '}{body}" if needed else body
