"""Trades that hold one position at a time, without a task that walks through a key's bars.

Every bar that could open a trade is followed to its exit on its own: bars are kept in blocks with their extremes,
so the first block that holds a hit is found among the blocks' extremes and the first bar within that block. Each
possible trade then points to the next one that may open after its exit, and following these pointers from a key's
first trade, twice as far in every round, picks the trades that are really taken. Parameters are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barwright.operators.blocked import scan
from barwright.sources.room import kept

#: Bars of a block.
BLOCK = 256


def _number(c: str) -> Column:
    """c as a double, NaN as null: a bar without a price hits nothing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def numbered(bars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """bars with _i, the bar's number in its key from 1, and _key, the keys as one value."""
    return scan(bars, keys, [order], {"_i": ("row", None)}).withColumn("_key", F.struct(*keys))


def _hit(x: Column, side: Column, stop: Column, goal: Column) -> Column:
    """Whether a bar, or the extremes of a block of bars, reach the stop or the goal of a long or short trade."""
    long = (x["low"] <= stop) | (x["up"] >= goal)
    short = (x["high"] >= stop) | (x["down"] <= goal)
    return F.coalesce(F.when(side > 0, long).otherwise(short), F.lit(False))


def with_exits(entries: DataFrame, bars: DataFrame, up: str, down: str, block: int = BLOCK) -> DataFrame:
    """entries (_key, _from, side, stop, goal and more) with _x, the number of the first bar from _from on that
    reaches the stop or the goal, and by_stop, whether it reaches the stop; both null without any, and _last, the
    number of the key's last bar. A long trade's stop is reached by the low, its goal by ``up``; a short one's by
    the high and ``down``. ``bars`` are numbered."""
    some = bars.select("_key", "_i", F.floor(F.col("_i") / block).alias("_b"), *(_number(c).alias(n) for c, n in (("low", "low"), ("high", "high"), (up, "up"), (down, "down"))))
    rows = some.groupBy("_key", "_b").agg(
        F.array_sort(F.collect_list(F.struct("_i", "low", "high", "up", "down"))).alias("_rows"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("up").alias("up"), F.min("down").alias("down"), F.max("_i").alias("_end"),
    )
    tops = rows.groupBy(F.col("_key").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("_b", "low", "high", "up", "down"))).alias("_tops"), F.max("_end").alias("_last"))
    blocks = rows.select(F.col("_key").alias("_of"), F.col("_b").alias("_to"), "_rows")
    side, stop, goal = (F.col(c) for c in ("side", "stop", "goal"))

    def first(found: str) -> Column:
        return F.get(F.filter("_rows", lambda x: (x["_i"] >= F.col("_from")) & _hit(x, side, stop, goal)), F.lit(0)).alias(found)

    names = entries.columns
    own = entries.withColumn("_b", F.floor(F.col("_from") / block))
    own = own.join(blocks, (F.col("_key") == F.col("_of")) & (F.col("_b") == F.col("_to")), "left").select(*names, "_b", first("_here"))
    own = own.join(tops, F.col("_key") == F.col("_of"))
    later = F.get(F.filter("_tops", lambda t: (t["_b"] > F.col("_b")) & _hit(t, side, stop, goal)), F.lit(0))["_b"]
    own = own.select(*names, "_last", "_here", F.when(F.col("_here").isNull(), later).alias("_b"))
    met = own.join(blocks, (F.col("_key") == F.col("_of")) & (F.col("_b") == F.col("_to")), "left").select(*names, "_last", F.coalesce("_here", first("_there")).alias("_at"))
    stopped = F.when(side > 0, F.col("_at.low") <= stop).otherwise(F.col("_at.high") >= stop)
    return met.select(*names, "_last", F.col("_at._i").alias("_x"), F.when(F.col("_at").isNotNull(), F.coalesce(stopped, F.lit(False))).alias("by_stop"))


def one_at_a_time(trades: DataFrame, by: list[str]) -> DataFrame:
    """Of possible trades (by, _e: where it opens, _x: where it closes, null if never) those that are taken: a
    group's first, then always the first that opens after the one before has closed.

    Pointers are followed twice as far in each round, so there are as many rounds as the logarithm of the longest
    chain of trades; each round's pointers are stored.
    """
    group = F.struct(*by).alias("_g")
    opens = trades.select(group, F.col("_e").alias("_p"), F.lit(0).alias("_ask"), F.col("_e").alias("_open"), F.lit(None).cast("long").alias("_e"))
    asks = trades.where("_x is not null").select(group, (F.col("_x") + 1).alias("_p"), F.lit(1).alias("_ask"), F.lit(None).cast("long").alias("_open"), "_e")
    both = opens.unionByName(asks).withColumn("_p", -F.col("_p"))
    met = scan(both, ["_g"], ["_p", "_ask"], {"_next": ("last", "_open")}, F.floor(F.col("_p") / 4096)).where("_ask = 1 and _next is not null")
    jump = kept(met.select("_g", "_e", "_next"))
    taken = kept(trades.groupBy(group).agg(F.min("_e").alias("_e")))
    while not jump.isEmpty():
        step = jump.select(F.col("_g").alias("_h"), F.col("_e").alias("_at"), F.col("_next").alias("_to"))
        on = (F.col("_g") == F.col("_h")) & (F.col("_e") == F.col("_at"))
        further = taken.join(step, on).select("_g", F.col("_to").alias("_e"))
        taken = kept(taken.unionByName(further).distinct())
        jump = kept(jump.join(step, (F.col("_g") == F.col("_h")) & (F.col("_next") == F.col("_at"))).select("_g", "_e", F.col("_to").alias("_next")))
    mine = trades.withColumn("_g", F.struct(*by))
    return mine.join(taken.select(F.col("_g").alias("_h"), F.col("_e").alias("_at")), (F.col("_g") == F.col("_h")) & (F.col("_e") == F.col("_at")), "left_semi").drop("_g")
