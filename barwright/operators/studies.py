"""Studies built from the other operators: contexts, screens, sweeps, executions, and the lake's refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barwright.functions.scalar import band, logistic
from barwright.operators import blocked, events, signals, stats, windows as wn
from barwright.operators.selection import quantiles


def execute_signals(bars: DataFrame, sigs: DataFrame, keys: list[str], order: str, commission: float) -> DataFrame:
    """Positions from sparse signals (keys, decision time, desired_position): a decision takes effect on
    the bar after it and holds until the next; profit open to open.

    A decision at a time that isn't a bar's, or at the last bar, is returned by ``bad_decisions``.
    """
    w = wn.over(keys, order)
    s = sigs.select(*keys, F.col("decision_ts").alias(order), "desired_position")
    df = bars.join(s, [*keys, order], "left").withColumn("_d", F.lag("desired_position").over(w))
    held = F.last("_d", ignorenulls=True).over(wn.over(keys, order, W.unboundedPreceding, 0))
    df = df.withColumn("position", F.coalesce(held, F.lit(0))).drop("_d", "desired_position")
    return signals.open_to_open(df, keys, order, commission)


def bad_decisions(bars: DataFrame, sigs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Decisions that can't be executed, with the reason."""
    last = bars.groupBy(*keys).agg(F.max(order).alias("_last"))
    known = bars.select(*keys, F.col(order).alias("decision_ts"), F.lit(True).alias("_bar"))
    df = sigs.join(known, [*keys, "decision_ts"], "left").join(last, keys, "left")
    reason = F.when(F.col("_bar").isNull(), "decision_not_on_a_bar").when(F.col("decision_ts") >= F.col("_last"), "decision_on_last_bar")
    return df.withColumn("reason", reason).where("reason is not null").drop("_bar", "_last")


def pending_execution(df: DataFrame, keys: list[str], order: str, target: str, round_trip: float) -> DataFrame:
    """A target set at one close is taken at the next; each unit of change costs half a round trip."""
    w = wn.over(keys, order)
    out = df.withColumn("position", F.coalesce(F.lag(target).over(w), F.lit(0)))
    change = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0)))
    held = F.coalesce(F.lag("position").over(w), F.lit(0)) * F.coalesce(wn.diff("close", w), F.lit(0.0))
    out = out.withColumn("pnl", held - change * round_trip / 2)
    return out.withColumn("cum_pnl", F.sum("pnl").over(wn.over(keys, order, W.unboundedPreceding, 0)))


def always_in(df: DataFrame, keys: list[str], order: str, fast: str, slow: str) -> DataFrame:
    """Per key the profit of always holding the side of fast against slow: total, win rate of bars that
    moved, and mean over deviation."""
    w = wn.over(keys, order)
    side = df.withColumn("_s", F.signum(F.col(fast) - F.col(slow)))
    side = blocked.held(side, "_p", "_s", keys, [order])
    bar = side.withColumn("_r", F.lag("_p").over(w) * wn.diff("close", w))
    moved = F.col("_r") != 0
    return bar.groupBy(*keys).agg(
        F.count("_r").alias("bars"), F.sum("_r").alias("total"), F.avg(F.when(moved, (F.col("_r") > 0).cast("double"))).alias("win_rate"),
        F.try_divide(F.avg("_r"), F.stddev_samp("_r")).alias("sharpe"),
    )


def first_hit_exit(entries: DataFrame, bars: DataFrame, keys: list[str], entry_ts: str, order: str, hit: Column, within: int) -> DataFrame:
    """Each entry with the first later bar that meets its exit; entries may overlap."""
    from barwright.operators.joins import first_touch

    return first_touch(entries, bars, keys, entry_ts, order, hit, within)


def day_context(days: DataFrame, key: str, day: str, weights: dict[str, float], low: float, high: float, n: int = 20) -> DataFrame:
    """A score for each day from the session before it: volatility against its past and body ratio,
    through a logistic, as adverse, neutral or favorable; blocked where there is too little history."""
    span = F.col("high") - F.col("low")
    df = days.withColumn("_v", F.try_divide(span, F.col("open"))).withColumn("_b", F.try_divide(F.abs(F.col("close") - F.col("open")), span))
    m, s = (wn.expanding(f, "_v", key, day, n) for f in (F.avg, F.stddev_pop))
    df = df.withColumn("_z", F.when(s > 0, (F.col("_v") - m) / s))
    w = wn.over(key, day)
    df = df.withColumn("vol_z", F.lag("_z").over(w)).withColumn("body_ratio", F.lag("_b").over(w))
    p = logistic(weights["bias"], {"vol_z": weights["vol_z"], "body_ratio": weights["body_ratio"]})
    return df.select(key, day, "vol_z", "body_ratio", p.alias("score"), F.coalesce(F.when(p.isNotNull(), band(p, low, high)), F.lit("blocked")).alias("context"))


def quantile_screen(df: DataFrame, features: list[str], target: str, train: Column, q: float, least_n: int, train_n: int = 200) -> DataFrame:
    """Per feature and tail: the training quantile, how often the target follows beyond it in either
    period, its lift, and whether the rule holds (enough rows, lift 1.2, 2 points above the base).
    Features with fewer than train_n training values are left out."""
    rows = stats.long_form(df.withColumn("_train", train), ["_train", target], features)
    cuts = quantiles(rows.where("_train"), "value", [q, 1 - q], ["metric"]).where(F.col("n") >= train_n)
    cuts = cuts.select("metric", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    base = df.withColumn("_train", train).groupBy("_train").agg(F.avg(F.col(target).cast("double")).alias("base"))
    tails = F.explode(F.array(F.struct(F.lit("low").alias("tail"), (F.col("value") <= F.col("low")).alias("hit")), F.struct(F.lit("high").alias("tail"), (F.col("value") >= F.col("high")).alias("hit"))))
    hit = rows.join(F.broadcast(cuts), "metric").select("metric", "_train", target, "low", "high", tails.alias("t")).where("t.hit")
    per = hit.groupBy("metric", "t.tail", "_train").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("rate"), F.first(F.when(F.col("t.tail") == "low", F.col("low")).otherwise(F.col("high"))).alias("cut")
    )
    out = per.join(F.broadcast(base), "_train").withColumn("lift", F.try_divide("rate", "base"))
    good = (F.col("n") >= least_n) & (F.col("lift") >= 1.2) & (F.col("rate") >= F.col("base") + 0.02)
    return out.select(F.col("metric").alias("feature"), "tail", F.when(F.col("_train"), "train").otherwise("test").alias("period"), "cut", "n", "rate", "lift", good.alias("ok"))


def approach_sweep(crossings: DataFrame, days: DataFrame, key: str, day: str, grid: list[tuple[int, int, float]], atr: str) -> DataFrame:
    """Posterior chance of a confirmed break per approach state, for every (n, k, x) of the grid."""
    states = events.approach(crossings, days, key, day, grid, atr).where("outcome is not null and approach_state is not null")
    return stats.beta_posterior(states.withColumn("hit", F.col("outcome") == "confirmed"), ["n", "k", "x", "approach_state"], "hit", 1, 1, count="events")


def level_bar_events(days: DataFrame, levels: DataFrame, key: str, day: str, near: float, by: list[str] = ()) -> DataFrame:
    """Per day, and per type of level where ``by`` names columns of the levels: whether any level of its key
    was near the close, broken through, or bounced off.

    Levels are a few per key, joined on it.
    """
    j = days.join(levels, key)
    p = F.col("level_price")
    breakout = ((F.col("open") < p) & (F.col("close") > p)) | ((F.col("open") > p) & (F.col("close") < p))
    rebound = (F.col("low") <= p) & (F.col("high") >= p) & ~breakout
    return j.groupBy(key, day, *by).agg(
        F.bool_or(F.abs(F.col("close") - p) <= near * p).alias("near_level"), F.bool_or(breakout).alias("breakout"), F.bool_or(rebound).alias("rebound"),
        F.sum(breakout.cast("long")).alias("broken"),
    )


def stop_or_poc(days: DataFrame, key: str, order: str, stop_k: float) -> DataFrame:
    """Fades a false break: enters at a signal bar's close, leaves at the stop when a later bar trades through
    it, else at the first close back at the level; one position at a time, and one that is never left gives no
    row. Exits and trades are found as for brackets."""
    from barwright.operators import exits
    from barwright.sources.room import kept

    bars = kept(exits.numbered(days.select(key, order, "high", "low", "close", "signal", "atr", "poc"), [key], order))
    said = (F.col("signal") != 0) & (F.col("atr") != 0) & ~F.isnan("atr")
    side, price = F.col("signal").cast("int"), F.col("close").cast("double")
    entries = bars.where(said).select(
        "_key", F.col("_i").alias("_e"), (F.col("_i") + 1).alias("_from"), F.col(order).alias("entry"), price.alias("_price"), side.alias("side"),
        (price - side * stop_k * F.col("atr")).alias("stop"), F.col("poc").cast("double").alias("goal"),
    )
    taken = exits.one_at_a_time(exits.with_exits(entries, bars, "close", "close"), ["_key"]).where("_x is not null")
    ends = bars.select(F.col("_key").alias("_of"), F.col("_i").alias("_at"), F.col(order).alias("exit"), F.col("close").cast("double").alias("_close"))
    out = F.when(F.col("by_stop"), F.col("stop")).otherwise(F.col("_close"))
    return taken.join(ends, (F.col("_key") == F.col("_of")) & (F.col("_x") == F.col("_at"))).select(
        F.col(f"_key.{key}").alias(key), "entry", "exit", "side", ((out - F.col("_price")) * F.col("side")).alias("pnl"), F.when(F.col("by_stop"), "stop").otherwise("poc").alias("reason")
    )



def refresh(spark, root: str, raw: DataFrame, contracts: DataFrame, day: str) -> DataFrame:
    """The lake's batch run as one application: raw bars, roll map, continuous bars, quality report. Each
    stage is a table below root and is read back by the next; a failed check stops the run."""
    from barwright.operators import joins, quality

    def stage(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    bars = stage("raw", raw)
    report = stage("quality", quality.checks(bars, "instrument", ["open", "high", "low", "close"], ["instrument", day]))
    quality.assert_pass(report)
    rolls = stage("roll_map", quality.roll_map(contracts, bars.select(day).distinct(), "family", "anchor", day))
    stitched = joins.interval_join(bars, rolls.withColumnRenamed("family", "instrument"), ["instrument"], day, "valid_from", "valid_through")
    return stage("continuous", stitched.select(*bars.columns, "secid"))
