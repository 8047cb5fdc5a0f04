"""Signals and back-tests: positions from averages, thresholds and crosses; profit bar by bar and by day."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barwright.operators import blocked, windows as wn
from barwright.operators.recurrence import time_block, with_ema, with_states


#: Decimals at which results are compared when parameters are ranked.
RANK_DIGITS = 6


def ema_positions(bars: DataFrame, keys: list[str], order: str, fast: int, slow: int, mode: str = "both") -> DataFrame:
    """Signal is the sign of fast - slow average, clipped by mode (both, long, short); the position of a
    bar is the signal of the bar before, 0 at first."""
    df = with_ema(bars, keys, [order], "close", {"ema_fast": fast, "ema_slow": slow})
    sign = F.signum(F.col("ema_fast") - F.col("ema_slow")).cast("int")
    clipped = {"both": sign, "long": F.greatest(sign, F.lit(0)), "short": F.least(sign, F.lit(0))}[mode]
    df = df.withColumn("signal", clipped)
    return df.withColumn("position", F.coalesce(F.lag("signal").over(wn.over(keys, order)), F.lit(0)))


def open_to_open(df: DataFrame, keys: list[str], order: str, commission: float) -> DataFrame:
    """trades, fee, terminal_fee and pnl_bar: held from this open to the next, the last bar to its close."""
    w = wn.over(keys, order)
    last = F.lead(order).over(w).isNull()
    step = F.coalesce(F.lead("open").over(w), F.col("close")) - F.col("open")
    return (
        df.withColumn("trades", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))))
        .withColumn("fee", F.col("trades") * commission)
        .withColumn("terminal_fee", F.when(last, F.abs("position") * commission).otherwise(0.0))
        .withColumn("pnl_bar", F.col("position") * step - F.col("fee") - F.col("terminal_fee"))
    )


def close_to_close(df: DataFrame, keys: list[str], order: str, day: str, commission: float, count_first: bool = False) -> DataFrame:
    """Day results of the position held over close differences: pnl_day, num_trades_day, max_dd_day, edge.

    The drawdown is within the day. count_first says whether the first bar's position is a trade.
    """
    w = wn.over(keys, order)
    first = F.abs("position") if count_first else F.lit(0)
    bar = (
        df.withColumn("trades", F.coalesce(F.abs(F.col("position") - F.lag("position").over(w)), first))
        .withColumn("pnl", F.col("position") * F.coalesce(wn.diff("close", w), F.lit(0.0)) - F.col("trades") * commission)
    )
    curve = blocked.drawdown(bar, "pnl", [*keys, day], [order])
    return curve.groupBy(*keys, day).agg(
        F.sum("pnl").alias("pnl_day"), F.sum("trades").alias("num_trades_day"), F.min("drawdown").alias("max_dd_day")
    ).withColumn("edge_day", (F.col("pnl_day") > 0).cast("int"))


def session_day(bar_end: str) -> Column:
    """The day that a right-labelled bar belongs to."""
    return F.to_date(F.col(bar_end) - F.expr("interval 1 microsecond"))


def by_day(df: DataFrame, keys: list[str], day: str, pnl: str = "pnl_bar", trades: str = "trades") -> DataFrame:
    """Per day profit and trades, and over the days cumulated profit and drawdown."""
    days = df.groupBy(*keys, day).agg(F.sum(pnl).alias("pnl_day"), F.sum(trades).alias("trades_day"))
    return blocked.drawdown(days, "pnl_day", keys, [day]).select(*keys, day, "pnl_day", "trades_day", F.col("equity").alias("cum_pnl"), "drawdown")


def segment(days: DataFrame, keys: list[str], near_zero: float = 1e-9) -> DataFrame:
    """Per key: days, mean and total profit, win and near-zero rates, trades, worst drawdown."""
    return days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("pnl_day").alias("mean_pnl"),
        F.sum("pnl_day").alias("total_pnl"),
        F.avg((F.col("pnl_day") > 0).cast("double")).alias("win_rate"),
        F.avg((F.abs("pnl_day") <= near_zero).cast("double")).alias("near_zero_rate"),
        F.sum("trades_day").alias("trades"),
        F.min("drawdown").alias("max_drawdown"),
    )


def ranked(segments: DataFrame, within: list[str], ties: list[str]) -> DataFrame:
    """Rank 1 is the highest mean, then win rate, then the smallest drawdown, then the ties' order.

    The metrics are compared at RANK_DIGITS decimals: parameters that trade alike must tie, and sums of
    the same numbers in another order differ in their last bits.
    """
    by = [F.round(c, RANK_DIGITS).desc() for c in ("mean_pnl", "win_rate", "max_drawdown")]
    w = W.partitionBy(*within).orderBy(*by, *ties)
    return segments.withColumn("rank", F.row_number().over(w))


def grid(fasts: range, slows: range) -> list[tuple[int, int]]:
    return [(f, s) for f in fasts for s in slows if f < s]


#: Averages that differ by less than this share of their size count as equal: equal averages that were
#: computed along different ways differ in their last bits.
EQUAL_SHARE = 1e-12


def _pair_days(df: DataFrame, own: list[str], order: str, averages: Column, spans: list[int], pairs: list[tuple[int, int]], commission: float, mode: str) -> DataFrame:
    """Day results (own, fast, slow, day, pnl_day, trades_day) of all pairs; df has order, open, close and day.

    A row carries the signals of all pairs as one array of bytes. The array's last two values give all positions
    and trades of a bar, and pairs become rows only where they are added up by day, before any shuffle.
    """
    w, at = wn.over(own, order), {n: k for k, n in enumerate(spans)}
    names = F.array(*(F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.lit(at[f]).alias("f"), F.lit(at[s]).alias("s")) for f, s in pairs))
    low, high = {"both": (-1, 1), "long": (0, 1), "short": (-1, 0)}[mode]

    def signal(p: Column) -> Column:
        a, b = F.get(F.col("_e"), p["f"]), F.get(F.col("_e"), p["s"])
        sign = F.when(F.abs(a - b) <= EQUAL_SHARE * F.greatest(F.abs(a), F.abs(b)), 0.0).otherwise(F.signum(a - b))
        return F.least(F.greatest(F.coalesce(sign, F.lit(0.0)), F.lit(low)), F.lit(high)).cast("tinyint")

    df = df.withColumn("_e", averages).withColumn("_sig", F.transform(names, signal)).select(*own, order, "day", "open", "close", "_sig")
    none = F.array_repeat(F.lit(0).cast("tinyint"), len(pairs))
    df = df.select(
        *own, "day", F.coalesce(F.lag("_sig").over(w), none).alias("_now"), F.coalesce(F.lag("_sig", 2).over(w), none).alias("_was"),
        (F.coalesce(F.lead("open").over(w), F.col("close")) - F.col("open")).alias("_step"), F.lead(order).over(w).isNull().alias("_last"),
    )
    bar = F.explode(F.arrays_zip(names.alias("p"), F.col("_now").alias("now"), F.col("_was").alias("was"))).alias("b")
    bars = df.select(*own, "day", "_step", "_last", bar).select(
        *own, "day", "_step", "_last", F.col("b.p.fast").alias("fast"), F.col("b.p.slow").alias("slow"), F.col("b.now").cast("int").alias("now"), F.col("b.was").cast("int").alias("was")
    )
    trades, ended = F.abs(F.col("now") - F.col("was")), F.when(F.col("_last"), F.abs("now")).otherwise(0)
    return bars.groupBy(*own, "fast", "slow", "day").agg(
        F.sum(F.col("now") * F.col("_step") - (trades + ended) * F.lit(commission)).alias("pnl_day"), F.sum(trades).alias("trades_day")
    )


def grid_search(bars: DataFrame, key: str | list[str], order: str, pairs: list[tuple[int, int]], commission: float, day: Column, mode: str = "both") -> DataFrame:
    """Day results of every pair, with cumulated profit and drawdown: each span's average is computed once, and
    what is shuffled is bars and day sums, never bars times pairs."""
    spans = sorted({s for p in pairs for s in p})
    own = [key] if isinstance(key, str) else list(key)
    df = with_ema(bars, own, [order], "close", {f"e{s}": s for s in spans}).withColumn("day", day)
    days = _pair_days(df, own, order, F.array(*(F.col(f"e{s}") for s in spans)), spans, pairs, commission, mode)
    keys = [*own, "fast", "slow"]
    return blocked.drawdown(days, "pnl_day", keys, ["day"]).select(*keys, "day", "pnl_day", "trades_day", F.col("equity").alias("cum_pnl"), "drawdown")


def month_windows(bars: DataFrame, key: str, order: str, train: int, valid: int, step: int) -> DataFrame:
    """Rolling windows over each key's full months: key, window_id (w001, ...), role (train or valid), month_from,
    month_to, months (the array of them).

    A month is full if the key has bars in it, its first bar of all is no later than the month's start, and its
    last bar of all no earlier than the next month's start. Months are counted, so a month without bars is none.
    """
    if min(train, valid, step) < 1:
        raise ValueError("train, valid and step are months: 1 at least")
    months = bars.groupBy(key, F.trunc(order, "month").alias("month")).agg(F.min(order).alias("a"), F.max(order).alias("b"))
    spans = months.groupBy(key).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.collect_set("month").alias("m"))
    full = F.filter("m", lambda m: (F.col("a") <= m) & (F.col("b") >= F.add_months(m, 1)))
    spans = spans.select(key, F.array_sort(full).alias("m"))
    count = F.size("m") - (train + valid) + 1
    spans = spans.where(count > 0).select(key, "m", F.posexplode(F.sequence(F.lit(1), count, F.lit(step))).alias("_k", "_at"))
    roles = F.array(
        F.struct(F.lit("train").alias("role"), F.slice("m", F.col("_at"), F.lit(train)).alias("months")),
        F.struct(F.lit("valid").alias("role"), F.slice("m", F.col("_at") + train, F.lit(valid)).alias("months")),
    )
    out = spans.select(key, F.format_string("w%03d", F.col("_k") + 1).alias("window_id"), F.explode(roles).alias("r"))
    return out.select(key, "window_id", "r.role", F.element_at("r.months", 1).alias("month_from"), F.element_at("r.months", -1).alias("month_to"), "r.months")


def walk_forward_segments(
    bars: DataFrame, key: str, order: str, pairs: list[tuple[int, int]], commission: float, day: Column,
    train: int, valid: int, step: int, mode: str = "both", near_zero: float = 1e-9,
) -> DataFrame:
    """The results of every pair on every window's training and validation months, each segment by itself:
    averages begin with the segment's first close, positions flat, the last bar pays for its position.

    Overlapping segments take their averages from one scan over the key. An average is affine in its entry value,
    so n closes after a segment's first it is the scan's plus (1 - a)^n times (that first close less the scan's
    average there). Bars without a close before the segment's first have no signal. A task holds one segment's bars.
    """
    from barwright.operators.quality import CheckFailed

    spans = sorted({s for p in pairs for s in p})
    windows = month_windows(bars, key, order, train, valid, step)
    if windows.isEmpty():
        raise CheckFailed("no_full_month_windows")
    df = with_ema(bars.select(key, order, "open", "close"), [key], [order], "close", {f"e{s}": s for s in spans})
    df = df.select(key, order, "open", "close", F.array(*(F.col(f"e{s}") for s in spans)).alias("_all"), F.trunc(order, "month").alias("_month"))
    roles = windows.select(F.col(key).alias("_key"), "window_id", "role", F.explode("months").alias("_of"))
    met = df.join(roles, df[key].eqNullSafe(roles["_key"]) & (df["_month"] == roles["_of"])).withColumn("day", day)
    own = ["window_id", "role", key]
    upto = wn.over(own, order, W.unboundedPreceding, 0)
    live = F.col("close").isNotNull()
    met = met.withColumn("_first", F.first(F.when(live, F.struct("close", "_all")), ignorenulls=True).over(upto)).withColumn("_n", F.count("close").over(upto) - 1)
    keep = F.array(*(F.lit(1 - 2.0 / (n + 1)) for n in spans))
    own_average = F.when(
        F.col("_first").isNotNull(),
        F.transform(
            F.arrays_zip(F.col("_all").alias("e"), F.col("_first._all").alias("at"), keep.alias("q")),
            lambda z: z["e"] + F.pow(z["q"], F.col("_n")) * (F.col("_first.close") - z["at"]),
        ),
    )
    days = _pair_days(met, own, order, own_average, spans, pairs, commission, mode)
    keys = [*own, "fast", "slow"]
    results = segment(blocked.drawdown(days, "pnl_day", keys, ["day"]), keys, near_zero)
    at = windows.select("window_id", "role", F.col(key).alias("_key"), "month_from", "month_to")
    joined = results.join(at, (results["window_id"] == at["window_id"]) & (results["role"] == at["role"]) & results[key].eqNullSafe(at["_key"]))
    return joined.select(*(results[c] for c in results.columns), "month_from", "month_to")


def best_by_window(segments: DataFrame, key: str) -> DataFrame:
    """Of walk_forward_segments per window the best pair of the training months, and its results on both parts."""
    metrics = ("mean_pnl", "win_rate", "near_zero_rate", "total_pnl", "days", "trades", "max_drawdown")

    def of(role: str, c: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{c}")

    wide = segments.groupBy("window_id", key, "fast", "slow").agg(
        *(of(role, c) for role in ("train", "valid") for c in metrics),
        F.max(F.when(F.col("role") == "train", F.col("month_from"))).alias("train_from"), F.max(F.when(F.col("role") == "valid", F.col("month_from"))).alias("valid_from"),
        F.max("month_to").alias("valid_to"),
    )
    named = wide.select("*", *(F.col(f"train_{c}").alias(c) for c in ("mean_pnl", "win_rate", "max_drawdown")))
    best = ranked(named, ["window_id", key], ["fast", "slow"]).where("rank = 1")
    return best.drop("rank", "mean_pnl", "win_rate", "max_drawdown")


def held_out_months(bars: DataFrame, order: str, n: int) -> DataFrame:
    """bars with role: 'holdout' in the last n months that have bars, 'train' before.

    There must be a month more than that; months are counted over all keys, a few rows a year.
    """
    from barwright.operators.quality import CheckFailed

    month = F.trunc(order, "month")
    known = bars.agg(F.sort_array(F.collect_set(month), asc=False).alias("m"))
    if (known.select(F.size("m")).first()[0] or 0) < n + 1:
        raise CheckFailed("not_enough_months")
    cut = F.broadcast(known.select(F.element_at("m", n).alias("_cut")))
    return bars.join(cut).withColumn("role", F.when(month >= F.col("_cut"), "holdout").otherwise("train")).drop("_cut")


def holdout(bars: DataFrame, key: str, order: str, pairs: list[tuple[int, int]], commission: float, months: int, day: Column) -> DataFrame:
    """Per key the best pair of the training months, frozen, and its results on the last ``months``.

    Averages start anew in either part, so the training part sees nothing of the other.
    """
    parts = held_out_months(bars, order, months)
    results = segment(grid_search(parts, ["role", key], order, pairs, commission, day), ["role", key, "fast", "slow"])

    def of(role: str, c: str):
        return F.max(F.when(F.col("role") == role, F.col(c)))

    metrics = ("mean_pnl", "win_rate", "max_drawdown", "total_pnl", "days")
    wide = results.groupBy(key, "fast", "slow").agg(*(of("train", c).alias(c) for c in metrics), *(of("holdout", c).alias(f"holdout_{c}") for c in metrics))
    return ranked(wide.where("days is not null"), [key], ["fast", "slow"]).where("rank = 1").drop("rank")


def timeframe_holdout(frames: dict[str, DataFrame], key: str, order: str, pairs: list[tuple[int, int]], commission: float, months: int, day: Column) -> DataFrame:
    """Every pair of every timeframe on the last ``months``, ranked within key and timeframe on these
    months themselves. ``frames`` has bars of the same columns by timeframe."""
    df = None
    for name, bars in frames.items():
        part = held_out_months(bars, order, months).where("role = 'holdout'").withColumn("timeframe", F.lit(name))
        df = part if df is None else df.unionByName(part)
    results = segment(grid_search(df, ["timeframe", key], order, pairs, commission, day), ["timeframe", key, "fast", "slow"])
    return ranked(results, ["timeframe", key], ["fast", "slow"])


def gated_grid(days: DataFrame, context: DataFrame, on: list[str], keys: list[str], day: str, blocked: str, since: str | None = None) -> DataFrame:
    """Results of every key as they are (RAW) and without the blocked days (BLOCK), over all days and
    from ``since`` on. Every day must have a context; a day without one stops the run."""
    from barwright.operators.joins import many_to_one

    met = many_to_one(days, context.select(*on, F.col(blocked).alias("_blocked")), on)
    modes = F.array(F.lit("RAW"), F.when(~F.col("_blocked"), "BLOCK"))
    slices = F.array(F.lit("full"), *([F.when(F.col(day) >= F.lit(since).cast("date"), f"from_{since}")] if since else []))
    long = met.withColumn("mode_name", F.explode(F.array_compact(modes))).withColumn("slice_label", F.explode(F.array_compact(slices)))
    out = long.groupBy("mode_name", "slice_label", *keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.sum("pnl_day").alias("total_pnl"),
        F.max(-F.col("drawdown")).alias("max_drawdown"), F.sum("trades_day").alias("trades"), F.avg((F.col("pnl_day") > 0).cast("double")).alias("edge_rate"),
    )
    return out.withColumn("pnl_max_dd", F.try_divide("total_pnl", F.nullif("max_drawdown", F.lit(0.0))))


def lead_follow(df: DataFrame, keys: list[str], order: str, lead: str, follow: str, least: float, cost: float) -> DataFrame:
    """Per key the results of trading ``follow`` in the direction of ``lead``'s last log return, where that
    reached ``least``: bars, trades, win rate of bars that moved, net profit and its mean per trade."""
    w = wn.over(keys, order)
    r = wn.log_return(lead, w)
    df = df.withColumn("_s", F.when(F.abs(r) >= least, F.signum(r)).otherwise(0.0))
    df = df.withColumn("_p", F.coalesce(F.lag("_s").over(w), F.lit(0.0))).withColumn("_d", wn.diff(follow, w))
    df = df.withColumn("_g", F.col("_p") * F.col("_d")).withColumn("_t", (F.col("_p") != F.coalesce(F.lag("_p").over(w), F.lit(0.0))).cast("long"))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"), F.sum("_t").alias("trades"), F.avg(F.when(F.col("_g") != 0, (F.col("_g") > 0).cast("double"))).alias("win_rate"),
        (F.coalesce(F.sum(F.col("_g") - F.col("_t") * cost), F.lit(0.0))).alias("pnl_net"),
    )
    return out.withColumn("avg_per_trade", F.coalesce(F.try_divide("pnl_net", "trades"), F.lit(0.0)))


def threshold_positions(bars: DataFrame, key: str, order: str, n: int, k: float) -> DataFrame:
    """Mean reversion: against returns beyond k deviations of the last n; held for the next bar."""
    w = wn.over(key, order)
    df = bars.withColumn("ret", wn.pct_change("close", w)).withColumn("vol", wn.rolling(F.stddev_samp, "ret", key, order, n))
    raw = F.when(F.col("ret") <= -k * F.col("vol"), 1).when(F.col("ret") >= k * F.col("vol"), -1).otherwise(0)
    return df.withColumn("signal", raw).withColumn("position", F.coalesce(F.lag("signal").over(w), F.lit(0)))


def hysteresis(df: DataFrame, key: str, order: str, x: str, enter: float, leave: float) -> DataFrame:
    """Position with two thresholds: taken when flat and |x| reaches ``enter``, with x's sign; given up
    when |x| falls below ``leave``. Rows without an x change nothing. A block of rows maps each of the three
    positions to one, so blocks are folded and expanded side by side (see with_states)."""

    def step(p: np.ndarray, v: np.ndarray) -> np.ndarray:
        size = np.abs(v)
        return np.where(p == 0, np.where(size >= enter, np.sign(v), 0), np.where(size < leave, 0, p)).astype(np.int8)

    return with_states(df, [key], [order], x, "position", [-1, 0, 1], 0, step)


def brackets(days: DataFrame, keys: list[str], order: str, grid: list[tuple[float, float]]) -> DataFrame:
    """One position at a time: entered at the next open after a signal, closed by an ATR stop, else by an
    ATR target, else at the last close; for every (stop_k, take_k) of the grid, in multiples of the ATR at
    the signal. Rows: keys, stop_k, take_k, entry, exit, side, pnl, reason.

    The exit of every possible entry is found by itself, then pointers pick those that don't overlap (see exits):
    what is multiplied by the grid is entries, not bars, and no task holds a key.
    """
    from barwright.operators import exits
    from barwright.sources.room import kept

    bars = kept(exits.numbered(days.select(*keys, order, "open", "high", "low", "close", "atr", "signal"), keys, order))
    options = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("stop_k"), F.lit(float(t)).alias("take_k")) for s, t in grid)))
    said = (F.col("signal") != 0) & F.col("atr").isNotNull() & ~F.isnan("atr")
    signals = bars.where(said).select(F.col("_key").alias("_of"), (F.col("_i") + 1).alias("_at"), F.col("atr").alias("_atr"), F.col("signal").cast("int").alias("side"))
    opened = bars.join(signals, (F.col("_key") == F.col("_of")) & (F.col("_i") == F.col("_at"))).select(
        "_key", F.col("_i").alias("_e"), F.col("_i").alias("_from"), F.col(order).alias("entry"), F.col("open").cast("double").alias("_price"), "side", "_atr", options.alias("_o")
    )
    price, side = F.col("_price"), F.col("side")
    entries = opened.select(
        "_key", "_e", "_from", "entry", "_price", "side", "_o.stop_k", "_o.take_k",
        (price - side * F.col("_o.stop_k") * F.col("_atr")).alias("stop"), (price + side * F.col("_o.take_k") * F.col("_atr")).alias("goal"),
    )
    met = exits.with_exits(entries, bars, "high", "low")
    met = met.withColumn("_ended", F.col("_x").isNull()).withColumn("_x", F.coalesce("_x", "_last"))
    taken = exits.one_at_a_time(met, ["_key", "stop_k", "take_k"])
    ends = bars.select(F.col("_key").alias("_of"), F.col("_i").alias("_at"), F.col(order).alias("exit"), F.col("close").cast("double").alias("_close"))
    out = F.when(F.col("_ended"), F.col("_close")).when(F.col("by_stop"), F.col("stop")).otherwise(F.col("goal"))
    reason = F.when(F.col("_ended"), "end").when(F.col("by_stop"), "stop").otherwise("target")
    return taken.join(ends, (F.col("_key") == F.col("_of")) & (F.col("_x") == F.col("_at"))).select(
        *(F.col(f"_key.{k}").alias(k) for k in keys), "stop_k", "take_k", "entry", "exit", "side", ((out - price) * side).alias("pnl"), reason.alias("reason")
    )


def realized(log: DataFrame, keys: list[str], order: str, block: Column | None = None) -> DataFrame:
    """Trade log actions (OPEN_LONG, OPEN_SHORT, CLOSE, REVERSE) with each row's closed profit.

    A scan over blocks of the order (``block`` must not decrease with it): a block ends in a side of its own, or
    turns the side in which it is entered or not; blocks are chained by one row each.
    """
    block = time_block(order, dict(log.dtypes)[order]) if block is None else block
    cut = log.withColumn("_key", F.struct(*keys)).withColumn("_block", block)
    inside = W.partitionBy("_key", "_block").orderBy(order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)

    def turned(side: Column, flips: Column) -> Column:
        return side * F.when(flips % 2 == 1, -1).otherwise(1)

    named = F.when(F.col("action") == "OPEN_LONG", 1).when(F.col("action") == "OPEN_SHORT", -1).when(F.col("action") == "CLOSE", 0)
    rows = cut.withColumn("_flips", F.sum(F.when(F.col("action") == "REVERSE", 1).otherwise(0)).over(upto))
    rows = rows.withColumn("_set", F.last(F.when(named.isNotNull(), F.struct(named.alias("side"), "_flips")), ignorenulls=True).over(upto))
    rows = rows.withColumn("_now", F.struct(turned(F.col("_set.side"), F.col("_flips") - F.col("_set._flips")).alias("side"), "_flips", "price"))
    rows = rows.drop("_flips", "_set")
    # a block's last row says what it does to the side, and its last price
    ends = rows.groupBy("_key", "_block").agg(F.max_by("_now", order).alias("_now"))
    blocks = W.partitionBy("_key").orderBy("_block")
    sofar = blocks.rowsBetween(W.unboundedPreceding, 0)
    ends = ends.withColumn("_turns", F.sum(F.when(F.col("_now.side").isNull(), F.col("_now._flips")).otherwise(0)).over(sofar))
    ends = ends.withColumn("_set", F.last(F.when(F.col("_now.side").isNotNull(), F.struct("_now.side", "_turns")), ignorenulls=True).over(sofar))
    after = turned(F.col("_set.side"), F.col("_turns") - F.col("_set._turns"))
    few = ends.select(
        F.col("_key").alias("_of"), F.col("_block").alias("_to"), F.lag(after).over(blocks).alias("_side_in"), F.lag("_now.price").over(blocks).alias("_price_in")
    )
    rows = rows.withColumn("_was", F.lag("_now").over(inside))
    met = rows.join(few, (rows["_key"] == few["_of"]) & (rows["_block"] == few["_to"]))
    side = lambda at: F.coalesce(F.col(f"{at}.side"), turned(F.col("_side_in"), F.col(f"{at}._flips")))
    first = F.col("_was").isNull()
    before, price = F.when(first, F.col("_side_in")).otherwise(side("_was")), F.when(first, F.col("_price_in")).otherwise(F.col("_was.price"))
    pnl = F.when(F.col("action").isin("CLOSE", "REVERSE"), F.coalesce(before * (F.col("price") - price), F.lit(0.0)))
    return met.select(*(F.col(c) for c in log.columns), side("_now").alias("side"), pnl.alias("closed_pnl"))
