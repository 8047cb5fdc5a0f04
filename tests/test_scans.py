"""Blocked scans, state maps, selection of quantiles, lead-lag blocks and refreshed tails against plain Python and pandas."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.operators import blocked, joins, recurrence, selection, signals, windows as wn
from barwright.sources import lake

SPEC = "k string, t int, v double, g string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(rng.choice(["a", "a", "a", "b", None]), t, rng.choice([None, 0.0, -1.0, 2.0, 5.0]), rng.choice(["x", "x", None])) for t in range(300)]


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_scans_at_any_block_size(spark, rows, size):
    df = spark.createDataFrame(rows, SPEC)
    running = {"s": ("sum", "v"), "n": ("count", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "last": ("last", "v"), "was": ("lag", "v"), "i": ("row", None)}
    got = {r["t"]: r for r in blocked.scan(df, ["k"], ["t"], running, F.floor(F.col("t") / size)).collect()}
    assert len(got) == len(rows)
    for mine in by_key(rows).values():
        seen, before = [], None
        for i, (_, t, v, _) in enumerate(mine, 1):
            seen += [v] if v is not None else []
            r = got[t]
            want = (sum(seen), max(seen), min(seen), seen[-1]) if seen else (None,) * 4
            assert (r["s"], r["hi"], r["lo"], r["last"]) == want and r["n"] == len(seen) and r["i"] == i
            assert r["was"] == before, t
            before = v


def test_drawdown_runs_and_holds(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SPEC)
    for size in (5, 1000):
        monkeypatch.setattr(blocked, "time_block", lambda order, kind: F.floor(F.col(order) / size))
        dd = {r["t"]: r for r in blocked.drawdown(df.fillna(0.0, ["v"]), "v", ["k"], ["t"]).collect()}
        run = {r["t"]: r for r in blocked.runs(df, "g", ["k"], ["t"]).collect()}
        held = {r["t"]: r["h"] for r in blocked.held(df, "h", "v", ["k"], ["t"]).collect()}
        filled = {r["t"]: r["v"] for r in blocked.filled(df, ["v"], ["k"], ["t"]).collect()}
        for mine in by_key(rows).values():
            s = pd.Series([r[2] or 0.0 for r in mine]).cumsum()
            assert [dd[r[1]]["drawdown"] for r in mine] == (s - s.cummax()).tolist()
            labels = [r[3] for r in mine]
            ids = [0]
            for a, b in zip(labels, labels[1:]):
                ids.append(ids[-1] + (a != b))
            for j, r in enumerate(mine):
                pos, size_ = j - ids.index(ids[j]) + 1, ids.count(ids[j])
                place = "single" if size_ == 1 else "start" if pos == 1 else "end" if pos == size_ else "mid"
                got = run[r[1]]
                assert (got["run_id"], got["run_pos"], got["run_len"], got["place"]) == (ids[j] + 1, pos, size_, place)
            carry = pd.Series([r[2] for r in mine], dtype=float)
            assert [held[r[1]] for r in mine] == carry.where(carry != 0).ffill().fillna(0).tolist()
            assert [filled[r[1]] for r in mine] == [None if x != x else x for x in carry.ffill()]


def test_asof_across_blocks(spark):
    rng = random.Random(5)
    left = [(rng.choice("ab"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k), k) for k in range(60)]
    right = [(rng.choice("ab"), dt.datetime(2024, 1, 1) + dt.timedelta(hours=11 * k), float(k)) for k in range(0, 40, 3)]
    l, r = spark.createDataFrame(left, "k string, ts timestamp, id int"), spark.createDataFrame(right, "k string, ts timestamp, v double")
    for tolerance, strict in ((None, False), ("20 hours", True)):
        for x in joins.asof(l, r, ["k"], "ts", ["v"], tolerance, strict).collect():
            at = [(ts, v) for k, ts, v in right if k == x["k"] and (ts < x["ts"] if strict else ts <= x["ts"])]
            best = max(at, default=(None, None))
            if tolerance and best[0] is not None and best[0] < x["ts"] - dt.timedelta(hours=20):
                best = (None, None)
            assert x["v"] == best[1]


def test_two_thresholds_as_state_maps(spark):
    rng = random.Random(6)
    rows = [("ab"[t % 2], dt.date(2020, 1, 1) + dt.timedelta(days=t), rng.choice([None, float("nan"), rng.uniform(-3, 3)])) for t in range(400)]
    got = {r["t"]: r["position"] for r in signals.hysteresis(spark.createDataFrame(rows, "k string, t date, x double"), "k", "t", "x", 2.0, 1.0).collect()}
    state = {"a": 0, "b": 0}
    for k, t, x in rows:
        p = state[k]
        if x is not None and x == x:
            if p == 0:
                p = int(math.copysign(1, x)) if abs(x) >= 2 else 0
            elif abs(x) < 1:
                p = 0
        state[k] = p
        assert got[t] == p


def test_exponential_scores_hold_no_key(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0)], "k string, t date, v double")
    plan = recurrence.with_ew_stats(df, ["k"], ["t"], "v", 5, 3)._jdf.queryExecution().optimizedPlan().toString()
    # windows run within blocks, or over one row per block
    assert all("_block" in line for line in plan.splitlines() if line.strip(" +-:").startswith("Window "))


@pytest.mark.parametrize("ranges", [2, 16, 256])
def test_quantiles_are_those_of_percentile(spark, ranges):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 1.0, float(rng.randrange(50)), rng.uniform(-5, 5)])) for _ in range(900)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r for r in selection.quantiles(df, "v", qs, ["k"], ranges).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, r in got.items():
        mine = [v for key, v in rows if key == k and v is not None]
        assert r["n"] == len(mine) and np.allclose(r["q"], np.quantile(mine, qs), rtol=1e-12)
    whole = selection.quantiles(df, "v", [0.5], ranges=ranges).first()
    assert whole["q"][0] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert not selection.quantiles(df.limit(0), "v", [0.5]).collect()


@pytest.mark.parametrize("block", [30, 4096])
def test_lead_lag_over_overlapping_blocks(spark, block):
    rng = np.random.default_rng(8)
    n = 200
    a, b = rng.normal(size=n) + 1000, rng.normal(size=n) * 5
    b[3:] += 4 * a[:-3]
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), None if i % 17 == 0 else float(a[i]), None if i % 13 == 0 else float(b[i])) for i in range(n)]
    got = {r["lag"]: r for r in wn.lead_lag(spark.createDataFrame(rows, "t date, a double, b double"), "a", "b", "t", range(-7, 8), block=block).collect()}
    x, y = (pd.Series([r[j] for r in rows], dtype=float) for j in (1, 2))
    for k in range(-7, 8):
        both = pd.concat([x, y.shift(-k)], axis=1).dropna()
        assert got[k]["n"] == len(both) and got[k]["corr"] == pytest.approx(both.corr().iloc[0, 1], abs=1e-9)


def test_a_refreshed_tail_leaves_no_stale_month(spark, tmp_path):
    day = lambda m, d: dt.date(2024, m, d)
    old = [(day(m, d), 1.0) for m in (1, 2, 3) for d in (5, 20)]
    root = f"file://{tmp_path}/lake"
    df = spark.createDataFrame(old, "day date, v double")
    lake.create_lake(df, root, "day")
    before = {r["month"]: f for r in lake.read_lake(spark, root).select("month", F.input_file_name().alias("f")).collect() for f in [r["f"]]}
    tail = spark.createDataFrame([(day(2, 6), 2.0), (day(2, 6), 3.0), (day(1, 9), 9.0)], "day date, v double")
    lake.refresh_tail(spark, root, tail, "day", "2024-02-01", ["day"])
    now = lake.read_lake(spark, root)
    assert sorted((r["day"], r["v"]) for r in now.collect()) == [(day(1, 5), 1.0), (day(1, 20), 1.0), (day(2, 6), 3.0)]
    assert {r["f"] for r in now.where("month = '2024-01'").select(F.input_file_name().alias("f")).collect()} == {before["2024-01"]}
    # within a month: days before the cutoff stay
    lake.refresh_tail(spark, root, tail.where("v = 2"), "day", "2024-01-10", ["day"])
    assert sorted((r["day"], r["v"]) for r in lake.read_lake(spark, root).collect()) == [(day(1, 5), 1.0), (day(2, 6), 2.0)]
    lake.refresh_tail(spark, root, tail.limit(0), "day", "2024-02-01", ["day"])
    assert [r["day"] for r in lake.read_lake(spark, root).collect()] == [day(1, 5)]


@pytest.mark.parametrize("block, ranges, lag", [(4096, 128, 0), (7, 4, 0), (16, 2, 3), (5, 64, 1)])
def test_quantiles_of_the_past(spark, block, ranges, lag):
    from barwright.operators import orderstats

    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), dt.date(2020, 1, 1) + dt.timedelta(days=t), rng.choice([None, float("nan"), 1.0, float(rng.randrange(9)), rng.uniform(0, 9)])) for t in range(150)]
    df = spark.createDataFrame(rows, "k string, t date, v double")
    got = {r["t"]: r["cut"] for r in orderstats.with_past_quantile(df, "cut", "v", 0.3, ["k"], "t", 4, lag, block, ranges).collect()}
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        mine = [r for r in rows if r[0] == key]
        for i, (_, t, _) in enumerate(mine):
            past = [v for _, _, v in mine[: max(0, i - lag)] if v is not None and v == v]
            want = np.quantile(past, 0.3) if len(past) >= 4 else None
            assert got[t] == (pytest.approx(want) if want is not None else None)


def test_stitched_bars_gather_contracts_not_rows(spark):
    from barwright.operators import bars

    rng = random.Random(12)
    rows = [(rng.choice("ab"), t, f"c{(t + rng.randrange(20)) // 90}", rng.uniform(1, 9), 1.0, t > 250) for t in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, secid string, price double, volume double, near boolean")
    df = df.withColumns({c: F.col("price") for c in ("open", "high", "low", "close")})
    out = bars.continuous_days(df, ["k"], "t", "secid", "near")
    for r in out.collect():
        mine = [x for x in rows if x[0] == r["k"]]
        prices = [x[3] for x in mine]
        assert (r["open"], r["high"], r["low"], r["close"]) == (prices[0], max(prices), min(prices), prices[-1])
        assert (r["volume"], r["bar_count"], r["has_roll_boundary"]) == (len(mine), len(mine), any(x[5] for x in mine))
        assert r["source_contracts"] == list(dict.fromkeys(x[2] for x in mine))
    # what is gathered has been summed up by contract before
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("collect_list") < plan.rindex("Aggregate [k") and plan.count("collect_list") == 1 and plan.count("Aggregate") == 2


@pytest.mark.parametrize("step", [1, 3, 7, 1000])
def test_closed_profit_by_blocks(spark, step):
    rng = random.Random(13)
    kinds = ["OPEN_LONG", "OPEN_SHORT", "CLOSE", "REVERSE", "REVERSE", "HOLD", None]
    log = [(rng.choice(["a", "b", None]), t, "REVERSE" if t < 12 else rng.choice(kinds), rng.choice([None, 1.0, 2.0, 4.0])) for t in range(200)]
    df = spark.createDataFrame(log, "k string, t long, action string, price double")
    out = signals.realized(df, ["k"], "t", F.floor(F.col("t") / step))
    got = {r["t"]: (r["k"], r["action"], r["price"], r["side"], r["closed_pnl"]) for r in out.collect()}
    assert len(got) == len(log)
    for key in ("a", "b", None):
        side = before = price = None
        for _, t, action, now in (r for r in log if r[0] == key):
            before = side
            side = {"OPEN_LONG": 1, "OPEN_SHORT": -1, "CLOSE": 0}.get(action, side if action != "REVERSE" or side is None else -side)
            pnl = None
            if action in ("CLOSE", "REVERSE"):
                pnl = 0.0 if None in (before, now, price) else before * (now - price)
            assert got[t] == (key, action, now, side, pnl)
            price = now


def test_a_trade_log_is_sorted_by_blocks(spark):
    from barwright.plans.research_queries import realized_pnl

    plan = realized_pnl(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # those by key alone have one row a block
    assert windows and all("_block" in line for line in windows)
