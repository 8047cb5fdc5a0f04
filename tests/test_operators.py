"""Operators on small frames: fixed facts, brute force, and refusals."""

import datetime as dt
import math
import os
import random
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions import scalar
from barwright.operators import bars, blocked, daily, joins, quality, recurrence, signals, stats, windows as wn
from barwright.sources import lake
from barwright.streaming import bars as sb


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def session(spark):
    start = dt.datetime(2026, 5, 4, 10, 5)
    rows = [(start + dt.timedelta(minutes=5 * i), 1000.0 + i, 1001.0 + i, 999.0 + i, 1000.5 + i, 10 + i) for i in range(48)]
    return frame(spark, rows, "bar_end timestamp_ntz, open double, high double, low double, close double, volume long")


@pytest.mark.parametrize("minutes, n, each", [(15, 16, 3), (30, 8, 6), (60, 4, 12), (240, 1, 48)])
def test_session_buckets(spark, minutes, n, each):
    start, end = (F.lit(dt.datetime(2026, 5, 4, h, 0)).cast("timestamp_ntz") for h in (10, 14))
    b = session(spark).withColumn("b", bars.session_bucket(F.col("bar_end"), start, end, minutes))
    got = b.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min_by("open", "bar_end").alias("open"), F.max("high").alias("high"), F.sum("volume").alias("v")).orderBy("b").collect()
    assert len(got) == n and {r["n"] for r in got} == {each}
    assert (got[0]["open"], got[0]["high"], got[0]["v"]) == (1000.0, 1001.0 + each - 1, sum(10 + i for i in range(each)))


def test_unsupported_timeframe():
    with pytest.raises(ValueError, match="unsupported_timeframe"):
        bars.duration("2w")


def test_open_to_open_costs(spark):
    df = frame(spark, [("a", 1, 0, 100.0, 101.0), ("a", 2, 1, 110.0, 109.0), ("a", 3, -1, 90.0, 95.0)], "k string, t int, position int, open double, close double")
    got = signals.open_to_open(df, ["k"], "t", 2.0).orderBy("t").collect()
    assert [r["trades"] for r in got] == [0, 1, 2]
    assert [r["fee"] for r in got] == [0, 2, 4]
    assert [r["terminal_fee"] for r in got] == [0, 0, 2]
    assert [r["pnl_bar"] for r in got] == [0, -22, -11]


def test_position_is_lagged_signal(spark):
    df = frame(spark, [("a", i, c) for i, c in enumerate([100.0, 102.0, 104.0, 99.0])], "k string, t int, close double")
    got = signals.ema_positions(df, ["k"], "t", 1, 2).orderBy("t").collect()
    assert [r["position"] for r in got] == [0] + [r["signal"] for r in got][:-1]
    assert got[0]["signal"] == 0


@pytest.mark.parametrize("block", [3, 7, 4096])
def test_blocked_scan_is_the_recursion(spark, block):
    rng = random.Random(1)
    rows = [(k, i, rng.random() * 100) for k in "ab" for i in range(40)]
    got = recurrence.with_ema(frame(spark, rows, "k string, t int, x double"), ["k"], ["t"], "x", {"e": 5}, F.floor(F.col("t") / block)).toPandas()
    for _, g in got.sort_values("t").groupby("k"):
        assert np.allclose(g["e"], g["x"].ewm(span=5, adjust=False).mean(), rtol=1e-12)


def test_scan_keeps_average_over_nulls(spark):
    df = frame(spark, [("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 4.0)], "k string, t int, x double")
    got = [r["e"] for r in recurrence.with_ema(df, ["k"], ["t"], "x", {"e": 3}, F.floor(F.col("t") / 2)).orderBy("t").collect()]
    assert got == [2.0, 2.0, 2.0, 3.0]


def test_ew_stats(spark):
    rows = [("a", i, float(i * i % 7)) for i in range(30)]
    got = recurrence.with_ew_stats(frame(spark, rows, "k string, t int, x double"), ["k"], ["t"], "x", 5, 3).toPandas().sort_values("t")
    a, w = 2 / 6, np.array([])
    for i, (mean, std) in enumerate(zip(got["ew_mean"], got["ew_std"])):  # by the weights themselves
        w = np.append(w * (1 - a), a if i else 1.0)
        x = got["x"].to_numpy()[: i + 1]
        m = (w * x).sum()
        if i < 2:
            assert np.isnan(mean) and np.isnan(std)
        else:
            assert np.isclose(mean, m) and np.isclose(std, np.sqrt((w * (x - m) ** 2).sum() / (1 - (w**2).sum())))
    back = recurrence.with_ew_stats(frame(spark, rows, "k string, t int, x double"), ["k"], ["t"], "x", 5, 12, fallback=4).toPandas().sort_values("t")
    roll = got["x"].rolling(4, min_periods=3)
    assert np.allclose(back["ew_mean"][:11], roll.mean()[:11], equal_nan=True) and np.allclose(back["ew_std"][:11], roll.std(ddof=0)[:11], equal_nan=True)


def test_asof_is_the_theta_join(spark):
    rng = random.Random(2)
    left = [(rng.randrange(3), rng.randrange(100), i) for i in range(60)]
    right = [(rng.randrange(3), rng.randrange(100), rng.random()) for _ in range(60)]
    l, r = frame(spark, left, "k int, t int, id int"), frame(spark, right, "k int, t int, v double")
    got = {x["id"]: x["v"] for x in joins.asof(l, r, ["k"], "t", ["v"]).collect()}
    for k, t, i in left:
        past = [(tt, v) for kk, tt, v in right if kk == k and tt <= t]
        assert got[i] == (max(past)[1] if past else None)


def test_interval_join_open_end_and_ambiguity(spark):
    rows = frame(spark, [("s", 1), ("s", 5), ("s", 9)], "k string, d int")
    windows = frame(spark, [("s", 0, 5, "old"), ("s", 5, None, "new")], "k string, a int, b int, c string")
    j = joins.interval_join(rows, windows, ["k"], "d", "a", "b")
    assert sorted((r["d"], r["c"]) for r in j.collect()) == [(1, "old"), (5, "new"), (5, "old"), (9, "new")]
    assert [r["d"] for r in joins.ambiguous(j, ["k", "d"]).collect()] == [5]


def test_per_column_last_skips_nulls(spark):
    t = dt.datetime(2024, 1, 1, 0, 1)
    df = frame(spark, [(t, 1.0, None), (t + dt.timedelta(seconds=5), None, 2.0), (t + dt.timedelta(seconds=9), 3.0, None)], "ts timestamp_ntz, a double, b double")
    got = bars.last_in_bucket(df, "5 minutes", ["a", "b"], []).collect()
    assert [(r["a"], r["b"]) for r in got] == [(3.0, 2.0)]


def test_invalid_bars_count_nulls(spark):
    df = frame(spark, [(1.0, 2.0, 0.5, 1.5), (None, 2.0, 0.5, 1.5), (1.0, 0.9, 0.5, 0.8), (1.0, 2.0, -1.0, 1.5)], "open double, high double, low double, close double")
    assert df.where(quality.invalid_ohlc()).count() == 3


def test_checks_raise_reason_codes(spark):
    df = frame(spark, [("a", 1, 3), ("a", 2, 2), ("a", 2, 1)], "k string, seq int, t int")
    report = quality.checks(df, "k", ["t"], ["k", "seq"], order="t", seq="seq")
    with pytest.raises(quality.CheckFailed, match="duplicate_keys, non_monotonic"):
        quality.assert_pass(report)


def test_bad_read_requests(spark):
    b = session(spark).withColumn("instrument", F.lit("a"))
    for tf in ("1d", "daily", "60m", "240m", "2h"):
        with pytest.raises(quality.CheckFailed, match="unsupported_timeframe"):
            lake.load_bars(b, tf, None, None)
    with pytest.raises(quality.CheckFailed, match="bad_columns"):
        lake.load_bars(b, "5m", None, None, ["nope"])
    with pytest.raises(quality.CheckFailed, match="missing_source_columns"):
        lake.resolve(b.drop("open"))


def test_partitioned_write_replaces_only_its_partitions(spark, tmp_path):
    root = str(tmp_path / "t")
    schema = "d string, k int, ord int, v int"
    lake.write_partitioned(frame(spark, [("x", 1, 1, 1), ("x", 1, 2, 2), ("y", 1, 1, 3)], schema), root, ["d", "k"], ["d"], ["ord"])
    lake.write_partitioned(frame(spark, [("y", 2, 1, 9)], schema), root, ["d", "k"], ["d"], ["ord"])
    got = sorted((r["d"], r["k"], r["v"]) for r in lake.scan_bars(spark, root).collect())
    assert got == [("x", 1, 2), ("y", 2, 9)]
    assert "PartitionFilters: [isnotnull(d" in lake.scan_bars(spark, root, F.col("d") == "x")._jdf.queryExecution().toString()


def test_csv_mapping(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("when;o;h;l;c\n2024-01-01 10:00:00;1;2;0.5;x\n")
    got = lake.read_ohlc_csv(spark, str(p), {"ts": "when", "open": "o", "high": "h", "low": "l", "close": "c"}, ";").collect()
    assert got[0]["open"] == 1.0 and got[0]["close"] is None
    with pytest.raises(quality.CheckFailed, match="unknown_mapping_keys"):
        lake.read_ohlc_csv(spark, str(p), {"opne": "o"})


def test_cliffs_delta_is_the_pair_count(spark):
    rng = random.Random(3)
    a, b = [rng.randrange(8) for _ in range(30)], [rng.randrange(10) for _ in range(25)]
    df = frame(spark, [("A", float(x)) for x in a] + [("B", float(x)) for x in b], "g string, m double")
    got = stats.with_p_value(stats.compare_groups(df, "g", "A", "B", ["m"])).collect()[0]
    pairs = sum((x > y) - (x < y) for x in a for y in b) / (len(a) * len(b))
    assert math.isclose(got["cliffs_delta"], pairs, abs_tol=1e-12)
    n, m = len(a), len(b)
    both = a + b
    ties = sum(both.count(v) ** 3 - both.count(v) for v in set(both))
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    sd = math.sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1))))
    assert math.isclose(got["p_value"], math.erfc((abs(u - n * m / 2) - 0.5) / sd / math.sqrt(2)), rel_tol=1e-9)


def test_hysteresis(spark):
    xs = [0.0, 0.6, -0.3, 0.05, -0.7, 0.2, 0.0]
    df = frame(spark, [("a", i, x) for i, x in enumerate(xs)], "k string, t int, x double")
    got = [r["position"] for r in signals.hysteresis(df, "k", "t", "x", 0.5, 0.1).orderBy("t").collect()]
    assert got == [0, 1, 1, 0, -1, -1, 0]


def test_brackets_stop_before_target(spark):
    rows = [("a", 0, 10.0, 10.0, 10.0, 10.0, 1.0, 1), ("a", 1, 10.0, 13.0, 8.0, 11.0, 1.0, 1), ("a", 2, 11.0, 14.0, 10.5, 13.0, 1.0, 0)]
    df = frame(spark, rows, "k string, t int, open double, high double, low double, close double, atr double, signal int")
    got = sorted(tuple(r) for r in signals.brackets(df, ["k"], "t", [(1.0, 2.0), (3.0, 9.0)]).collect())
    assert got == [("a", 1.0, 2.0, 1, 1, 1, -1.0, "stop"), ("a", 1.0, 2.0, 2, 2, 1, 2.0, "target"), ("a", 3.0, 9.0, 1, 2, 1, 3.0, "end")]


def test_runs(spark):
    df = frame(spark, [("a", i, x) for i, x in enumerate("GGBGGG")], "k string, t int, l string")
    got = blocked.runs(df, "l", ["k"], ["t"]).orderBy("t").collect()
    assert [(r["run_id"], r["run_pos"], r["place"]) for r in got] == [(1, 1, "start"), (1, 2, "end"), (2, 1, "single"), (3, 1, "start"), (3, 2, "mid"), (3, 3, "end")]


def test_stable_id_and_flags(spark):
    import hashlib

    got = frame(spark, [("x", None)], "a string, b int").select(scalar.stable_id("a", "b").alias("i"), scalar.to_bool(F.lit(" YES")).alias("y")).first()
    assert got["i"] == hashlib.sha256(b"x|None").hexdigest()[:24] and got["y"]


def test_empty_frames(spark):
    empty = frame(spark, [], "instrument string, bar_end timestamp_ntz, open double, high double, low double, close double, volume long")
    assert bars.resample(empty, "1h").count() == 0
    assert signals.ema_positions(empty, ["instrument"], "bar_end", 3, 5).count() == 0
    assert daily.daily_mode(empty, ["instrument"], "volume").count() == 0
    assert not quality.may_replace(empty, empty, "bar_end")


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = sorted(("i%d" % rng.randrange(2), t0 + dt.timedelta(seconds=rng.randrange(7200)), round(rng.random() * 10, 2), 1, 1.0, i) for i in range(200))
    rows.sort(key=lambda r: r[1])
    schema = "instrument string, ts timestamp_ntz, price double, qty long, turnover double, trade_id long"
    late = [("~", t0 + dt.timedelta(days=3), 0.0, 1, 0.0, -1)]
    for part in (rows[:90], rows[80:], late):
        frame(spark, part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = sb.tick_stream(spark, str(tmp_path / "in"), frame(spark, [], schema).schema)
    out = sb.stream_bars(s, "5 minutes", "1 hour", ids=("trade_id",))
    sb.run_to_table(out, str(tmp_path / "out"), str(tmp_path / "log"))
    cols = ["instrument", "bar_end", "open", "high", "low", "close", "volume"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("instrument <> '~'").select(*cols).collect()))
    want = sorted(map(tuple, bars.ticks_to_bars(frame(spark, rows, schema), "5 minutes").select(*cols).collect()))
    assert got == want


def test_stream_pivot_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 9)
    at = lambda d, m: t0 + dt.timedelta(days=d, minutes=m)
    rows = [(at(0, 1), "FIZ", 1.0), (at(0, 2), "YUR", -2.0), (at(0, 3), "FIZ", 3.0), (at(0, 17), "YUR", 4.0), (at(0, 18), "FIZ", None), (at(1, 2), "YUR", 5.0), (at(1, 3), "YUR", 6.0), (at(0, 4), "YUR", 7.0)]
    schema = "ts timestamp_ntz, clgroup string, pos double"
    for part in (rows[:2], rows[2:3], rows[3:6], rows[6:]):
        frame(spark, part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = sb.tick_stream(spark, str(tmp_path / "in"), frame(spark, [], schema).schema)
    sb.pivot_each_batch(s, "clgroup", ["FIZ", "YUR"], "pos", "5 minutes", str(tmp_path / "out"), str(tmp_path / "log"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "days")).select("bucket", "FIZ", "YUR", "total").collect()))
    whole = frame(spark, rows, schema).withColumn("bucket", F.window("ts", "5 minutes")["start"])
    wide = daily.pivot_last(whole, ["bucket"], "clgroup", ["FIZ", "YUR"], "pos", F.col("ts")).toPandas().set_index("bucket")
    want = []
    for _, d in wide.groupby(wide.index.date):
        d = d.sort_index()
        d = d.reindex(pd.date_range(d.index.min(), d.index.max(), freq="5min")).ffill()
        want += [(k.to_pydatetime(), *(None if pd.isna(x) else x for x in r)) for k, r in zip(d.index, d[["FIZ", "YUR", "total"]].values.tolist())]
    assert got == sorted(want) and len(got) == 5 and got[0][1:] == (3.0, 7.0, 10.0)


def test_stateful_positions_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=i), 100 + rng.random() * 10) for i in range(60)]
    schema = "instrument string, bar_end timestamp_ntz, close double"
    for k in range(3):
        frame(spark, rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sb.run_to_table(sb.stream_positions(s, 3, 6, 6, 0.1), str(tmp_path / "out"), str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values("bar_end")
    c = pd.Series([r[2] for r in rows])
    f, sl = c.ewm(span=3, adjust=False).mean(), c.ewm(span=6, adjust=False).mean()
    target = np.where(np.arange(60) >= 5, np.sign(f - sl), 0)
    position = np.r_[0, target[:-1]].astype(int)
    pnl = np.r_[0, position[:-1]] * c.diff().fillna(0) - np.abs(np.diff(np.r_[0, position])) * 0.05
    assert got["position"].tolist() == position.tolist()
    assert np.allclose(got["cum_pnl"], np.cumsum(pnl))


def test_llm_can_be_missing(tmp_path):
    """A copy without the training-data folder and its pipeline imports and has all other queries."""
    import shutil
    import subprocess

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/barwright", tmp_path / "barwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ema_backtest_day' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); print(len(q), len(e.oracle_sql()))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 150


def test_regimes_by_hand(spark):
    """Ranges 10, 10, 20, 5: ratios none, 1, 2, 0.375 of the mean before; closes and bodies decide the rest."""
    from barwright.operators import events

    rows = [("a", 1, 100.0, 110.0, 100.0, 105.0), ("a", 2, 100.0, 110.0, 100.0, 104.0), ("a", 3, 101.0, 120.0, 100.0, 118.0), ("a", 4, 100.0, 105.0, 100.0, 102.5), ("a", 5, 100.0, 140.0, 100.0, 120.0), ("a", 6, 118.0, 140.0, 100.0, 135.0)]
    got = events.regime_r(frame(spark, rows, "k string, d int, open double, high double, low double, close double"), "k", "d").orderBy("d").collect()
    assert [r["regime"] for r in got] == ["R4", "R4", "R2", "R1", "R3", "R4"]
    assert [r["range_ratio"] for r in got][:3] == [None, 1.0, 2.0]


def test_approach_states_by_hand(spark):
    """A level at 100 crossed upwards on day 6 with an ATR of 4: touches, leaves below, and days far off."""
    from barwright.operators import events

    far, touch, below = (110.0, 108.0, 109.0), (101.0, 99.0, 100.0), (99.0, 95.0, 96.0)
    cases = {"rejection": [far, touch, below, far, far], "retest": [far, far, touch, far, far], "direct": [far] * 5, None: [below, far, far, far, far]}
    days, crossings = [], []
    for k, (state, bars) in enumerate(cases.items()):
        key = str(state)
        days += [(key, d + 1, h, l, c, 4.0) for d, (h, l, c) in enumerate(bars)] + [(key, 6, 103.0, 99.0, 102.0, 4.0)]
        crossings.append((key, 6, 1, 100.0, "up", "confirmed"))
    d = frame(spark, days, "family string, d int, high double, low double, close double, atr double")
    e = frame(spark, crossings, "family string, crossed_on int, level_id int, level_price double, direction string, outcome string")
    got = {r["family"]: r["approach_state"] for r in events.approach(e, d, "family", "d", [(5, 5, 0.5)], "atr").collect()}
    assert got == {str(s): s for s in cases}


def test_checked_joins_raise(spark):
    from barwright.operators import joins
    from barwright.operators.quality import CheckFailed

    a, b = frame(spark, [(1, "x"), (2, "y")], "k int, a string"), frame(spark, [(1, "p"), (2, "q")], "k int, b string")
    assert joins.one_to_one(a, b, ["k"]).count() == joins.many_to_one(a.unionByName(a), b, ["k"]).count() / 2 == 2
    twice = b.unionByName(b.limit(1))
    for call in (lambda: joins.one_to_one(a, twice, ["k"]), lambda: joins.one_to_one(a.unionByName(a), b, ["k"]), lambda: joins.many_to_one(a, twice, ["k"]), lambda: joins.many_to_one(a, b.where("k = 1"), ["k"])):
        with pytest.raises(CheckFailed):
            call()
    w = frame(spark, [(0, 5, "early"), (5, 9, "late")], "s int, e int, name string")
    t = frame(spark, [(1,), (5,), (6,)], "t int")
    assert {(r["t"], r["name"]) for r in joins.covered_once(t, w, [], ["t"], "t", "s", "e").collect()} == {(1, "early"), (5, "early"), (6, "late")}
    for bad in (t.unionByName(frame(spark, [(10,)], "t int")), ):
        with pytest.raises(CheckFailed, match="outside_session_calendar"):
            joins.covered_once(bad, w, [], ["t"], "t", "s", "e")
    with pytest.raises(CheckFailed, match="more_than_once"):
        joins.covered_once(t, w.unionByName(frame(spark, [(4, 7, "mid")], "s int, e int, name string")), [], ["t"], "t", "s", "e")


def test_builders_are_checked(spark):
    from barwright.operators import packages
    from barwright.operators.quality import CheckFailed

    b = frame(spark, [("a", t, float(t)) for t in range(4)], "k string, t int, close double")
    ok = packages.built(b, ["k"], "t", {"x": lambda: F.col("close") * 2}, lambda d: d.withColumn("signal", (F.col("x") > 2).cast("int")))
    assert [r["position"] for r in ok.orderBy("t").collect()] == [0, 0, 0, 1]
    with pytest.raises(CheckFailed):
        packages.built(b, ["k"], "t", {}, lambda d: d)
    with pytest.raises(Exception, match="signal_outside_domain"):
        packages.built(b, ["k"], "t", {}, lambda d: d.withColumn("signal", F.lit(7))).collect()


def test_sparse_signals_take_effect_on_the_next_bar(spark):
    from barwright.operators import studies

    b = frame(spark, [("a", t, 10.0 * t, 10.0 * t + 1) for t in range(1, 6)], "k string, t int, open double, close double")
    s = frame(spark, [("a", 2, 1), ("a", 4, -1), ("a", 9, 1), ("a", 5, 0)], "k string, decision_ts int, desired_position int")
    got = studies.execute_signals(b, s, ["k"], "t", 1.0).orderBy("t").collect()
    assert [r["position"] for r in got] == [0, 0, 1, 1, -1]
    bad = {r["decision_ts"]: r["reason"] for r in studies.bad_decisions(b, s, ["k"], "t").collect()}
    assert bad == {9: "decision_not_on_a_bar", 5: "decision_on_last_bar"}


def test_stop_or_poc(spark):
    from barwright.operators import studies

    rows = [("a", 0, 10.0, 10.0, 10.0, 1.0, 1, 12.0), ("a", 1, 11.0, 9.5, 10.5, 1.0, 0, None), ("a", 2, 13.0, 10.0, 12.5, 1.0, 0, None),
            ("a", 3, 10.0, 10.0, 10.0, 1.0, -1, 8.0), ("a", 4, 11.5, 9.0, 9.0, 1.0, 0, None)]
    df = frame(spark, rows, "k string, t int, high double, low double, close double, atr double, signal int, poc double")
    got = sorted(tuple(r) for r in studies.stop_or_poc(df, "k", "t", 1.0).collect())
    assert got == [("a", 0, 2, 1, 2.5, "poc"), ("a", 3, 4, -1, -1.0, "stop")]


def test_refresh_stops_at_a_failed_check(spark, tmp_path):
    from barwright.operators import studies

    d = dt.date(2024, 1, 2)
    bad = frame(spark, [("a", d, 1.0, 0.5, 0.4, 0.9)], "instrument string, trade_date date, open double, high double, low double, close double")
    c = frame(spark, [("a", "a_1", d)], "family string, secid string, anchor date")
    with pytest.raises(quality.CheckFailed, match="invalid_ohlc"):
        studies.refresh(spark, str(tmp_path), bad, c, "trade_date")


def test_guarded_refresh(spark):
    old = frame(spark, [(1,), (5,)], "t int")
    assert quality.may_replace(frame(spark, [(5,)], "t int"), old, "t")
    assert not quality.may_replace(frame(spark, [(4,)], "t int"), old, "t")


def test_names(spark):
    assert lake.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a#2", "a#3"]
    df = frame(spark, [(1, 2, 3)], "x int, pre_1 int, other int")
    assert lake.select_existing(df, ["x", "nope"], ("pre_",)).columns == ["x", "pre_1"]
