"""Streams whose rows wait for others: restarts, late rows, missing sides, broken buckets."""

import datetime as dt
import random

import pytest

from barwright.operators import joins
from barwright.streaming import bars as sb, merge as sm

T0 = dt.datetime(2024, 1, 1)
LEFT, RIGHT = "k string, ts timestamp_ntz, id long, note string", "k string, ts timestamp_ntz, v double, n long"


def minutes(m):
    return T0 + dt.timedelta(minutes=m)


def add(spark, rows, spec, path):
    spark.createDataFrame(rows, spec).coalesce(1).write.mode("append").parquet(path)


def test_two_feeds_meet_as_the_batch_join_does_over_a_restart(spark, tmp_path):
    rng = random.Random(3)
    left = [(rng.choice("ab"), minutes(3 * i), 2**60 + i, None if i % 5 else "x") for i in range(40)]
    right = [("a", minutes(5 * i + 1), i / 3, None if i % 2 else 2**61 + i) for i in range(24)]  # b never has any
    folders = {side: f"file://{tmp_path}/{side}" for side in ("left", "right", "out", "log")}

    def run():
        feeds = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(folders[f]) for f, s in (("left", LEFT), ("right", RIGHT))]
        sb.run_to_table(sm.asof_streams(*feeds, ["k"], "ts", ["v", "n"], "60 minutes"), folders["out"], folders["log"])

    # the right feed is half an hour behind, and each half of both comes before a restart
    for part in (slice(0, 20), slice(20, 40)):
        add(spark, left[part], LEFT, folders["left"])
        some = right[:10] if part.start == 0 else right[10:]
        add(spark, some[::-1], RIGHT, folders["right"])
        run()
    first = spark.read.parquet(folders["out"]).count()
    assert 0 < first < len(left)  # the newest rows still wait for the watermark
    add(spark, [("z", minutes(10_000), 0, None)], LEFT, folders["left"])
    add(spark, [("a", minutes(1), -1.0, -1)], RIGHT, folders["right"])  # far too late: dropped
    run()
    got = sorted((r["id"], r["k"], r["ts"], r["note"], r["v"], r["n"]) for r in spark.read.parquet(folders["out"]).where("k <> 'z'").collect())
    l, r = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    want = sorted((x["id"], x["k"], x["ts"], x["note"], x["v"], x["n"]) for x in joins.asof(l, r, ["k"], "ts", ["v", "n"]).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4:] for g in got] == [w[4:] for w in want] and any(g[4] is None for g in got)


BAR = "instrument string, bar_end timestamp_ntz, open double, high double, low double, close double"


def bar(name, m, o=5.0, h=7.0, l=4.0, c=6.0):  # noqa: E741
    return (name, minutes(m), o, h, l, c)


def test_quarter_hours_are_given_or_refused_over_a_restart(spark, tmp_path):
    folders = {f: f"file://{tmp_path}/{f}" for f in ("in", "out", "log")}

    def run(rows):
        add(spark, rows, BAR, folders["in"])
        s = spark.readStream.schema(BAR).option("maxFilesPerTrigger", 1).parquet(folders["in"])
        sb.run_to_table(sm.complete_bars(s, "5 minutes", 3, "30 minutes"), folders["out"], folders["log"])
        return {(r["instrument"], r["bucket"]): r for r in spark.read.schema("instrument string, bucket timestamp_ntz, open double, high double, low double, close double, parts int, reason string").parquet(folders["out"]).collect()}

    got = run([
        bar("whole", 10, h=9.0), bar("whole", 5, o=4.5), bar("late", 5), bar("late", 15), bar("lost", 5), bar("lost", 10),
        bar("odd", 5), bar("odd", 7), bar("odd", 10), bar("odd", 15), bar("two", 5), bar("two", 5, c=6.5), bar("two", 10), bar("two", 15),
        bar("bad", 5, l=0.0), bar("bad", 10), bar("bad", 15),
    ])
    assert not got  # nothing is complete, and no bucket has passed
    got = run([bar("whole", 15, c=5.5), bar("whole", 15, c=5.5), bar("late", 10)])
    assert set(got) == {("whole", T0), ("late", T0)}  # given as the third part came
    whole = got["whole", T0]
    assert (whole["open"], whole["high"], whole["low"], whole["close"], whole["parts"], whole["reason"]) == (4.5, 9.0, 4.0, 5.5, 3, None)
    got = run([bar("~", 10_000)])
    assert {k[0]: (r["reason"], r["parts"]) for k, r in got.items()} == {
        "whole": (None, 3), "late": (None, 3), "lost": ("missing_part", 2), "odd": ("misaligned_part", 3),
        "two": ("conflicting_part", 3), "bad": ("invalid_range", 3),
    }
    assert got["lost", T0]["open"] is None
    assert len(run([bar("lost", 15)])) == 6  # later than the watermark


@pytest.mark.parametrize("name", ["stream_enriched", "stream_complete_15m"])
def test_queries_leave_the_session_as_it_is(spark, name):
    from barwright import plans

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    plans.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert spark.conf.get(setting) == before


def test_five_minute_bars_are_computed_once_for_all_spans(spark, monkeypatch):
    from barwright.plans import stream_queries

    class Seen(Exception):
        pass

    def seen(df, ts, path):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(stream_queries, "_in_order", seen)
    with pytest.raises(Seen) as plan:
        stream_queries._quarters(spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in str(plan.value)
