"""Every registered query with a SQL twin gives the same rows on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from barwright import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return f"{round(v, 5) + 0.0:.5f}"
    if isinstance(v, (list, tuple)):
        return f"[{','.join(map(plain, v))}]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    df = plans.QUERIES[name](spark, SF)
    assert df.columns and len(df.collect()) > 0


def test_every_session_is_expanded(spark):
    from barwright.sources import views

    want = {(r["trade_date"], 48) for r in views.sessions(spark, SF).collect()}
    got = plans.QUERIES["expected_bars_calendar"](spark, SF).groupBy("trade_date").count().collect()
    assert set(map(tuple, got)) == want and len({d.year for d, _ in want}) > 1
