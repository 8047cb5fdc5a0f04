"""Walk-forward segments against pandas, one segment after the other."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barwright.operators import signals
from barwright.operators.quality import CheckFailed

from pyspark.sql import functions as F

PAIRS = [(2, 5), (3, 9)]


def bars(first="2020-01-01", days=260, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for name in ("a", "b"):
        at = pd.date_range(first, periods=days, freq="D")
        close = 100 + rng.normal(size=days).cumsum()
        close[40:60] = close[40]  # equal averages
        opened = close + rng.normal(size=days)
        rows += [(name, d.date(), float(o), float(c)) for d, o, c in zip(at, opened, close)]
    return rows


def by_hand(pdf, fast, slow, mode, fee, near_zero):
    """Averages from the segment's first close, position of the bar before, open to open, closed at the last close."""
    pdf = pdf.sort_values("ts").reset_index(drop=True)
    gap = pdf.close.ewm(span=fast, adjust=False).mean() - pdf.close.ewm(span=slow, adjust=False).mean()
    gap[gap.abs() < 1e-9] = 0
    low, high = {"both": (-1, 1), "long": (0, 1), "short": (-1, 0)}[mode]
    position = np.sign(gap).clip(low, high).shift(1).fillna(0)
    trades = position.diff().abs().fillna(position.abs())
    pnl = position * (pdf.open.shift(-1).fillna(pdf.close.iloc[-1]) - pdf.open) - trades * fee
    pnl.iloc[-1] -= abs(position.iloc[-1]) * fee
    equity = pnl.cumsum()
    return {
        "days": len(pnl), "trades": int(trades.sum()), "mean_pnl": pnl.mean(), "total_pnl": pnl.sum(), "win_rate": (pnl > 0).mean(),
        "near_zero_rate": (pnl.abs() <= near_zero).mean(), "max_drawdown": (equity - equity.cummax()).min(),
    }


@pytest.mark.parametrize("mode", ["both", "long", "short"])
def test_every_segment_starts_anew(spark, mode):
    rows = bars()
    df = spark.createDataFrame(rows, "k string, ts date, open double, close double")
    got = signals.walk_forward_segments(df, "k", "ts", PAIRS, 0.3, F.col("ts"), 3, 2, 1, mode, near_zero=0.2).collect()
    assert {r["window_id"] for r in got} == {"w001", "w002", "w003", "w004"} and len(got) == 2 * 4 * 2 * len(PAIRS)
    pdf = pd.DataFrame(rows, columns=["k", "ts", "open", "close"])
    for r in got:
        until = (pd.Timestamp(r["month_to"]) + pd.offsets.MonthEnd(0)).date()
        mine = pdf[(pdf.k == r["k"]) & (pdf.ts >= r["month_from"]) & (pdf.ts <= until)]
        for name, value in by_hand(mine, r["fast"], r["slow"], mode, 0.3, 0.2).items():
            assert r[name] == pytest.approx(value, abs=1e-9), (r, name)


def test_best_pair_is_that_of_the_training_months(spark):
    df = spark.createDataFrame(bars(seed=2), "k string, ts date, open double, close double")
    seg = signals.walk_forward_segments(df, "k", "ts", PAIRS, 0.0, F.col("ts"), 3, 2, 1)
    all_, best = seg.collect(), signals.best_by_window(seg, "k").collect()
    assert len(best) == 8
    for b in best:
        mine = [r for r in all_ if (r["window_id"], r["k"], r["role"]) == (b["window_id"], b["k"], "train")]
        top = max(mine, key=lambda r: (round(r["mean_pnl"], 6), round(r["win_rate"], 6), round(r["max_drawdown"], 6), -r["fast"], -r["slow"]))
        assert (b["fast"], b["slow"], b["train_total_pnl"]) == (top["fast"], top["slow"], top["total_pnl"])
        valid = [r for r in all_ if (r["window_id"], r["k"], r["role"], r["fast"], r["slow"]) == (b["window_id"], b["k"], "valid", b["fast"], b["slow"])]
        assert [b["valid_max_drawdown"], b["valid_trades"]] == [valid[0]["max_drawdown"], valid[0]["trades"]]


def test_only_full_months_count(spark):
    cut = [r for r in bars("2020-01-02", 100) if r[1].month != 3]
    df = spark.createDataFrame(cut, "k string, ts date, open double, close double")
    windows = signals.month_windows(df, "k", "ts", 1, 1, 1)
    assert windows.isEmpty()  # January begins late, March has no bars, April isn't over
    with pytest.raises(CheckFailed):
        signals.walk_forward_segments(df, "k", "ts", PAIRS, 0.0, F.col("ts"), 1, 1, 1)
    df = spark.createDataFrame(bars("2019-12-31", 125), "k string, ts date, open double, close double")
    got = {(r["window_id"], r["role"]): r["month_from"] for r in signals.month_windows(df.where("k = 'a'"), "k", "ts", 2, 1, 1).collect()}
    assert got == {
        ("w001", "train"): dt.date(2020, 1, 1), ("w001", "valid"): dt.date(2020, 3, 1),
        ("w002", "train"): dt.date(2020, 2, 1), ("w002", "valid"): dt.date(2020, 4, 1),
    }


def test_bars_without_a_close_have_no_signal_of_their_own(spark):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=k), 10.0 + k, None if k in (0, 5) else 10.0 + (k * 7) % 5) for k in range(92)]
    df = spark.createDataFrame(rows, "k string, ts date, open double, close double")
    got = signals.walk_forward_segments(df, "k", "ts", [(2, 5)], 0.0, F.col("ts"), 2, 1, 1).where("role = 'train'").first()
    assert got["days"] == 60 and got["trades"] > 0
