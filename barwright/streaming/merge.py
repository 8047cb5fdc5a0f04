"""Streams whose rows wait for others: two live feeds met as of their times, and bars made of three parts.

Both keep what waits in the state store and set event-time timers, so they need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Why a coarse bar can't be given.
MISSING, MISALIGNED, CONFLICTING, BAD_RANGE = "missing_part", "misaligned_part", "conflicting_part", "invalid_range"


def _ms(ts: pd.Timestamp) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class _AsOf(StatefulProcessor):
    """Per key the rows of both feeds that the watermark hasn't passed, and the last value that it has.

    One timer is set, for the earliest waiting left row; when it fires, all left rows before the watermark
    are given, and of the right rows before it only the last is kept.
    """

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        spec = "at_us bigint, tie_rank bigint, payload string"
        self.sides = [handle.getListState(name, spec) for name in ("left", "right")]
        self.timer = handle.getValueState("timer", "at bigint")

    def _set(self, at: int) -> None:
        if self.timer.exists():
            known = self.timer.get()[0]
            if known <= at:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [r for r in rows if len(r)]
        if not frames:
            return  # called for a timer alone
        pdf = pd.concat(frames)
        for side, state in enumerate(self.sides):
            mine = pdf[pdf["feed_side"] == side]
            if len(mine):
                state.appendList(list(zip(mine["at_us"].tolist(), mine["tie_rank"].tolist(), mine["payload"].tolist())))
                if side == 0:
                    self._set(int(mine["at_us"].min()) // 1000 + 1)
        yield self._rows([])

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.keys, "at_us", "left_row", "right_row"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # rows before it can't come any more
        left, right = (sorted(map(tuple, side.get())) if side.exists() else [] for side in self.sides)
        ready, wait = [r for r in left if r[0] < passed], [r for r in left if r[0] >= passed]
        at = np.array([r[0] for r in right], dtype=np.int64)
        found = np.searchsorted(at, np.array([r[0] for r in ready], dtype=np.int64), side="right") - 1
        out = [(*key, r[0], r[2], right[k][2] if k >= 0 else None) for r, k in zip(ready, found)]
        kept = right[max(0, int(np.searchsorted(at, passed)) - 1) :]
        for state, rest in zip(self.sides, (wait, kept)):
            state.clear()
            if rest:
                state.put(rest)
        self.timer.clear()
        if wait:
            self._set(wait[0][0] // 1000 + 1)
        yield self._rows(out)

    def close(self) -> None:
        pass


def asof_streams(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], late: str) -> DataFrame:
    """Each row of one live feed with another live feed's last ``values`` of its key at or before its time.

    A row is given once the watermark, ``late`` behind the newest row of either feed, has passed it: until then
    rows of the right feed may come in any order, and a right feed that falls silent holds nothing back (its last
    value is carried forward; a key without any gets nulls). Rows of either feed that come after the watermark has
    passed their time are dropped. Of right rows of one time the one whose values hash highest counts. Keys must not be
    null. State: a key's rows of the time since the watermark, and one right row.
    """
    kinds = dict(left.dtypes)
    mine = [(c, t) for c, t in left.dtypes if c not in (*keys, ts)]
    theirs = [(c, t) for c, t in right.dtypes if c in values]
    # payloads travel as text that Spark writes and reads: no value changes its type on the way through Python
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

    def feed(df: DataFrame, side: int, fields: list[tuple[str, str]], rank) -> DataFrame:
        at = F.col(ts).cast("timestamp")
        packed = F.to_json(F.struct(F.lit(side).alias("feed_side"), *(F.col(c) for c, _ in fields)), exact)
        return df.select(*keys, at.alias("at"), F.unix_micros(at).alias("at_us"), F.lit(side).alias("feed_side"), rank.alias("tie_rank"), packed.alias("payload"))

    both = feed(left, 0, mine, F.lit(0).cast("long")).unionByName(feed(right, 1, theirs, F.xxhash64(*values)))
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "at_us bigint, left_row string, right_row string"])
    met = both.withWatermark("at", late).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_AsOf(keys), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )

    def unpacked(column: str, fields: list[tuple[str, str]]):
        spec = ", ".join(f"`{c}` {t}" for c, t in [("feed_side", "int"), *fields])
        return (F.from_json(column, spec, exact)[c].alias(c) for c, _ in fields)

    at = F.timestamp_micros("at_us").cast(kinds[ts]).alias(ts)
    return met.select(*keys, at, *unpacked("left_row", mine), *unpacked("right_row", theirs))


class _Parts(StatefulProcessor):
    """Per key and bucket its parts by slot. The bar is given when the last part comes; a timer at the bucket's
    end says why, if it hasn't been."""

    def __init__(self, key: str, needed: int, step_us: int):
        self.key, self.needed, self.step = key, needed, step_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slot int", "open double, high double, low double, close double")
        self.said = handle.getValueState("said", "given boolean, reason string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [r for r in rows if len(r)]
        if not frames:
            return  # called for a timer alone
        pdf = pd.concat(frames).sort_values("at_us")
        given, reason = self.said.get() if self.said.exists() else (False, None)
        if not self.said.exists():
            self.handle.registerTimer(int(pdf["start_us"].iloc[0]) // 1000 + self.needed * self.step // 1000 + 1)
        known = {k[0]: tuple(v) for k, v in self.parts.iterator()}
        before = dict(known)
        for us, start, *bar in pdf[["at_us", "start_us", "open", "high", "low", "close"]].itertuples(index=False):
            slot, rest = divmod(int(us - start), self.step)
            bar = tuple(map(float, bar))
            if rest:
                reason = reason or MISALIGNED
            elif known.setdefault(slot, bar) != bar:
                reason = reason or CONFLICTING
        out = []
        if not given and not reason and len(known) == self.needed:
            parts = [known[k] for k in sorted(known)]
            high, low = max(p[1] for p in parts), min(p[2] for p in parts)
            if low <= 0 or high < low:
                reason = BAD_RANGE
            else:
                given = True
                out.append((*key, parts[0][0], high, low, parts[-1][3], self.needed, None))
        for slot, bar in known.items():
            if slot not in before:
                self.parts.updateValue((slot,), bar)
        self.said.update((given, reason))
        yield self._rows(out)

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "bucket", "open", "high", "low", "close", "parts", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        given, reason = self.said.get()
        parts = sum(1 for _ in self.parts.keys())
        self.parts.clear()
        self.said.clear()
        yield self._rows([] if given else [(*key, None, None, None, None, parts, reason or MISSING)])

    def close(self) -> None:
        pass


def complete_bars(bars: DataFrame, part: str, needed: int, late: str, key: str = "instrument") -> DataFrame:
    """Coarser bars out of ``needed`` right-labelled parts of length ``part`` each, labelled with their start.

    The bar is given, with a null reason, as soon as its last part has come. Once the watermark has passed the
    bucket's end without that, a row without prices says why: missing_part, misaligned_part (a part that ends
    between the borders), conflicting_part (one slot with two different bars, before the bar was given) or
    invalid_range (lowest low not above 0, or above the highest high). parts is how many slots had come. Repeats of
    a part change nothing; parts later than the watermark are dropped.
    """
    kinds = dict(bars.dtypes)
    step = pd.Timedelta(part).value // 1000
    at = F.col("bar_end").cast("timestamp")
    # a part ends in the bucket whose start lies less than ``needed`` steps before it
    us = F.unix_micros(at) - step
    start = F.floor(us / F.lit(step * needed)).cast("long") * (step * needed)
    rows = bars.select(
        key, F.timestamp_micros(start).cast(kinds["bar_end"]).alias("bucket"), at.alias("at"), start.alias("start_us"),
        us.alias("at_us"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")),
    )
    out = f"`{key}` {kinds[key]}, bucket {kinds['bar_end']}, open double, high double, low double, close double, parts int, reason string"
    return rows.withWatermark("at", late).groupBy(key, "bucket").transformWithStateInPandas(
        statefulProcessor=_Parts(key, needed, step), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )
