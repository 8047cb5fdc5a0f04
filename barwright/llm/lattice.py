"""Vectors rounded down to integers, and sums of them by group, for operators that compare in integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def whole(vector: str):
    """True for vectors that aren't null and whose components are all finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad, F.lit(False))


def floored(vector: str, scale: int):
    """Each component x as floor(scale * x), x as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column, all of length dim. Components whose squared distances may not fit 64 bits raise."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    most = int((2.0**62 / max(1, dim)) ** 0.5 / 2)
    if len(flat) and (flat.max() > most or flat.min() < -most):
        raise ValueError(f"a component beyond {most} after scaling: squared distances would not fit a long")
    return flat.reshape(-1, dim)


def sums_by_group(rows: DataFrame, groups_of, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Of each group its count and its componentwise sum, both exact; the groups must be few and known.

    ``groups_of`` gives of an Arrow batch (group numbers, integer vectors). Each partition adds up its own
    rows, so a task sends one row per group and component, and no group's rows come together.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for b in batches:
            group, x = groups_of(b)
            order = np.argsort(group, kind="stable")
            found, at = np.unique(group[order], return_index=True)
            if not len(found):
                continue
            added = np.add.reduceat(x[order], at, axis=0)
            for g, n, s in zip(found.tolist(), np.diff(np.append(at, len(group))).tolist(), added):
                count[g] = count.get(g, 0) + n
                total[g] = total[g] + s if g in total else s
        at = list(total)
        columns = [pa.array(at, pa.int64()), pa.array([count[g] for g in at], pa.int64())]
        listed = pa.array([total[g].tolist() for g in at], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*columns, listed], names=["g", "n", "s"])

    sent = rows.mapInArrow(partial, "g long, n long, s array<long>")
    summed = sent.select("g", "n", F.posexplode("s").alias("i", "s")).groupBy("g", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in summed.collect():  # groups times components
        out.setdefault(r["g"], (r["n"], [0] * dim))[1][r["i"]] = r["s"]
    return out


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to y (one vector, or a row each), exact."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)
