"""Centroid clustering by Shallot search, in integers.

Every vector keeps the numbers of its nearest and second-nearest centroid, an upper bound of its distance
to the first and a lower bound of its distance to all others. When centroids have moved, the bounds are
loosened by how far; a vector whose bounds still lie apart stays where it is without any distance being
computed. The others compute the distances to the two remembered centroids and start from the closer one:
with the distance u to it and the distance s to the second best so far, any centroid that could be nearest
or second nearest lies within u + s of the starting centroid, so its neighbours are scanned in order of
their distance to it until that ball is left, and the ball shrinks whenever the second best improves.
Bounds are doubles with a margin; what is not settled by them is compared in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm import lattice, shared

#: Relative margin by which bounds must lie apart to count: far above the error of the sums of doubles.
MARGIN = 1e-9


class Centroids:
    """The centroids of one round, their neighbours in order of distance, and how far they moved."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points
        k = len(points)
        apart = np.sqrt(np.array([lattice.squares(points, p) for p in points], dtype=np.float64).reshape(k, k))
        np.fill_diagonal(apart, -1.0)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        #: Half the distance to the nearest other centroid: vectors nearer than that have no nearer one.
        self.half = self.apart[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(lattice.squares(points, before).astype(np.float64))
        self.moved = moved
        top = np.sort(moved)[::-1]
        #: The farthest move of any other centroid.
        self.others = np.where(moved == top[0], top[1] if k > 1 else 0.0, top[0]) if k else moved
        if k > 1 and (moved == top[0]).sum() > 1:
            self.others = np.full(k, top[0])


def scan_all(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, ...]:
    """(nearest, second, squared distance to each) of every row; of equal distances the smaller number is nearer."""
    d = np.stack([lattice.squares(x, p) for p in c.points], axis=1)
    a = d.argmin(axis=1)
    da = d[np.arange(len(x)), a]
    if len(c.points) == 1:
        return a, a, da, np.full(len(x), -1)
    d[np.arange(len(x)), a] = np.iinfo(np.int64).max
    b = d.argmin(axis=1)
    return a, b, da, d[np.arange(len(x)), b]


def search(x: np.ndarray, c: Centroids, a: np.ndarray, b: np.ndarray, u: np.ndarray, low: np.ndarray) -> tuple[tuple[np.ndarray, ...], int]:
    """(nearest, second, upper bound, lower bound) of every row after a move, and how many distances it took.

    a, b, u and low are what held before the move.
    """
    a, b = a.copy(), b.copy()
    u = u + c.moved[a]
    low = low - c.others[a]
    if len(c.points) == 1:
        return (a, b, u, low), 0

    def settled(u: np.ndarray, low: np.ndarray, a: np.ndarray) -> np.ndarray:
        return u * (1 + MARGIN) + MARGIN < np.maximum(low, c.half[a]) * (1 - MARGIN)

    rows = np.flatnonzero(~settled(u, low, a))
    taken = len(rows)
    own = lattice.squares(x[rows], c.points[a[rows]])
    u[rows] = np.sqrt(own)
    open_ = ~settled(u[rows], low[rows], a[rows])
    rows, own = rows[open_], own[open_]
    y, m, s = x[rows], a[rows], b[rows]
    other = lattice.squares(y, c.points[s])
    taken += len(rows)
    closer = (other < own) | (other == own) & (s < m)
    m, s = np.where(closer, s, m), np.where(closer, m, s)
    best, second = np.where(closer, other, own), np.where(closer, own, other)
    start, radius = m.copy(), np.sqrt(best)
    asked = np.where(closer, a[rows], b[rows])  # of the two remembered ones, the one that isn't the start
    live = np.arange(len(rows))
    for k in range(len(c.points) - 1):
        reach = (radius[live] + np.sqrt(second[live])) * (1 + MARGIN) + MARGIN
        live = live[c.apart[start[live], k] <= reach]
        if not len(live):
            break
        t = c.order[start[live], k]
        i, t = live[t != asked[live]], t[t != asked[live]]
        d = lattice.squares(y[i], c.points[t])
        taken += len(i)
        first = (d < best[i]) | (d == best[i]) & (t < m[i])
        next_ = ~first & ((d < second[i]) | (d == second[i]) & (t < s[i]))
        f, n = i[first], i[next_]
        second[f], s[f] = best[f], m[f]
        best[f], m[f] = d[first], t[first]
        second[n], s[n] = d[next_], t[next_]
    a[rows], b[rows] = m, s
    u[rows], low[rows] = np.sqrt(best), np.sqrt(second)
    return (a, b, u, low), taken


_STATE = "id {kind}, x array<long>, a int, b int, u double, low double"


def _assigned(rows: DataFrame, now: Centroids, dim: int, fresh: bool, last: bool) -> DataFrame:
    """The rows with their nearest centroid a, second b and bounds; with d, the squared distance, if ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = lattice.matrix(batch.column(1), dim)
            if fresh:
                a, b, best, second = scan_all(x, now)
                u, low = np.sqrt(best), np.where(second < 0, np.inf, np.sqrt(np.abs(second)))
            else:
                (a, b, u, low), _ = search(x, now, *(batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)))
            if last:
                out = [batch.column(0), pa.array(a, pa.int32()), pa.array(lattice.squares(x, now.points[a]), pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["id", "a", "d"])
            else:
                kept = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(u, pa.float64()), pa.array(low, pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *kept], names=["id", "x", "a", "b", "u", "low"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, a int, d long" if last else _STATE.format(kind=kind))


def starts(rows: DataFrame, k: int, dim: int, salt: str) -> np.ndarray:
    """The k vectors of smallest SHA-256 of salt and id, null ids last, of equal ids by components."""
    hashed = rows.select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "x")
    found = hashed.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in found], dtype=np.int64).reshape(-1, dim)


def cluster(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    scale: int = 64,
    dim: int = 64,
    salt: str = "1:",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Of every vector its cluster, squared distance, the cluster's and all vectors' sums of distances, and the
    SHA-256 of its final centroid's components.

    Vectors are kept that have ``dim`` components, none null or non-finite; component x counts as floor(scale * x).
    The first centroids are k kept vectors (``starts``; fewer vectors make fewer clusters). In each round every
    vector goes to the nearest centroid, ties to the smaller number, then a centroid becomes the componentwise
    floor of its vectors' mean, an empty one staying as it is; after the last round vectors are assigned once more.

    Equal vectors, repeated and null ids have a row each; an empty table gives no rows. Other columns, whatever their names, are ignored.
    Components too large for a long's squared distance raise. Each round's rows go to the shared folder; the
    driver sees the centroids alone (k times dim numbers).
    """
    spark = vectors.sparkSession
    kept = vectors.where(lattice.whole(vector_col) & (F.size(vector_col) == dim))
    rows = shared.stored(kept.select(F.col(id_col).alias("id"), lattice.floored(vector_col, scale).alias("x")))
    points = starts(rows, k, dim, salt)
    before, fresh = None, True
    for _ in range(rounds if len(points) else 0):
        now = Centroids(points, before)
        rows = shared.stored(_assigned(rows, now, dim, fresh, False))
        sums = lattice.sums_by_group(rows.select("a", "x"), lambda b: (b.column(0).to_numpy(), lattice.matrix(b.column(1), dim)), dim)
        before, fresh = points, False
        points = np.array([[t // sums[j][0] for t in sums[j][1]] if j in sums else list(p) for j, p in enumerate(points)])
    kind = rows.schema["id"].dataType.simpleString()
    if len(points):
        final = shared.stored(_assigned(rows, Centroids(points, before), dim, fresh, True))
    else:
        final = spark.createDataFrame([], f"id {kind}, a int, d long")
    inertia = {r["a"]: r["s"] for r in final.groupBy("a").agg(F.sum("d").alias("s")).collect()}  # at most k rows
    hashed = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]
    table = [(j, inertia[j], sum(inertia.values()), hashed[j]) for j in inertia]
    known = spark.createDataFrame(table, "a int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = final.join(F.broadcast(known), "a")  # at most k rows
    return joined.select(
        F.col("id").alias(id_col), F.col("a").alias("cluster"), F.col("d").alias("distance"),
        "cluster_inertia", "inertia", "centroid_sha256",
    )
