"""Exact top-k by inner product: dual-tree search over cover trees.

The upper tree is laid by pivots: every vector belongs to the cell of its nearest pivot, cells are cut
into blocks of data and groups of queries, and each of these has its pivot as centre, a covering radius
and a largest norm. Below, a task builds a cover tree of its block and of each query group: a node's
centre is one of its points, its radius covers them all, and its children's centres are a net of its
points, each child lying within half of its radius. A pair of a query node and a data node can't hold a
score above <c_q, c_d> + r_q |c_d| + r_d |c_q| + r_q r_d, and goes when that is below the worst k-th
score of the query node. A first round meets every query with one block of its own cell; the k-th scores
found there spare the second round whole cells, then whole blocks, then nodes.

A block's rows go to one task once, followed by the query groups it has to answer, one after the other;
so what is copied is queries, and a task holds one block and one group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from barwright.llm import shared

#: Cells at most, around pivots taken from the vectors of least hash; rows of a data block and of a query group.
PIVOTS, DATA_BLOCK, QUERY_GROUP = 512, 8192, 2048
#: Points of a leaf; centres that a net may take. A node that so many can't cover at half its radius is a
#: leaf of any size: its points lie alike far from each other, and no tree over them would spare anything.
LEAF, FANOUT = 256, 128
#: Queries and points of one product of matrices.
_TALL, _WIDE = 256, 4096
_NO_ID = np.iinfo(np.int64).max


class CoverTree:
    """Nodes (centre point, covering radius, children or points), root first."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        self.x = x
        self.centre, self.radius, self.children, self.points = [], [], [], []
        todo = [(-1, np.arange(len(x)))]
        while todo:
            parent, points = todo.pop()
            far = np.linalg.norm(x[points] - x[points[0]], axis=1)
            me = len(self.centre)
            self.centre.append(x[points[0]])
            self.radius.append(float(far.max()))
            self.children.append([])
            self.points.append(points)
            if parent >= 0:
                self.children[parent].append(me)
            if len(points) <= leaf or self.radius[me] == 0:
                continue
            near, owner, count = far.copy(), np.zeros(len(points), np.int64), 1
            while near.max() > self.radius[me] / 2 and count < fanout:  # the farthest point becomes a centre
                pick = int(near.argmax())
                d = np.linalg.norm(x[points] - x[points[pick]], axis=1)
                owner[d < near] = count
                near = np.minimum(near, d)
                count += 1
            if near.max() > self.radius[me] / 2:
                continue
            for k in range(count):
                own = np.flatnonzero(owner == k)
                own = own[np.argsort(near[own], kind="stable")]  # its centre leads
                todo.append((me, points[own]))
        self.size = np.array([np.linalg.norm(c) for c in self.centre])


class Best:
    """The k best (score, least id first) of each query so far; scores below ``low`` don't count."""

    def __init__(self, n: int, k: int, low: np.ndarray | None = None):
        self.score = np.full((n, k), -np.inf) if low is None else np.repeat(low[:, None], k, axis=1)
        self.id = np.full((n, k), _NO_ID)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        some = np.flatnonzero((scores >= self.score[rows, -1:]).any(axis=0))
        s = np.hstack([self.score[rows], scores[:, some]])
        i = np.hstack([self.id[rows], np.broadcast_to(ids[some], (len(rows), len(some)))])
        if s.shape[1] > 4 * k:  # all that can be among the best, ties included
            worst = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            width = int((s >= worst[:, None]).sum(axis=1).max())
            keep = np.argpartition(-s, width - 1, axis=1)[:, :width] if width < s.shape[1] else None
            if keep is not None:
                s, i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(queries: np.ndarray, query_ids: np.ndarray, d: CoverTree, data_ids: np.ndarray, k: int, low: np.ndarray | None = None) -> Best:
    """The k best data rows of each query that score ``low`` or more, those with its own id left out."""
    best, q = Best(len(queries), k, low), CoverTree(queries)

    def bound(a: int, b: int) -> float:
        exact = float(q.centre[a] @ d.centre[b])
        return exact + q.radius[a] * d.size[b] + d.radius[b] * q.size[a] + q.radius[a] * d.radius[b] + 1e-6 * (1 + abs(exact))

    heap = [(-bound(0, 0), 0, 0)]
    while heap:
        top, a, b = heapq.heappop(heap)
        rows = q.points[a]
        if -top < best.score[rows, -1].min():
            continue
        if not q.children[a] and not d.children[b]:
            for lo in range(0, len(rows), _TALL):
                part = rows[lo : lo + _TALL]
                for at in range(0, len(d.points[b]), _WIDE):
                    cols = d.points[b][at : at + _WIDE]
                    s = queries[part] @ d.x[cols].T
                    s[query_ids[part][:, None] == data_ids[cols][None, :]] = -np.inf
                    best.add(part, s, data_ids[cols])
            continue
        split_query = q.children[a] and (not d.children[b] or q.radius[a] > d.radius[b])
        for c in q.children[a] if split_query else d.children[b]:
            pair = (c, b) if split_query else (a, c)
            heapq.heappush(heap, (-bound(*pair), *pair))
    return best


def scaled(vector: str, scale: int = 256):
    """Components times scale, rounded down, as doubles that hold integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == n[0]).all():
        return flat.reshape(len(n), -1)
    out = np.zeros((len(n), int(n.max()) if len(n) else 0))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class Layout:
    """Vectors in cells, blocks and groups, as stored tables, and their centres, radii and norms."""

    def __init__(self, rows: DataFrame, every: int, pivots: int, data_block: int, query_group: int):
        spark, n = rows.sparkSession, rows.count()
        self.points = _pivots(rows, n, min(pivots, max(1, -(-4 * n // data_block))))
        sent = spark.sparkContext.broadcast(self.points)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            points = sent.value
            for b in batches:
                p, x = _same_width(points, _matrix(b.column(1)))
                square = (p**2).sum(axis=1)[None, :] - 2 * x @ p.T
                cell = square.argmin(axis=1)
                apart = np.linalg.norm(x - p[cell], axis=1)
                size = np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(cell.astype(np.int32)), pa.array(apart), pa.array(size)], names=["id", "x", "row", "cell", "apart", "size"]
                )

        placed = shared.stored(rows.mapInArrow(place, "id long, x array<double>, row long, cell int, apart double, size double"))
        asking = placed.where(F.col("id") % every == 0).groupBy("id", "x", "cell", "apart", "size").agg(F.min("row").alias("row"))
        self.data, self.blocks = _cut(placed, "block", data_block)
        asked, groups = _cut(asking, "grp", query_group)
        self.groups = groups
        # a query's first block is one of its own cell's
        per = self.blocks.groupBy("cell").agg(F.collect_list("block").alias("_b"))
        self.asked = shared.stored(
            asked.join(F.broadcast(per), "cell").withColumn("home", F.expr("_b[pmod(xxhash64(row), size(_b))]")).drop("_b")
        )


def _pivots(rows: DataFrame, n: int, pivots: int) -> np.ndarray:
    """Different vectors of least hash; the share of hashes looked at holds many times as many rows."""
    share = min(1.0, 64.0 * pivots / max(n, 1))
    some = rows.select("x", F.xxhash64("x").alias("h")).where(F.col("h") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)))
    got = some.groupBy("h").agg(F.min("x").alias("x")).orderBy("h").limit(pivots).collect()
    if not got:
        got = rows.select("x").orderBy(F.xxhash64("x")).limit(1).collect()
    width = max(len(r["x"]) for r in got)
    return np.array([[*r["x"], *[0.0] * (width - len(r["x"]))] for r in got])


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return np.pad(a, ((0, 0), (0, w - a.shape[1]))), np.pad(b, ((0, 0), (0, w - b.shape[1])))


def _cut(df: DataFrame, name: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the number of their part, parts being a cell's rows, about ``most`` each; and the
    stored parts with their radius and largest norm. There are at most PIVOTS cells."""
    per = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_n"))
    first = F.sum("_n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    per = shared.stored(per.withColumn("_first", F.coalesce(first, F.lit(0)).cast("long")))
    cut = df.join(F.broadcast(per), "cell").withColumn(name, F.col("_first") + F.pmod(F.xxhash64("row"), F.col("_n")))
    cut = shared.stored(cut.drop("_n", "_first"))
    return cut, shared.stored(cut.groupBy("cell", name).agg(F.max("apart").alias("radius"), F.max("size").alias("size")))


def block_pairs(layout: Layout, lows: DataFrame) -> DataFrame:
    """(grp, block): the pairs of a query group and a data block that may hold a score of the group's
    least k-th one or more. ``lows`` has grp and low, null where some query has no k-th score yet.

    Groups are held against the cells' centres, radii and norms first (at most PIVOTS of each, broadcast),
    then joined on the cells that remain, and held against their blocks.
    """
    spark = layout.groups.sparkSession
    cells = layout.blocks.groupBy("cell").agg(F.max("radius").alias("r"), F.max("size").alias("s")).collect()
    number, radius, size = (np.array([r[c] for r in cells]) for c in ("cell", "r", "s"))
    centre = layout.points[number]
    sent = spark.sparkContext.broadcast((layout.points, number, radius, size, np.linalg.norm(centre, axis=1)))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, number, radius, size, long = sent.value
        for b in batches:
            g = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "radius", "size", "low")}
            mine = points[g["cell"]]
            dot, own, r = mine @ points[number].T, np.linalg.norm(mine, axis=1)[:, None], g["radius"][:, None]
            most = np.minimum(dot + r * long + radius * own + r * radius, g["size"][:, None] * size)
            low = np.where(np.isnan(g["low"].astype(float)), -np.inf, g["low"].astype(float))
            i, j = np.nonzero(most * (1 + 1e-9 * np.sign(most)) + 1e-3 >= low[:, None])
            yield pa.RecordBatch.from_arrays(
                [b.column("grp").take(pa.array(i)), pa.array(number[j].astype(np.int32)), pa.array(dot[i, j]), pa.array(own[i, 0]), pa.array(long[j])],
                names=["grp", "cell", "dot", "own", "long"],
            )

    groups = layout.groups.join(lows, "grp", "left")
    open_ = groups.select("grp", "cell", "radius", "size", F.col("low").cast("double").alias("low")).mapInArrow(
        reach, "grp long, cell int, dot double, own double, long double"
    )
    mine = groups.select("grp", F.col("radius").alias("gr"), F.col("size").alias("gs"), F.col("low"))
    both = open_.join(layout.blocks, "cell").join(mine, "grp")
    most = F.least(F.expr("dot + gr * long + radius * own + gr * radius"), F.expr("gs * size"))
    return both.where(F.col("low").isNull() | (most + F.abs(most) * 1e-9 + 1e-3 >= F.col("low"))).select("grp", "block")


def _answers(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, query_id, vec_id, score): of each query the best rows of each block that it is sent to.

    ``data`` has block, id, x; ``asked`` has block, grp, row, id, x, low. One task gets a block's rows and
    then its groups, in order.
    """
    none = F.lit(None)
    a = data.select("block", F.lit(-1).cast("long").alias("grp"), none.cast("long").alias("row"), "id", "x", none.cast("double").alias("low"))
    b = asked.select("block", "grp", "row", "id", "x", F.col("low").cast("double").alias("low"))
    blocks = max(1, data.select("block").distinct().count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, tree, ids = None, [], None, None
        waiting: list[pa.RecordBatch] = []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal tree, ids
            if not waiting:
                return
            t = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            if not parts:
                return
            if tree is None:
                d = pa.Table.from_batches(parts).combine_chunks()
                ids, tree = d.column("id").to_numpy(), CoverTree(_matrix(d.column("x")))
            x, y = _same_width(_matrix(t.column("x")), tree.x)
            if y.shape[1] > tree.x.shape[1]:
                tree = CoverTree(y)
            low = t.column("low").to_numpy(zero_copy_only=False).astype(float)
            low = np.where(np.isnan(low) | (ids.max() == _NO_ID), -np.inf, low)
            own = t.column("id").to_numpy()
            best = search(x, own, tree, ids, k, low)
            some = (best.score > -np.inf) & ((best.id != _NO_ID) | (ids.max() == _NO_ID))
            per = some.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(t.column("row").to_numpy(), per)),
                    pa.array(np.repeat(own, per)),
                    pa.array(best.id[some]),
                    pa.array(best.score[some].astype(np.int64)),
                ],
                names=["query", "query_id", "vec_id", "score"],
            )

        group = None
        for b in batches:
            if not b.num_rows:
                continue
            at, grp = b.column("block").to_numpy(), b.column("grp").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (grp[1:] != grp[:-1])])
            for s, e in zip(cuts, [*cuts[1:], len(at)]):
                if at[s] != block or grp[s] != group:
                    yield from answer()
                if at[s] != block:
                    block, parts, tree = at[s], [], None
                group = grp[s]
                (parts if group < 0 else waiting).append(b.slice(s, e - s))
        yield from answer()

    both = a.unionByName(b).repartition(blocks, "block").sortWithinPartitions("block", "grp")
    return both.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def usable_rows(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, x, row) of the vectors that take part."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("id"), scaled(vec_col, scale).alias("x"), F.monotonically_increasing_id().alias("row")
    )


def top_k(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    pivots: int = PIVOTS,
    data_block: int = DATA_BLOCK,
    query_group: int = QUERY_GROUP,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by integer inner product.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those with the
    query's own id. Ties go to the smaller id. Vectors that are null or hold null or non-finite
    components take no part, nor do null ids; of different lengths, the shorter counts as filled with
    zeros. A row that is repeated whole is a candidate each time it stands there, and asks once; different
    vectors under one id ask one by one, and each has its ranks. Scores are exact while they stay below
    2^53. Other columns, whatever their names, are ignored; an empty table has no results.
    """
    rows = shared.stored(usable_rows(vectors, scale, id_col, vec_col))
    if rows.where(F.col("id") % every == 0).isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    layout = Layout(rows, every, pivots, data_block, query_group)
    home = layout.asked.select(F.col("home").alias("block"), "grp", "row", "id", "x", F.lit(None).alias("low"))
    first = shared.stored(_answers(layout.data, home, k))
    kth = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    own = first.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).select(F.col("query").alias("row"), F.col("score").alias("low"))
    asked = shared.stored(layout.asked.select("grp", "row", "id", "x", "home").join(own, "row", "left"))
    lows = asked.groupBy("grp").agg(F.when(F.count("low") == F.count(F.lit(1)), F.min("low")).alias("low"))
    pairs = shared.stored(block_pairs(layout, lows))
    sent = asked.join(pairs, "grp").where("block <> home").select("block", "grp", "row", "id", "x", "low")
    met = layout.data.join(pairs.select("block").distinct(), "block", "left_semi")
    found = first.unionByName(_answers(met, sent, k))
    return (
        found.withColumn("rank", F.row_number().over(kth)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
