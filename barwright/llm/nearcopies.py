"""The part of the SimHash stage that fingerprints can't do: texts whose sets of five-word shingles have a
Jaccard similarity of LEAST_TENTHS or more.

At that similarity fingerprints of 64 bits differ in some ten bits, give or take three; to search that far
an index of masked blocks would need thousands of masks. So pairs are proposed by MinHash here.

Texts with the same set are one node. Nodes that share a band of MinHash values are candidates, and a
pair counts only after its whole sets were compared. So that a large group of copies costs its size and
not its square, a bucket's members are first compared with its least and its greatest node, its hubs. What is
then still in different components is told by differences: two sets differ in as many hashes as their
differences from the least hub do, so two alike ones that aren't both alike to the hub have a certain number
of differences in common, and meet in one of the first few of them, rarest first (close_pairs). Texts that
share a long passage have that in common with the hub as well, so it brings no two of them together. A
set's hashes are counted in PARTS parts; two sets have at most the sum of the lesser counts in common, so
pairs whose bound is below the least similarity go before any set is sent. No bucket, group or text is cut.
Two texts at the least similarity share no band in three of a million cases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from barwright.llm import shared

WIDTH = 5
LEAST_TENTHS = 8
BANDS = 32
BAND_ROWS = 5
PARTS = 128
SEED = 42
_CHUNK = 4096
_rng = np.random.default_rng(SEED)
_TURN = _rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2)
_TIMES = _rng.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted XXH64 of a text's different shingles; words as in simhash. Fewer words are one shingle."""
    words = text.lower().split()
    n = max(1, len(words) - width + 1)
    found = np.zeros(0, dtype=np.uint64)
    for at in range(0, n, 1 << 16):
        part = words[at : min(at + (1 << 16), n) + width - 1]
        if len(words) < width:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(*(part[k : len(part) - width + 1 + k] for k in range(width))))
        found = np.union1d(found, np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=np.uint64))
    return found


def bands(h: np.ndarray) -> np.ndarray:
    """One hash per band of MinHash values."""
    least = np.full(len(_TIMES), ~np.uint64(0))
    for at in range(0, len(h), _CHUNK):
        part = (h[at : at + _CHUNK, None] ^ _TURN) * _TIMES
        part ^= part >> np.uint64(32)
        np.minimum(least, (part * _TIMES[::-1]).min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], dtype=np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the least similarity, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 10 * both >= LEAST_TENTHS * (len(a) + len(b) - both)


def sets(docs: DataFrame, id_col: str, text_col: str, fingerprint: Callable[[bytes], int]) -> DataFrame:
    """Per row: id, the text's fingerprint, node (the hash of its set), size, the set's bands.

    The sets themselves are as large as the texts, so they aren't kept; see held_sets.
    """
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.remember_only("nearcopies")
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                texts = [t.as_py() for t in part.column(1)]
                fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
                found = [shingles(t) for t in texts]
                node = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(fps), pa.array(node), pa.array([len(h) for h in found], pa.int64()),
                     pa.array([bands(h) for h in found], pa.list_(pa.int64()))],
                    names=["id", "fp", "node", "size", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), shared.text_bytes(text_col).alias("t"))
    return given.mapInArrow(run, f"id {kind}, fp long, node long, size long, bands array<long>")


def held_sets(texts: DataFrame) -> DataFrame:
    """(node, size, counts, held) of the texts (node, t): their whole sets, with the counts by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.remember_only("nearcopies")
        for b in batches:
            found = [shingles(t.as_py()) for t in b.column(1)]
            counts = [np.bincount((h % np.uint64(PARTS)).astype(np.int64), minlength=PARTS) for h in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(h) for h in found], pa.int64()), pa.array(counts, pa.list_(pa.int32())),
                 pa.array([h.tobytes() for h in found], pa.binary())],
                names=["node", "size", "counts", "held"],
            )

    return texts.select("node", "t").mapInArrow(run, "node long, size long, counts array<int>, held binary")


def _alike_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sets are alike; all that the counts leave open are compared whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [
                alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))
                for x, y in zip(b.column(2), b.column(3))
            ]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    for c in "uv":
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("counts").alias(f"c{c}")), c)
    most = F.aggregate(F.zip_with("cu", "cv", lambda a, b: F.least(a, b)), F.lit(0), lambda a, b: a + b)
    pairs = pairs.where(10 * most >= LEAST_TENTHS * (F.col("nu") + F.col("nv") - most)).select("u", "v")
    u = sets.select(F.col("node").alias("u"), F.col("held").alias("hu"))
    v = sets.select(F.col("node").alias("v"), F.col("held").alias("hv"))
    both = pairs.join(u, "u").join(v, "v").select("u", "v", "hu", "hv")
    return both.mapInArrow(run, "u long, v long")


def _size_fits(a: str, b: str):
    """Sets of such sizes can be alike: the lesser holds at least the least similarity of the greater."""
    return F.least(a, b) * 10 >= F.greatest(a, b) * LEAST_TENTHS


def components(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of all nodes that are alike to another; ``nodes`` has each node once, with its size and
    bands, and ``texts`` gives the texts (node, t) of nodes: only those that share a band are asked for."""
    spread = F.posexplode("bands").alias("k", "band")
    filed = nodes.select("node", "size", spread).select(F.xxhash64("k", "band").alias("key"), "node", "size")
    crowds = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    filed = shared.stored(filed.join(crowds, "key"))
    sets = shared.stored(held_sets(texts(filed.select("node").distinct())))
    edges, roots, first = None, None, None
    for pick in (F.min, F.max):
        placed = _placed(filed, roots)
        hub = placed.groupBy("key").agg(pick(F.struct("node", "size", "root")).alias("h"), F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b")
        hub = hub.select("key", F.col("h.node").alias("v"), F.col("h.size").alias("w"), F.col("h.root").alias("hub_root"))
        pairs = placed.join(hub, "key").where((F.col("root") != F.col("hub_root")) & _size_fits("size", "w"))
        edges, roots = _grown(edges, pairs.select(F.col("node").alias("u"), "v").distinct(), sets)
    # the least nodes were hubs of the first round, so all that is alike to them is known
    mixed = _placed(filed, roots).groupBy("key").agg(F.min("node").alias("hub"), F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b")
    groups = filed.join(mixed.select("key", "hub"), "key").select("hub", "node").distinct()
    return _grown(edges, close_pairs(differences(groups, sets), roots), sets)[1]


def differences(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, node, size, d, apart) of the groups' (hub, node): the hashes, d in number, of one set alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = [
                np.setxor1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True).view(np.int64)
                for x, y in zip(b.column(3), b.column(4))
            ]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([len(a) for a in apart], pa.int64()), pa.array(apart, pa.list_(pa.int64()))],
                names=["hub", "node", "size", "d", "apart"],
            )

    hubs = sets.select(F.col("node").alias("hub"), F.col("held").alias("held_hub"))
    both = groups.join(hubs, "hub").join(sets.select("node", "size", "held"), "node").select("hub", "node", "size", "held_hub", "held")
    return shared.stored(both.mapInArrow(run, "hub long, node long, size long, d long, apart array<long>"))


def close_pairs(apart: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (u, v) of one hub's nodes in different components, among them all that are alike; nodes alike to
    their hub must be in its component.

    Sets of s hashes together are alike if at most s (10 - LEAST_TENTHS) / (10 + LEAST_TENTHS) are in one alone.
    That number is d + e - 2 c for sets with d and e differences from the hub, c of them common. So either c is
    at least half of d + e less the bound, and the first common difference stands no later than place d - c + 1
    of the one and e - c + 1 of the other, in any order; or d + e is within the bound, and then both
    are alike to the hub. The order is by frequency in the hub's group, so the places are those of rare ones.
    """
    less, more = 10 - LEAST_TENTHS, 10 + LEAST_TENTHS
    each = apart.select("hub", "node", "size", "d", F.explode("apart").alias("t"))
    often = each.groupBy("hub", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # differences of one node alone come first and meet nothing: they count as places only
    mine = W.partitionBy("hub", "node")
    place = F.col("d") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("n", "t")) - 1
    ranked = each.join(often, ["hub", "t"]).withColumn("before", place)
    # the sizes of alike sets bound each other, so the bound is at most this share of one's size
    ranked = ranked.where(LEAST_TENTHS * F.col("before") <= less * F.col("size")).drop("n")
    ranked = shared.stored(_placed(ranked, roots))
    few = ranked.where(2 * LEAST_TENTHS * F.col("before") <= less * F.col("size"))
    few = few.select("hub", "t", *(F.col(c).alias(f"{c}_v") for c in ("node", "size", "d", "before", "root")))
    wider, bound = F.col("d") - F.col("d_v"), less * (F.col("size") + F.col("size_v"))
    met = ranked.join(few, ["hub", "t"]).where(
        (F.col("root") != F.col("root_v")) & _size_fits("size", "size_v")
        & ((wider > 0) | ((wider == 0) & (F.col("node_v") < F.col("node")))) & (more * wider <= bound)
        & (2 * more * F.col("before") <= bound + more * wider) & (2 * more * F.col("before_v") <= bound - more * wider)
    )
    return met.select(F.greatest("node", "node_v").alias("u"), F.least("node", "node_v").alias("v")).distinct()


def _placed(filed: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return filed.withColumn("root", F.col("node"))
    return filed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _grown(edges: DataFrame | None, pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All edges known with those of the pairs that are alike, and the components they make."""
    new = shared.stored(_alike_pairs(pairs, sets))
    edges = new if edges is None else edges.unionByName(new)
    return edges, shared.stored(shared.components(edges))
