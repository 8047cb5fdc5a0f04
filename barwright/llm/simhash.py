"""SimHash near-duplicates, linked through a Gray-order hierarchical index of masked bit patterns.

A text's fingerprint is the bitwise majority of its shingles' XXH64. Two fingerprints that differ in
at most ``MAX_BITS`` bits agree on whole blocks of bits, so the upper nodes of the index are the
patterns that fingerprints share under the masks of those blocks; Spark deals the fingerprints out by
upper node. Below one upper node a task sorts the fingerprints by Gray rank, builds a tree whose nodes
hold the bits that all their members share (pattern and mask), and walks the tree against itself: the
bits in which two nodes must differ add up from level to level, and a pair of groups is given up as
soon as the sum exceeds the bound, or joined whole as soon as no pair of members can exceed it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barwright.llm import shared

MAX_BITS = 2
SEED = 42
#: Blocks of bits; fingerprints within MAX_BITS agree on at least BLOCKS - MAX_BITS of them.
BLOCKS = 6
FANOUT = 8
_ONE = np.uint64(1)
_CHUNK = 1 << 16
#: Rows below upper nodes that a task gathers before it links them.
HELD = 1 << 20


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of one text (UTF-8): lower-cased A-Z, words between ASCII white space.

    Shingles of ``width`` words count as often as they stand there; fewer words are one shingle; a text
    without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : min(at + _CHUNK, n) + width - 1]
        if len(words) < width:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(*(part[k : len(part) - width + 1 + k] for k in range(width))))
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    major = (ones * 2 > n).astype(np.uint8)
    return int(np.packbits(major, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) per row, fp being the fingerprint's 64 bits as a long. Null text: no words."""
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), shared.text_bytes(text_col).alias("t"))
    return given.mapInArrow(run, f"id {kind}, fp long")


def block_masks(blocks: int = BLOCKS, apart: int = MAX_BITS) -> list[int]:
    """As signed longs, the masks of every choice of blocks that ``apart`` differing bits can spare."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    whole = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(blocks)]
    masks = [sum(c) for c in combinations(whole, blocks - apart)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray order."""
    x = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """The tree over codes that are sorted by (upper node, Gray rank).

    Level 0 is the codes; each level above groups up to FANOUT neighbours of one upper node, and keeps
    the bits on which all of them agree. ``top`` is the level at which each upper node has one group.
    """

    def __init__(self, node: np.ndarray, codes: np.ndarray, fanout: int = FANOUT):
        self.levels = [(codes, np.full(len(codes), ~np.uint64(0)), np.arange(len(codes) + 1))]
        while True:
            pattern, mask, _ = self.levels[-1]
            new = np.r_[True, node[1:] != node[:-1]] if len(node) else np.zeros(0, bool)
            if new.all():
                break
            start = np.flatnonzero(new)
            place = np.arange(len(node)) - np.repeat(start, np.diff(np.r_[start, len(node)]))
            first = np.flatnonzero(place % fanout == 0)
            lead = pattern[np.repeat(first, np.diff(np.r_[first, len(node)]))]
            agree = np.bitwise_and.reduceat(mask & ~(pattern ^ lead), first)
            self.levels.append((pattern[first] & agree, agree, np.r_[first, len(node)]))
            node = node[first]
        #: Codes below each group, per level.
        self.spans = [np.arange(len(codes) + 1)]
        for _, _, bounds in self.levels[1:]:
            self.spans.append(self.spans[-1][bounds])

    def close_groups(self, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of code positions that stand for all links: each pair is within ``apart`` bits, and
        every two codes within ``apart`` bits are joined by a chain of the pairs given."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        stack = [(top, np.arange(s, min(s + _CHUNK, n)), np.arange(s, min(s + _CHUNK, n))) for s in range(0, n, _CHUNK)]
        stack = [(k, a, b, np.zeros(len(a), np.int64)) for k, a, b in stack]
        while stack:
            level, a, b, sure = stack.pop()
            pattern, mask, bounds = self.levels[level]
            both = mask[a] & mask[b]
            if level == top:
                sure = np.bitwise_count((pattern[a] ^ pattern[b]) & both).astype(np.int64)
            near = sure <= apart
            a, b, sure, both = a[near], b[near], sure[near], both[near]
            whole = sure + np.bitwise_count(~both) <= apart
            if whole.any():
                yield from self._whole(level, a[whole], b[whole])
            a, b, sure, both = (x[~whole] for x in (a, b, sure, both))
            if not len(a) or level == 0:
                continue
            wide = bounds[a + 1] - bounds[a]
            tall = bounds[b + 1] - bounds[b]
            step = max(1, _CHUNK // FANOUT**2)
            for s in range(0, len(a), step):
                cut = slice(s, s + step)
                per = wide[cut] * tall[cut]
                pair = np.repeat(np.arange(len(per)), per)
                k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                i = bounds[a[cut]][pair] + k // tall[cut][pair]
                j = bounds[b[cut]][pair] + k % tall[cut][pair]
                once = i <= j
                i, j, pair = i[once], j[once], pair[once]
                cp, cm, _ = self.levels[level - 1]
                fresh = cm[i] & cm[j] & ~both[cut][pair]
                grown = sure[cut][pair] + np.bitwise_count((cp[i] ^ cp[j]) & fresh)
                keep = grown <= apart
                if keep.any():
                    stack.append((level - 1, i[keep], j[keep], grown[keep].astype(np.int64)))

    def _whole(self, level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chains through groups all of whose members are within the bound of one another."""
        span = self.spans[level]
        for one in (a, b):
            size = span[one + 1] - span[one]
            at = np.repeat(span[one], size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield at[k > 0], (at + k)[k > 0]
        yield span[a], span[b]


def join_labels(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merges the sets of i and j, pair by pair at once; parent[x] stays the least member's position."""
    while True:
        a, b = parent[i], parent[j]
        open_ = a != b
        if not open_.any():
            return parent
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def forest(node: np.ndarray, codes: np.ndarray, apart: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(code, code of its local root) for all codes that link to another below the same upper node."""
    order = np.lexsort((gray_rank(codes), node))
    node, codes = node[order], codes[order]
    parent = np.arange(len(codes))
    for i, j in GrayIndex(node, codes).close_groups(apart):
        parent = join_labels(parent, i, j)
    linked = parent != np.arange(len(codes))
    return codes[linked], codes[parent[linked]]


def link(distinct: DataFrame, apart: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) whose components are those of all links.

    Each fingerprint goes to one upper node per mask. Below an upper node at most 2^22 different
    fingerprints can stand (its free bits), and a task takes its upper nodes in order, some HELD rows or
    one node at a time; so its arrays are bounded however many rows there are.
    """
    masks = F.array(*(F.lit(m) for m in block_masks(blocks, apart)))
    dealt = distinct.select("fp", F.posexplode(masks).alias("k", "m")).select(
        F.xxhash64("k", F.col("fp").bitwiseAND(F.col("m"))).alias("node"), "fp"
    )

    def linked(node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        same = node[1:] == node[:-1]
        shared_ = np.r_[same, False] | np.r_[False, same]
        u, v = forest(node[shared_], fp[shared_], apart)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)))
            rows += b.num_rows
            if rows < HELD:
                continue
            node, fp = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
            if cut:
                yield linked(node[:cut], fp[:cut])
            held, rows = [(node[cut:], fp[cut:])], len(node) - cut
        if rows:
            yield linked(*(np.concatenate(x) for x in zip(*held)))

    return dealt.repartition(F.col("node")).sortWithinPartitions("node").mapInArrow(run, "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, apart: int = MAX_BITS
) -> DataFrame:
    """Per row of docs: the id, fingerprint (16 hex digits) and component_id, the least id reachable.

    Rows with equal fingerprints are one node, so copies cost one row however many there are. Null or
    empty texts have fingerprint 0 and link like any other; null ids keep their rows but never name a
    component unless all of it is null. Repeated rows are all returned; other columns are ignored. An
    empty table gives an empty result.
    """
    prints = shared.stored(fingerprints(docs, id_col, text_col, width))
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = shared.components(link(classes.select("fp"), apart)).withColumnRenamed("node", "fp")
    named = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = shared.stored(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, apart: int = MAX_BITS, similar: bool = False
) -> DataFrame:
    """docs with one row of each group of near duplicates: that with the least id, then text hash.

    Groups are the components of fingerprint links; with ``similar`` also of texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more, which mostly lie further apart than a fingerprint
    index can search (see nearcopies). A row is told by its id and text: where one id stands on different
    texts, each text is judged by itself; rows without an id are judged too, and come last in their group.
    Rows that repeat both id and text are one, the one whose columns hash least (of rows that differ in map or
    variant columns alone, which can't be hashed, any one). Texts of any length are read whole. Null and empty texts are
    copies of one another. All columns stay as they are, whatever their names; an empty table stays empty.
    """
    from barwright.llm import nearcopies

    text = F.coalesce(F.col(text_col), F.lit(""))
    # two independent hashes of the text: rows without an id, too, are told apart by 128 bits
    key = F.struct(
        F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.xxhash64(text).alias("said"), F.xxhash64(F.lit(1), text).alias("more")
    )
    keyed = docs.select(key.alias("key"), F.col(text_col).alias("t"))
    if similar:
        rows = shared.stored(nearcopies.sets(keyed, "key", "t", lambda t: fingerprint(t, width)))
    else:
        rows = shared.stored(fingerprints(keyed, "key", "t", width).withColumn("node", F.col("fp")))
    both = shared.stored(rows.select("fp", "node").distinct())
    least = both.groupBy("fp").agg(F.min("node").alias("rep"))
    edges = both.join(least, "fp").where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    near = link(least.select("fp"), apart)
    u, v = (least.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_rep")) for c in "uv")
    edges = edges.unionByName(near.join(u, "u").join(v, "v").select(F.col("u_rep").alias("u"), F.col("v_rep").alias("v")))
    if similar:
        def texts(nodes: DataFrame) -> DataFrame:
            one = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("k")).select("node", *_key_hashes("k"))
            mine = keyed.select(*_key_hashes("key"), shared.text_bytes("t").alias("t"))
            # stored, so its size is known before the texts move: they stay in place where Spark may broadcast it
            return mine.join(shared.stored(one), ["h1", "h2"]).dropDuplicates(["h1", "h2"])

        alike = nearcopies.components(rows.select("node", "size", "bands").dropDuplicates(["node"]), texts)
        edges = edges.unionByName(alike.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = rows.select("id", "node").join(shared.components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = named.groupBy("root").agg(F.min("id").alias("k")).select(*_key_hashes("k")).distinct()
    content = F.xxhash64(*(f"`{c}`" for c, t in docs.dtypes if "map<" not in t and "variant" not in t))
    rows = docs.select(key.alias("k"), content.alias("content"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    # copies of a row collapse before they are shuffled; the join then finds both sides where they are
    single = rows.select(*_key_hashes("k"), "content", "row").groupBy("h1", "h2").agg(F.min_by("row", "content").alias("row"))
    return single.join(kept, ["h1", "h2"], "left_semi").select("row.*")


def _key_hashes(key: str) -> tuple:
    """128 bits that stand for a key."""
    parts = [f"{key}.no", f"{key}.id", f"{key}.said", f"{key}.more"]
    return F.xxhash64(*parts).alias("h1"), F.xxhash64(*parts[::-1], F.lit(1)).alias("h2")
