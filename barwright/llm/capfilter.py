"""Embedding near-duplicates by spherical-cap filters from random product codes.

A filter is a direction; a vector passes it if their inner product is high enough, i.e. if it lies in
the cap around the direction. The directions are all sums of one random unit codeword per block of
coordinates, so the vector's best filter is its best codeword per block, and all filters that it passes
are list-decoded block by block without visiting the others. Every vector asks in its single best
filter; every vector is also filed under all filters whose threshold it exceeds, the threshold being
what a vector at the linking angle from the asker would exceed but for ``SIGMAS`` standard deviations.
Asker and filed vectors meet by a join on the filter, and each pair is verified in double precision. As
an asker asks once, no pair is counted twice.

There are several codes, each over another rotation; a vector asks in the code whose best filter is the
nearest to it. Askers are told apart by levels of that product, so a filter's threshold is that of the
askers it has, and vectors are filed only under filters that have any.

Equal vectors of a label are one class with a count, so a group of copies costs one row however large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm import shared
from barwright.llm.simhash import join_labels

#: Deviations by which a linked vector may fall short of its expected product and still be filed;
#: infinity files all that the triangle inequality allows, so that no link can be lost.
SIGMAS = 5.0
#: Codes, blocks of each, filters per vector, and the width of a level of the askers' products. Filters
#: grow with the vectors, a codeword of one block at a time, so that a filter keeps a few askers.
CODES, BLOCKS, FILTERS_PER_ROW, LEVEL = 4, 4, 1.3, 0.04
#: Bits (as a power of two) of each of the four maps of asked filters that filed vectors are held against
#: before any shuffle: MAP_SPARE more than the vectors have, 64 MB for all maps at most. Fuller maps let
#: through more that finds no asker later.
MAP_SPARE, MAP_BITS = 6, 27
#: Rows of a side that meet in one block of pairs, rows per task of the decoding, and rows decoded at once.
TILE, DECODE_ROWS, TOGETHER = 2048, 4096, 128
_STEP = 1 << 15


def codewords(rows: int) -> list[int]:
    """Codewords per block, the least that make FILTERS_PER_ROW filters a row; four a block at least."""
    want = max(4**BLOCKS, rows * FILTERS_PER_ROW)
    words = [4] * BLOCKS
    while np.prod(words, dtype=np.float64) < want:
        words[int(np.argmin(words))] += 1
    return words


class ProductCode:
    """Directions that are concatenations of one codeword per block of rotated coordinates, times
    1/sqrt(blocks)."""

    def __init__(self, dim: int, words: list[int], seed: int):
        self.blocks = min(len(words), dim)
        self.words = words[: self.blocks]
        self.cuts = [dim * k // self.blocks for k in range(self.blocks + 1)]
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.book = []
        for a, b, n in zip(self.cuts, self.cuts[1:], self.words):
            c = rng.normal(size=(n, b - a))
            self.book.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(self.blocks))

    def products(self, x: np.ndarray) -> list[np.ndarray]:
        y = x @ self.rotation
        return [y[:, a:b] @ book.T for a, b, book in zip(self.cuts, self.cuts[1:], self.book)]

    def best(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row its best filter and the inner product with it."""
        number, score = np.zeros(len(x), np.int64), np.zeros(len(x))
        for p, words in zip(self.products(x), self.words):
            number = number * words + p.argmax(axis=1)
            score += p.max(axis=1)
        return number, score

    def passed(self, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, filter, product) of all filters whose inner product with a row is at least ``least``, block
        by block: a partial choice is given up when even the best codewords to come can't reach it."""
        products = self.products(x)
        tops = np.array([p.max(axis=1) for p in products])
        row, number, score = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k, (p, words) in enumerate(zip(products, self.words)):
            rest = least - 1e-12 - tops[k + 1 :].sum(axis=0)
            found = []
            for at in range(0, len(row), _STEP):
                r = row[at : at + _STEP]
                total = score[at : at + _STEP, None] + p[r]
                i, j = np.nonzero(total >= rest[r][:, None])
                found.append((r[i], number[at : at + _STEP][i] * words + j, total[i, j]))
            row, number, score = (np.concatenate(c) for c in zip(*found)) if found else (row, number, score)
        return row, number, score


def threshold(score: float, least_cos: float, dim: int, sigmas: float = SIGMAS) -> float:
    """What a vector at the linking angle from an asker passes, whose own product with the filter is score.

    Its product is least_cos * score plus the sine times what its other part has of the filter; that
    part's deviation in a random direction is sqrt((1 - score^2) / (dim - 1)). The bound never goes
    below what the triangle inequality on the sphere allows.
    """
    angle = np.arccos(min(1.0, least_cos)) + 1e-9
    surely = np.cos(min(np.pi, np.arccos(np.clip(score, -1, 1)) + angle))
    spread = np.sqrt(max(0.0, 1 - score**2) / max(1, dim - 1)) * np.sin(angle)
    return max(surely, np.cos(angle) * score - sigmas * spread) - 1e-9


def _key(tier, label, number: np.ndarray) -> np.ndarray:
    """A hash of code and level, label, and filter."""
    x = np.asarray(label, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number.astype(np.uint64) * np.uint64(1 << 12)
    x = x + np.asarray(tier, np.int64).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large or small components must not overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str):
    """True for vectors that aren't null or zero and whose components are all finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame,
    least_cos: float = 0.98,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    sigmas: float = SIGMAS,
) -> DataFrame:
    """Per row: id, n_links (other rows of its label at cosine least_cos or more), component_id, kept.

    component_id is the least id reachable by links. Rows whose label or vector is null, whose vector is
    zero, or holds null or non-finite components, link with nothing and are their own component. Vectors
    of different lengths don't link. Repeated rows link with each other. Rows without an id link like
    others and name a component only where none has an id. Other columns, whatever their names, are
    ignored; an empty table gives an empty result. ``sigmas`` says how sure the filters are to catch a
    link (see SIGMAS); with infinity they are certain, at the price of filing more.
    """
    rows = shared.stored(
        vectors.select(
            F.col(id_col).alias("id"),
            F.when(usable(vec_col) & F.col(label_col).isNotNull(), F.col(vec_col)).alias("x"),
            F.xxhash64(F.col(label_col), F.size(vec_col)).alias("label"),
            F.monotonically_increasing_id().alias("row"),
        )
        # 128 bits that stand for label and vector; rows that can't link stand for themselves
        .withColumn("h1", F.when(F.col("x").isNotNull(), F.xxhash64("label", "x")).otherwise(F.col("row")))
        .withColumn("h2", F.when(F.col("x").isNotNull(), F.xxhash64("x", "label", F.lit(1))))
    )
    classes = shared.stored(
        rows.where("x is not null").groupBy("h1", "h2").agg(
            F.min("row").alias("row"), F.first("label").alias("label"), F.first("x").alias("x"), F.count(F.lit(1)).alias("m"), F.min("id").alias("least")
        )
    )
    dims = [r[0] for r in classes.select(F.size("x").alias("d")).distinct().collect()]
    parts = [_links(classes.where(F.size("x") == d), d, least_cos, sigmas) for d in sorted(dims)]
    if not parts:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = shared.stored(found)
    counts = found.where("other is null").groupBy("row").agg(F.sum("n").alias("n"))
    roots = shared.components(found.where("other is not null").select(F.col("row").alias("u"), F.col("other").alias("v")))
    named = classes.select("h1", "h2", "row", "m", "least").join(roots.withColumnRenamed("node", "row"), "row", "left")
    named = named.withColumn("root", F.coalesce("root", "row"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    told = named.join(least, "root").join(counts, "row", "left").select(
        "h1", F.col("h2").alias("_h2"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), "component_id", F.lit(True).alias("linked")
    )
    mine = (rows["h1"] == told["h1"]) & (rows["h2"] == told["_h2"])
    alone = F.col("linked").isNull()
    return rows.join(told, mine, "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def _links(valid: DataFrame, dim: int, least_cos: float, sigmas: float) -> DataFrame:
    """(row, n, other): per asking class and block of pairs its links to rows of other classes, and the
    edges of a forest of classes."""
    spark = valid.sparkSession
    rows = valid.count()
    bits = min(MAP_BITS, max(16, int(np.ceil(np.log2(max(rows, 1)))) + MAP_SPARE))
    codes = [ProductCode(dim, codewords(rows), seed) for seed in range(CODES)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, label = _unit(_matrix(b.column(3))), b.column(1).to_numpy()
            numbers, scores = (np.array(a) for a in zip(*(c.best(x) for c in codes)))
            code, each = scores.argmax(axis=0), np.arange(len(x))
            tier = np.maximum(0, scores[code, each] // LEVEL).astype(np.int64) * CODES + code
            number = numbers[code, each]
            key, place = _key(tier, label, number), _key(code, label, number)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(key), pa.array(tier.astype(np.int32)), pa.array(place)], names=["row", "label", "m", "x", "key", "tier", "place"]
            )

    kind = dict(valid.dtypes)["x"]
    given = shared.stored(valid.select("row", "label", "m", "x").repartition(-(-rows // DECODE_ROWS), "row"))
    asked = shared.stored(given.mapInArrow(ask, f"row long, label long, m long, x {kind}, key long, tier int, place long"))
    tiers = sorted(r["tier"] for r in asked.select("tier").distinct().collect())  # some levels of each code
    bars: dict[int, list[tuple[int, float]]] = {}
    for t in tiers:
        level, code = divmod(t, CODES)
        bars.setdefault(code, []).append((t, threshold(level * LEVEL, least_cos, dim, sigmas) if level else -1.0))

    size = F.lit(1 << bits)
    halves = [F.pmod(c, size) if k == 0 else F.pmod(F.shiftrightunsigned(c, bits), size) for c in ("place", "key") for k in (0, 1)]
    probes = F.array(*(h + F.lit(k << bits) for k, h in enumerate(halves)))
    marks = (
        asked.select(F.explode(probes).alias("p"))
        .select(F.shiftright("p", 6).alias("w"), F.col("p").bitwiseAND(F.lit(63)).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
        .toArrow()  # at most the maps' words, as two columns of numbers
    )
    taken = np.zeros(4 << (bits - 6), dtype=np.int64)
    taken[marks.column("w").to_numpy()] = marks.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(taken.view(np.uint64))

    def set_at(place: np.ndarray) -> np.ndarray:
        return (sent.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def asked_for(hashes: np.ndarray, maps: int) -> np.ndarray:
        """Positions of the hashes that may be some asker's, by the two maps from number ``maps`` on."""
        low, step = np.uint64((1 << bits) - 1), np.uint64(bits)
        u = hashes.view(np.uint64)
        at = np.flatnonzero(set_at((u & low) + np.uint64(maps << bits)))
        return at[set_at(((u[at] >> step) & low) + np.uint64(maps + 1 << bits))]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                part = b.slice(lo, TOGETHER)
                x, label = _unit(_matrix(part.column(3))), part.column(1).to_numpy()
                keys, of = [], []
                for code, levels in bars.items():
                    row, number, score = codes[code].passed(x, min(bar for _, bar in levels))
                    some = asked_for(_key(code, label[row], number), 0)  # of any level
                    row, number, score = row[some], number[some], score[some]
                    for t, bar in levels:
                        high = score >= bar
                        key = _key(t, label[row[high]], number[high])
                        some = asked_for(key, 2)
                        keys.append(key[some])
                        of.append(row[high][some])
                pick = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pick), pa.array(np.concatenate(keys)), part.column(2).take(pick), part.column(3).take(pick)], names=["row", "key", "m", "x"]
                )

    filed = shared.stored(given.mapInArrow(file, f"row long, key long, m long, x {kind}"))
    sizes = (
        asked.groupBy("key").agg(F.count(F.lit(1)).alias("a"))
        .join(filed.groupBy("key").agg(F.count(F.lit(1)).alias("f")), "key")
        .select("key", F.ceil(F.col("a") / TILE).cast("int").alias("at"), F.ceil(F.col("f") / TILE).cast("int").alias("ft"))
    )
    packs = max(1, filed.count() // (4 * TILE))

    def dealt(side: DataFrame, own: str, others: str, first: bool) -> DataFrame:
        """Rows with their block of pairs: small filters share packs, large ones have a grid of blocks."""
        tile = F.pmod(F.xxhash64("row"), F.col(own))
        across = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        i, j = ("mine", "theirs") if first else ("theirs", "mine")
        grid = (F.col("at") > 1) | (F.col("ft") > 1)
        return (
            side.select("row", "key", "m", "x").join(sizes, "key")
            .withColumn("mine", tile.cast("int")).withColumn("theirs", across)
            .select(
                "row",
                "m",
                "x",
                F.xxhash64("key", i, j).alias("block"),
                F.when(grid, F.xxhash64("key", i, j)).otherwise(F.pmod(F.col("key"), F.lit(packs))).alias("pack"),
            )
        )

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        out_row, out_n, out_u, out_v = [empty], [empty], [empty], [empty]
        if left.num_rows and right.num_rows:
            a, b = (_unit(_matrix(t.column("x").combine_chunks())) for t in (left, right))
            ra, rb = (t.column("row").to_numpy() for t in (left, right))
            mb = right.column("m").to_numpy()
            ka, kb = (t.column("block").to_numpy() for t in (left, right))
            oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
            ka, kb = ka[oa], kb[ob]
            starts = np.flatnonzero(np.r_[True, ka[1:] != ka[:-1]])
            for s, e in zip(starts, [*starts[1:], len(ka)]):
                ia, ib = oa[s:e], ob[np.searchsorted(kb, ka[s]) : np.searchsorted(kb, ka[s], side="right")]
                for lo in range(0, len(ia), TILE):
                    one = ia[lo : lo + TILE]
                    close = (a[one] @ b[ib].T >= least_cos) & (ra[one][:, None] != rb[ib][None, :])
                    if not close.any():
                        continue
                    n = close @ mb[ib]
                    out_row.append(ra[one][n > 0])
                    out_n.append(n[n > 0])
                    i, j = np.nonzero(close)
                    nodes, both = np.unique(np.r_[ra[one], rb[ib]], return_inverse=True)
                    parent = join_labels(np.arange(len(nodes)), both[: len(one)][i], both[len(one) :][j])
                    moved = np.flatnonzero(parent != np.arange(len(nodes)))
                    out_u.append(nodes[moved])
                    out_v.append(nodes[parent[moved]])
        rows, n, u, v = (np.concatenate(x) for x in (out_row, out_n, out_u, out_v))
        none = pa.nulls(len(rows), pa.int64())
        return pa.table({
            "row": pa.array(np.r_[rows, u]),
            "n": pa.array(np.r_[n, np.zeros(len(u), np.int64)].astype(np.int64)),
            "other": pa.chunked_array([none, pa.array(v)]),
        })

    askers, filers = dealt(asked, "at", "ft", True), dealt(filed, "ft", "at", False)
    return askers.groupBy("pack").cogroup(filers.groupBy("pack")).applyInArrow(meet, "row long, n long, other long")
