"""Vector code compression: product codes whose nearest entries are found by slicing and intersecting bitmasks.

Vectors are cut into equal parts; each part position has a codebook. In every dimension of a codebook the
entries' coordinates are sorted, and every prefix of that order carries the mask of its entries, so the
entries within a range of coordinates are the difference of two prefix masks. A part first looks at the entry
nearest to it in each of a few wide dimensions; its distance to the best of them is the radius within which
the nearest one must lie. The radius selects a range in each dimension, the ranges' masks, 64 entries a word, are ANDed, and
only entries whose bit is left are compared, in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm import lattice, shared


#: Dimensions of the widest spread whose nearest entries give the initial radius.
FIRST = 4


class Book:
    """One part position's codebook with the sorted coordinates and prefix masks of every dimension."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, width = entries.shape
        self.words = (n + 63) // 64
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.edges = np.take_along_axis(entries, self.order, axis=0)
        #: prefix[d, k]: the mask of the first k entries in dimension d's order.
        self.prefix = np.zeros((width, n + 1, self.words), np.uint64)
        for d in range(width):
            for k, e in enumerate(self.order[:, d].tolist()):
                self.prefix[d, k + 1] = self.prefix[d, k]
                self.prefix[d, k + 1, e // 64] |= np.uint64(1 << e % 64)
        self.widest = np.argsort(self.edges[0] - self.edges[-1], kind="stable")[:FIRST].tolist()

    def candidates(self, y: np.ndarray) -> np.ndarray:
        """Masks (rows, words) of the entries that may be nearest to each row, the nearest ones among them."""
        n, first = len(self.entries), np.full(len(y), np.iinfo(np.int64).max)
        for d in self.widest:
            at = np.minimum(np.searchsorted(self.edges[:, d], y[:, d]), n - 1)
            low = np.maximum(at - 1, 0)
            nearer = y[:, d] - self.edges[low, d] < self.edges[at, d] - y[:, d]
            first = np.minimum(first, lattice.squares(y, self.entries[self.order[np.where(nearer, low, at), d]]))
        radius = np.sqrt(first.astype(np.float64)).astype(np.int64) + 1
        radius -= radius * radius > first
        mask = np.full((len(y), self.words), ~np.uint64(0))
        for d in range(y.shape[1]):
            edges = self.edges[:, d]
            a = np.searchsorted(edges, y[:, d] - radius, side="left")
            b = np.searchsorted(edges, y[:, d] + radius, side="right")
            mask &= self.prefix[d, b] ^ self.prefix[d, a]
        return mask

    def nearest(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row; of equal distances the entry of lower index."""
        best, code = np.full(len(y), np.iinfo(np.int64).max), np.zeros(len(y), np.int64)
        if not y.shape[1]:
            return code, np.zeros(len(y), np.int64)
        mask = self.candidates(y)
        for e in range(len(self.entries)):
            rows = np.flatnonzero(mask[:, e // 64] >> np.uint64(e % 64) & np.uint64(1))
            d = lattice.squares(y[rows], self.entries[e])
            won = d < best[rows]
            best[rows[won]], code[rows[won]] = d[won], e
        return code, best


def encode(x: np.ndarray, books: list[Book]) -> tuple[np.ndarray, np.ndarray]:
    """(codes by row and part, squared distances summed over the parts)."""
    codes, error = np.zeros((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for p, y in enumerate(np.split(x, len(books), axis=1)):
        codes[:, p], d = books[p].nearest(np.ascontiguousarray(y))
        error += d
    return codes, error


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The integer vectors that codes stand for; books: (parts, entries, width)."""
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)


def train(rows: DataFrame, starts: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (parts, entries, width) after some rounds over all rows' integer vectors x.

    Each round's tasks add up their own parts by entry; the driver sees the books alone.
    """
    books, (parts, entries, width) = starts, starts.shape
    for _ in range(rounds):
        made = [Book(b) for b in books]

        def groups(batch: pa.RecordBatch, made=made) -> tuple[np.ndarray, np.ndarray]:
            x = lattice.matrix(batch.column(0), parts * width)
            codes, _ = encode(x, made)
            return (codes + np.arange(parts) * entries).ravel(), x.reshape(-1, width)

        sums = lattice.sums_by_group(rows.select("x"), groups, width)
        flat = books.reshape(parts * entries, width)
        new = [[t // sums[g][0] for t in sums[g][1]] if g in sums else list(e) for g, e in enumerate(flat)]
        books = np.array(new, dtype=np.int64).reshape(books.shape)
    return books


def compress(
    vectors: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Of every vector its code (two hex digits a part), its squared error, the error of all vectors of its
    label (nulls are one label), and the SHA-256 of all codebooks.

    Vectors are dropped that are null or hold null or non-finite components; component x counts as floor(scale *
    x). Each part's book begins as that part of the ``entries`` (256 at most) smallest kept ids' vectors, null ids
    last, equal ids by components; fewer vectors make smaller books. In each round every part goes to its nearest
    entry, ties to the lower index, then an entry becomes the componentwise floor of its parts' mean, an unused one
    staying as it is; after the last round parts are assigned again.

    Equal vectors, repeated and null ids have a row each; an empty table gives no rows. Kept vectors must all have
    one length, a multiple of ``parts``, and components whose squared distances fit a long: else it raises. Other
    columns, whatever their names, are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    kept = vectors.where(lattice.whole(vector_col))
    rows = shared.stored(
        kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), lattice.floored(vector_col, scale).alias("x"))
    )
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    given = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if given["least"] is None:
        return spark.createDataFrame([], f"`{id_col}` {kinds[0]}, code string, error long, label_error long, codebooks_sha256 string")
    dim = given["least"]
    if given["most"] != dim or dim % parts:
        raise ValueError(f"vectors of {dim} to {given['most']} components can't be cut into {parts} equal parts")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    starts = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    books = train(rows, starts, rounds)
    made = [Book(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = encode(lattice.matrix(b.column(2), dim), made)
            hexes = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hexes, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    coded = shared.stored(rows.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, code string, error long"))
    # stored, so that Spark knows the size before it plans the join: few labels are broadcast, many are not
    by_label = shared.stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    said = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(said).alias("codebooks_sha256")
    )
