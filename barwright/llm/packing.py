"""Best-fit packing planned on the histogram of lengths.

Texts become pieces of at most ``capacity`` tokens. The plan is made from the counts of pieces by
length only (at most ``capacity`` numbers): best fit, longest first, over groups of equally filled
sequences, so that a million equal pieces are one step. The plan says which ranks within a length go to
which sequence and place; each piece then finds its slot from its own rank within its length.
"""

from __future__ import annotations

import bisect
import gc
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from barwright.llm import shared

#: Words whose ids a Python worker remembers, and the longest of them.
CACHE_WORDS = 500_000
CACHE_CHARS = 64
#: Texts are looked up together until they have this many characters.
TOGETHER_CHARS = 2_000_000
#: Characters at which Python splits words but the tokenizer doesn't; fixed values.
NOT_SPACES = "\x1c\x1d\x1e\x1f"
_SPACES = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}
_MARKS = ".,!?"


#: How a tokenizer must normalise and split for its ids to go word by word; fixed values.
BY_WORD = (
    ["NFC", "Replace", "Lowercase"],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)


def goes_by_word(settings: dict) -> bool:
    """Whether a ``tokenizers`` file lower-cases, drops white space, and never joins letters and marks."""
    normal = (settings.get("normalizer") or {}).get("normalizers") or []
    splits = (settings.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = splits[0] if splits else {}
    kinds = [n.get("type") for n in normal]
    blanks = [n.get("pattern", {}).get("Regex") for n in normal if n.get("type") == "Replace"]
    return (
        (kinds, split.get("pattern", {}).get("Regex")) == BY_WORD and blanks == [r"\s+"]
        and split.get("behavior") == "Removed" and split.get("invert") is True
        and [s.get("type") for s in splits[1:]] == ["ByteLevel"] and not splits[1].get("add_prefix_space") and settings.get("post_processor") is None
    )


class WordTokenizer:
    """The ids of whole texts by a ``tokenizers`` file, without special tokens.

    Where the file's settings say that ids go word by word (see goes_by_word), most words are letters with
    marks behind, whose ids are those of the letters in lower case and those of the marks; so what the
    tokenizer itself must still encode is each new string of letters once, many of them in one call. With
    any other file it encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = goes_by_word(json.load(f))
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encode(self, parts: list[str]) -> None:
        """Puts the ids of parts, none of which holds white space, into the dictionary."""
        for at in range(0, len(parts), 50_000):
            some = parts[at : at + 50_000]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            raw = np.array(e.ids, dtype="<u4").tobytes()
            starts = np.array([o[0] for o in e.offsets], dtype=np.int64)
            ends = np.cumsum([len(p) + 1 for p in some])
            cuts = (4 * np.searchsorted(starts, ends)).tolist()
            self.parts.update(zip(some, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))

    def _learn(self, missing: set[str]) -> None:
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        if len(self.parts) >= CACHE_WORDS:
            self.parts.clear()
        split, parts = [], set()
        for word in missing:
            letters = word.rstrip(_MARKS)
            low = letters.lower()
            # Python alone knows a final sigma, and two letters for one
            if letters.isalpha() and len(low) == len(letters) and "\u03a3" not in letters:
                marks = word[len(letters) :]
            else:
                low, marks = word, ""
            split.append((word, low, marks))
            parts.add(low)
            if marks:
                parts.add(marks)
        self._encode(list(parts.difference(self.parts)))
        get = self.parts.__getitem__
        self.words.update((w, get(low) + get(marks) if marks else get(low)) for w, low, marks in split)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        if not self.by_word:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        collects = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and the collector would walk the word lists again and again
        try:
            return self._encode_all(texts)
        finally:
            if collects:
                gc.enable()

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        out, held, chars = [], [], 0

        def flush() -> None:
            # one pass learns what the held texts need; a word may be forgotten only before that
            missing = set().union(*(set(words).difference(self.words) for words in held))
            if missing and len(self.words) + len(missing) > CACHE_WORDS:
                self.words.clear()
                missing = set().union(*map(set, held))
            self._learn(missing)
            out.extend(b"".join(map(self.words.__getitem__, words)) for words in held)
            for w in missing:
                if len(w) > CACHE_CHARS:
                    del self.words[w]
                    self.parts.pop(w, None)
            held.clear()

        for text in texts:
            odd = any(c in text for c in NOT_SPACES)
            held.append(text.translate(_SPACES).split(" ") if odd else text.split())
            chars += len(text)
            if chars > TOGETHER_CHARS:
                flush()
                chars = 0
        if held:
            flush()
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        t = _TOKENIZERS[path] = WordTokenizer(path)
        shared.remembered("packing", t.words, t.parts)
    return _TOKENIZERS[path]


PIECES = "piece int, start long, length int, ids_crc32 long, ids binary, part int, nth long"


def pieces(
    docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """The pieces of each document's ids (with end_id last), numbered within their task and length."""
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.remember_only("packing")
        tok, part = _tokenizer(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            of, piece, start, length, crc, raw, nth = [], [], [], [], [], [], []
            for row, ids in enumerate(tok.encode(b.column(1).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    of.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(cut))
                    raw.append(cut if keep_ids else None)
                    nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(of, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()),
                    pa.array(crc, pa.int64()),
                    pa.array(raw, pa.binary()),
                    pa.array([part] * len(of), pa.int32()),
                    pa.array(nth, pa.int64()),
                ],
                names=["id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return given.mapInArrow(run, f"id {kind}, {PIECES}")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots for counts of pieces by length: rows (length, first rank, count, first sequence, offset).

    The piece of rank first + k within its length lies in sequence first_sequence + k at that offset.
    Best fit, longest first: each piece goes to the fullest sequence that still has room for it; equal
    pieces are placed together on as many equal sequences as there are.
    """
    rooms: list[int] = []  # remaining tokens of the open groups, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, count)
    slots, sequences = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                count = -(-left // per)
                first, sequences = sequences, sequences + count
                for k in range(per):  # fill new sequences with this length, one after the other
                    take = min(left, count)
                    if take:
                        slots.append((length, rank, take, first, k * length))
                        rank, left = rank + take, left - take
                        if take < count:
                            put(capacity - k * length, first + take, count - take)
                            count = take
                    else:
                        put(capacity - k * length, first, count)
                        count = 0
                        break
                if count:
                    put(capacity - per * length, first, count)
                continue
            room = rooms[at]
            first, count = groups[room].pop()
            take = min(left, count)
            if take < count:
                groups[room].append((first + take, count - take))
            elif not groups[room]:
                del groups[room]
                del rooms[at]
            slots.append((length, rank, take, first, capacity - room))
            put(room - length, first, take)
            rank, left = rank + take, left - take
    return slots


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    keep_ids: bool = False,
) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens; one row per piece.

    ``path`` names a tokenizers file that every executor has. Columns: the id, piece (from 0), start (the
    document's ids before it), length, ids_crc32 (of the little-endian 32-bit ids), ids (if keep_ids),
    sequence_id and offset (gapless from 0 within a sequence). Only documents longer than a sequence are
    cut. Null and empty texts are the end token alone; repeated rows and null ids are packed like others;
    an empty table gives no rows. The driver sees the counts by length and the plan, whose size depends
    on ``capacity`` only.
    """
    spark = docs.sparkSession
    rows = shared.stored(pieces(docs, path, capacity, id_col, text_col, end_id, keep_ids))
    counts = shared.stored(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = sorted(plan(histogram, capacity))
    slots = np.array(planned, dtype=np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(slots)

    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length, rank):
        import pandas as pd

        s = sent.value
        starts = s[:, 0] << 44 | s[:, 1]
        row = np.searchsorted(starts, length.to_numpy().astype(np.int64) << 44 | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": s[row, 3] + rank.to_numpy() - s[row, 1], "offset": s[row, 4]})

    ranked = rows.join(before, ["length", "part"]).withColumn("slot", slot("length", F.col("nth") + F.col("before")))
    return ranked.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        *(["ids"] if keep_ids else []),
        "slot.sequence_id",
        "slot.offset",
    )
