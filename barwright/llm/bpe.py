"""Byte-level BPE by prefix dynamic programming, one table row per byte prefix.

For a fixed vocabulary every byte prefix of a piece has exactly one encoding, so it has exactly one
last token. The table stores that token for each prefix; the encoding is read off backwards. A token t
that ends at a prefix is its last token if it stands alone there, or if the last token of the prefix
before t may be followed by t: merging the two side by side would not have crossed their border. As a
row depends only on rows at most one longest token back, bytes can be appended exactly, and after an
edit the old rows hold again once a longest token's worth of rows agree.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from barwright.llm import shared

#: Pieces, words and pairs of tokens that a Python worker remembers before it forgets the unused ones.
CACHE_PIECES = 250_000
KNOWN_PAIRS = 500_000
#: Longer pieces and words are encoded each time they occur.
CACHE_CHARS = 64
_FREE = 1 << 60


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary (token bytes -> rank, rank being the id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        #: Of each token that merging its own bytes reaches, the two tokens of the last merge.
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        #: Pairs of tokens already decided.
        self.known_follows: dict[tuple[int, int], bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                continue
            parts = PrefixTable(self, token).encoding()  # by the tokens of lower rank
            if len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
                self.merged[parts[0], parts[1]] = rank
                self.known_follows.clear()
        self.known_follows.clear()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a file of lines "base64 rank"."""
        lines = map(bytes.split, Path(path).read_bytes().splitlines())
        return cls({base64.b64decode(a): int(b) for a, b in lines})

    def follows(self, left: int, right: int) -> bool:
        """Whether the encodings ending in left and starting with right stay apart side by side.

        The merges of both are undone from the latest back. At each state the two tokens at the border
        must not have a merge earlier than what was undone last on either side.
        """
        a, b, before = left, right, _FREE
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < before:
                good = False
                break
            halves_a, halves_b = self.halves[a], self.halves[b]
            whole_a, whole_b = halves_a[0] == a, halves_b[0] == b
            if whole_a and whole_b:
                good = True
                break
            # Of equal merges the left one came first, so the right one is undone first.
            if whole_a or (not whole_b and b >= a):
                before, b = b + 1, halves_b[0]
            else:
                before, a = a, halves_a[1]
        if len(self.known_follows) >= KNOWN_PAIRS:
            self.known_follows.clear()
        self.known_follows[left, right] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-split piece; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else PrefixTable(self, piece).encoding()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary = vocabulary
        self.piece = b""
        self.last: list[int] = []
        self.append(piece)

    def _fill(self, start: int, upto: int) -> None:
        """Rows start to upto - 1; those before stand in self.last already."""
        v, last = self.vocabulary, self.last
        origin = max(0, start - v.longest)
        last.extend([-1] * (upto - start))
        known, halves = v.known_follows, v.halves
        for end, (size, token) in v.automaton.iter(self.piece[origin:upto].decode("latin-1")):
            end += origin
            if end < start or last[end] >= 0 or token not in halves:
                continue
            if end < size:
                if end + 1 == size:
                    last[end] = token
                continue
            left = last[end - size]
            good = known.get((left, token))
            if good or good is None and v.follows(left, token):
                last[end] = token
        if -1 in last[start:]:
            raise ValueError("no token ends at some byte: the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Grows the table; earlier rows stay as they are, and the encoding is that of the whole."""
        start, self.piece = len(self.piece), self.piece + more
        self._fill(start, len(self.piece))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new bytes in place of piece[start:end]; returns how many rows were computed anew."""
        tail, step = self.last[end:], self.vocabulary.longest
        self.piece = self.piece[:start] + new + self.piece[end:]
        del self.last[start:]
        first_kept = start + len(new)
        self._fill(start, first_kept)
        at = first_kept
        while at < len(self.piece):
            upto = min(at + step, len(self.piece))
            self._fill(at, upto)
            if self.last[at:upto] == tail[at - first_kept : upto - first_kept]:
                self.last.extend(tail[upto - first_kept :])
                return upto - start
            at = upto
        return at - start

    def encoding(self) -> list[int]:
        """The ids of the whole piece, read off from its end."""
        ids, end, tokens = [], len(self.last), self.vocabulary.tokens
        while end:
            token = self.last[end - 1]
            ids.append(token)
            end -= len(tokens[token])
        return ids[::-1]


class Recent(dict):
    """A dictionary of bounded size: once full, only what is asked for again is carried on."""

    def __init__(self, most: int):
        self.most = most
        self.before: dict = {}

    def put(self, key, value):
        if len(self) >= self.most:
            self.before = dict(self)
            super().clear()
        self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.before = {}

    def recall(self, key):
        value = self.before.get(key)
        return None if value is None else self.put(key, value)


class Encoder:
    """Encodes whole texts: each match of the pattern apart, frequent pieces and words remembered.

    A text is looked up word by word, a word being what stands between two spaces, together with the
    space before it. Every match of a pattern like GPT-2's ends before a space, unless that space has
    white space on both sides; texts with such runs are split by the pattern as a whole.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(pattern)
        self._pieces = Recent(CACHE_PIECES)
        self._words = Recent(CACHE_PIECES)

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.recall(piece) or array("I", self.vocabulary.encode_piece(piece.encode())).tobytes()
        return self._pieces.put(piece, ids) if len(piece) <= CACHE_CHARS else ids

    def _split(self, text: str) -> bytes:
        get = self._pieces.get
        return b"".join([get(p) or self._piece(p) for p in self.pattern.findall(text)])

    def _word(self, word: str) -> bytes:
        ids = self._words.recall(word) or self._split(" " + word)
        return self._words.put(word, ids) if len(word) <= CACHE_CHARS else ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of the text as 32-bit numbers."""
        first, *words = text.split(" ")
        found = list(map(self._words.get, words))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    word = words[k]
                    if not word or word[0].isspace():
                        return np.frombuffer(self._split(text), dtype=np.uint32)
                    found[k] = self._words.get(word) or self._word(word)
        return np.frombuffer(self._split(first) + b"".join(found), dtype=np.uint32)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This process's encoder for a vocabulary file that every executor has."""
    if (path, pattern) not in _ENCODERS:
        e = _ENCODERS[path, pattern] = Encoder(Vocabulary.load(path), pattern)
        shared.remembered("bpe", e._pieces, e._words, e.vocabulary.known_follows)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) per row: the whole text's ids, and the bytes they decode to.

    Null texts count as empty: no ids. Repeated rows and null ids are returned as they come; other
    columns are ignored.
    """
    return _encoded(docs, path, pattern, id_col, text_col, False)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, and SHA-256 (hex) of the decimal ids joined by commas and of the decoded bytes.

    Null texts count as empty: no ids, and digests of nothing. Texts of any length are encoded whole;
    repeated rows and null ids have rows of their own. Other columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    return _encoded(docs, path, pattern, id_col, text_col, True)


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.remember_only("bpe")
        e = encoder(path, pattern)
        names = [str(k) for k in range(max(e.vocabulary.tokens) + 1)]
        for b in batches:
            rows = []
            for text in b.column(1):
                ids = e.encode(text.as_py())
                listed = ids.tolist()
                back = e.vocabulary.decode(listed)
                if digest:
                    joined = ",".join([names[k] for k in listed]).encode()
                    rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(back).hexdigest()))
                else:
                    rows.append((ids.astype(np.int32), back))
            if digest:
                n, ids_hex, back_hex = zip(*rows) if rows else ((), (), ())
                columns = [pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(back_hex, pa.string())]
                names_out = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                offsets = np.cumsum([0, *(len(i) for i, _ in rows)], dtype=np.int32)
                flat = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int32)
                columns = [
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array([x for _, x in rows], pa.binary()),
                ]
                names_out = ["id", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names_out)

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"
    return given.mapInArrow(run, f"id {kind}, {out}").withColumnRenamed("id", id_col)
