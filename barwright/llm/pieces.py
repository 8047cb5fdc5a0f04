"""SentencePiece encoding that keeps track of the source: every piece has its span of the text's bytes.

A model file's normaliser is a compiled character map, a trie over bytes; at each place the longest prefix
that the trie holds is replaced, and where none is, one character is copied. The characters that come out
remember at which byte of the text theirs began, so the borders of pieces, found among normalised
characters by merging the pair of best score again and again, are looked up in that record: piece k spans
bytes bounds[k] to bounds[k + 1]. Of the bytes that stand for an unknown character the last has its span.

No piece of a usual vocabulary goes on past a space, so no merge crosses the border before one: texts are
cut there, and frequent words are remembered with their ids and lengths.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.llm import shared
from barwright.llm.bpe import CACHE_CHARS, CACHE_PIECES, Recent

SPACE = "▁"
LOST = "�"
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of a segment up to which looking at all pairs is quicker than a heap; no score is as bad as _NONE.
SHORT, _NONE = 32, float("inf")
_LOW = (1 << 32) - 1
_BROKEN = re.compile("[\udc80-\udcff]")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message's fields, nested messages as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
        at += size
        yield key >> 3, data[at - size : at]


def _decoded(raw: bytes) -> str:
    """The text of UTF-8 bytes; each byte that belongs to no character is a lone surrogate."""
    return raw.decode("utf-8", "surrogateescape")


def _widths(codes: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point; a lone surrogate is one byte that belongs to no character."""
    n = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    n[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
    return n


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes whose values point to replacements."""

    def __init__(self, blob: bytes = b""):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]
        self._starts: dict[str, bool] = {}

    def longest(self, data: bytes, at: int) -> tuple[int, str]:
        """Length of the longest prefix of data[at:] in the map, 0 if none, and what replaces it."""
        units, size, value = self.units, 0, 0
        node = units[0] >> 10 << ((units[0] & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                size, value = k + 1 - at, units[node] & 0x7FFFFFFF
        return size, self.texts[value : self.texts.index(b"\0", value)].decode() if size else ""

    def starts(self, char: str) -> bool:
        """Whether any prefix in the map begins with the character."""
        known = self._starts.get(char)
        if known is None:
            known = self._starts[char] = bool(self.units) and self._reaches(char.encode("utf-8", "surrogateescape"))
        return known

    def _reaches(self, data: bytes) -> bool:
        units = self.units
        node = units[0] >> 10 << ((units[0] & 512) >> 6)
        for b in data:
            node ^= b
            unit = units[node]
            if unit & 0x800000FF != b:
                return False
            node ^= unit >> 10 << ((unit & 512) >> 6)
        return True


class Normalizer:
    """Normalised characters of a text, each with the byte of the text where it began."""

    def __init__(self, spec: dict[int, int | bytes], user: list[str]):
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.user = sorted(user, key=len, reverse=True)
        self.plain = not self.map.units and not self.user and self.escape and not self.squeeze

    def _units(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(code points, byte where each began, whether copied): runs of copied characters and single replacements."""
        codes = _codes(text)
        begins = np.concatenate([[0], np.cumsum(_widths(codes))])
        codes = np.where((codes >= 0xDC80) & (codes <= 0xDCFF), ord(LOST), codes)
        special = "".join(re.escape(c) for c in sorted(set(text)) if self.map.starts(c))
        parts = [*map(re.escape, self.user), *([f"[{special}]"] if special else [])]
        found = re.compile("|".join(parts)) if parts else None
        data, at, done = text.encode("utf-8", "surrogateescape"), 0, 0
        while found and (m := found.search(text, at)):
            k = m.start()
            if m.group() in self.user:
                yield codes[done:k], begins[done:k], True
                at = done = m.end()
                yield codes[k:at], np.full(at - k, begins[k]), False
                continue
            size, new = self.map.longest(data, int(begins[k]))
            if not size:
                at = k + 1
                continue
            yield codes[done:k], begins[done:k], True
            at = done = int(np.searchsorted(begins, begins[k] + size))
            yield _codes(new), np.full(len(new), begins[k]), False
        yield codes[done:], begins[done:-1], True

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and where each of its characters began; at last, where all ended."""
        if not text:
            return "", np.zeros(1, np.int64)
        codes, begins, space = [], [], self.squeeze
        end = len(text.encode("utf-8", "surrogateescape"))
        for c, b, copied in self._units(text):
            if self.squeeze and len(c):
                blank = c == 32
                if copied:
                    keep = ~(blank & np.concatenate([[space], blank[:-1]]))
                else:
                    keep = np.logical_or.accumulate(~blank) if space else np.ones(len(c), bool)
                c, b = c[keep], b[keep]
                space = bool(blank[-1]) if len(c) or copied else space
            codes.append(c)
            begins.append(b)
        codes, begins = np.concatenate(codes), np.concatenate(begins)
        if self.squeeze and not len(codes):
            return "", np.full(1, end)
        if self.prefix:
            codes = np.concatenate([[32], codes])
            begins = np.concatenate([begins[:1] if self.squeeze else [0], begins])
        if self.escape:
            codes[codes == 32] = ord(SPACE)
        if self.squeeze:
            last = len(codes)
            while last and codes[last - 1] == (ord(SPACE) if self.escape else 32):
                last -= 1
                end = int(begins[last])
            codes, begins = codes[:last], begins[:last]
        return codes.astype("<u4").tobytes().decode("utf-32-le"), np.append(begins, end).astype(np.int64)


class Model:
    """A BPE model file: pieces with scores, byte fallback, normaliser. Other kinds of models raise."""

    def __init__(self, data: bytes):
        pieces, trainer, spec, back = [], {}, {}, {}
        for number, value in _fields(data):
            if number == 1:
                d = dict(_fields(value))
                pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, bytes(4)))[0], d.get(3, NORMAL)))
            elif number in (2, 3, 5):
                (trainer if number == 2 else spec if number == 3 else back).update(_fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or back.get(2):
            raise ValueError("only BPE models with spaces before words and without a denormaliser are known")
        self.texts = [p for p, _, _ in pieces]
        self.kinds = [kind for _, _, kind in pieces]
        self.ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER, UNUSED)}
        self.packed = {p: k | len(p) << 32 for p, k in self.ids.items()}
        self.scores = {p: -score for p, score, kind in pieces if kind in (NORMAL, USER, UNUSED)}
        self.unknown = self.kinds.index(UNKNOWN)
        self.fallback = bool(trainer.get(35, 0))
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unused = {p for p, _, kind in pieces if kind == UNUSED}
        user = [p for p, _, kind in pieces if kind == USER]
        self.user = re.compile("(" + "|".join(map(re.escape, sorted(user, key=len, reverse=True))) + ")") if user else None
        self.normalizer = Normalizer(spec, user)
        #: Neighbours within pieces: between others no merge crosses, so a text may be cut there.
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: Whether words, each with the spaces before it, can be encoded apart.
        self.by_word = not user and self.fallback and not any(p[1] == SPACE != p[0] for p in self.joined)
        unknown_text = trainer.get(44, " ⁇ ".encode())
        self.said = [
            b"" if kind == CONTROL else unknown_text if kind == UNKNOWN else bytes([int(p[3:5], 16)]) if kind == BYTE
            else p.replace(SPACE, " ").encode()
            for p, _, kind in pieces
        ]

    @classmethod
    def load(cls, path: str) -> Model:
        return cls(Path(path).read_bytes())

    def _symbols(self, segment: str) -> tuple[list[str], list[bool]]:
        """Where merging begins: characters, and user-defined symbols, which stay as they are."""
        if not self.user:
            return list(segment), []
        symbols, frozen = [], []
        for k, part in enumerate(self.user.split(segment)):
            symbols.extend([part] if k % 2 else part)
            frozen.extend([k % 2 == 1] * (1 if k % 2 else len(part)))
        return symbols, frozen

    def merge(self, segment: str) -> list[str]:
        """The pieces of a normalised segment: the pair of best score merges first, of equals the leftmost."""
        if len(segment) <= SHORT and not self.user and not self.unused:
            return self._merge_short(segment)
        return self._merge_long(segment)

    def _merge_short(self, segment: str) -> list[str]:
        """Looks all pairs over for the best each time."""
        text, score = list(segment), self.scores.get
        scores = [score(a + b, _NONE) for a, b in zip(text, text[1:])]
        while scores:
            best = min(scores)
            if best == _NONE:
                break
            k = scores.index(best)
            text[k] += text.pop(k + 1)
            del scores[k]
            if k:
                scores[k - 1] = score(text[k - 1] + text[k], _NONE)
            if k < len(scores):
                scores[k] = score(text[k] + text[k + 1], _NONE)
        return text

    def _merge_long(self, segment: str) -> list[str]:
        """Keeps the pairs in a heap."""
        text, frozen = self._symbols(segment)
        n, score = len(text), self.scores.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        halves: dict[str, tuple[str, str]] = {}
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            joint = text[a] + text[b]
            s = score(joint)
            if s is None or frozen and (frozen[a] or frozen[b]):
                return
            heapq.heappush(heap, (s, a, b, len(joint)))
            if joint in self.unused:
                halves[joint] = (text[a], text[b])

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            # a symbol only grows, or goes into the one before it, so lengths tell a pair that is no more
            if not text[a] or not text[b] or len(text[a]) + len(text[b]) != size:
                continue
            text[a] += text[b]
            text[b] = ""
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        out, todo = [], [t for t in reversed(text) if t]
        while todo:
            piece = todo.pop()
            if piece in self.unused and piece in halves:
                todo.extend(reversed(halves[piece]))
            else:
                out.append(piece)
        return out

    def encode_segment(self, segment: str) -> bytes:
        """The segment's ids, each with its number of normalised characters above it, as 64-bit numbers."""
        pieces = self.merge(segment)
        found = list(map(self.packed.get, pieces))
        if None not in found:
            return array("Q", found).tobytes()
        out = array("Q")
        for piece, code in zip(pieces, found):
            if code is not None:
                out.append(code)
            elif self.fallback:
                out.extend([self.bytes[b] for b in piece.encode()])
                out[-1] |= len(piece) << 32
            elif out and out[-1] & _LOW == self.unknown:
                out[-1] += len(piece) << 32
            else:
                out.append(self.unknown | len(piece) << 32)
        return out.tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for; bytes that form no character become U+FFFD, each."""
        said = list(map(self.said.__getitem__, ids))
        n = self.normalizer
        for k, i in enumerate(ids if n.prefix or n.squeeze else ()):
            kind = self.kinds[i]
            if kind == BYTE or kind == UNKNOWN:
                break
            if kind != CONTROL and said[k].startswith(b" "):
                said[k] = said[k][1:]
                if not n.squeeze:
                    break
            if said[k]:
                break
        raw = b"".join(said)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _BROKEN.sub(LOST, _decoded(raw))


class Encoder:
    """Encodes whole texts, frequent words and parts of words remembered."""

    def __init__(self, model: Model):
        self.model = model
        self._words, self._bits = Recent(CACHE_PIECES), Recent(CACHE_PIECES)
        self._segments = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._letters = re.compile(r"\w+|\W+")

    def _word(self, word: str) -> bytes:
        """A word with one space before it."""
        codes = self._words.recall(word)
        if codes is None:
            if word.isalpha():
                codes = self.model.encode_segment(SPACE + word)
            else:
                first, *bits = self._cut(word)
                get = self._bits.get
                codes = (self._words.get(first) if bits else None) or self.model.encode_segment(SPACE + first)
                codes += b"".join([get(b) or self._bit(b) for b in bits])
        return self._words.put(word, codes) if len(word) <= CACHE_CHARS else codes

    def _bit(self, bit: str) -> bytes:
        codes = self._bits.recall(bit) or self.model.encode_segment(bit)
        return self._bits.put(bit, codes) if len(bit) <= CACHE_CHARS else codes

    def _cut(self, word: str) -> list[str]:
        """The word cut between letters and others where no piece goes across."""
        out, joined = [""], self.model.joined
        for part in self._letters.findall(word):
            if not out[-1] or out[-1][-1] + part[0] in joined:
                out[-1] += part
            else:
                out.append(part)
        return out

    def _segment(self, segment: str) -> bytes:
        if segment[0] == SPACE and segment[1:2] != SPACE:
            return self._words.get(segment[1:]) or self._word(segment[1:])
        return self.model.encode_segment(segment)

    def _codes(self, normal: str) -> bytes:
        if not self.model.by_word:
            return self.model.encode_segment(normal)
        if not normal.startswith(SPACE) or SPACE * 2 in normal or normal.endswith(SPACE):
            return b"".join([self._segment(s) for s in self._segments.findall(normal)])
        words, known = normal[1:].split(SPACE), self._words.get
        found, k = list(map(known, words)), -1
        for _ in range(found.count(None)):
            k = found.index(None, k + 1)
            found[k] = known(words[k]) or self._word(words[k])
        return b"".join(found)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): piece k spans the text's bytes bounds[k] to bounds[k + 1]."""
        n = self.model.normalizer
        if n.plain and SPACE not in text and (text.isascii() or not _BROKEN.search(text)):
            # spaces are escaped and no more: the record of sources is the text's own
            normal = (SPACE if n.prefix and text else "") + text.replace(" ", SPACE)
            begins = None
        else:
            normal, begins = n(text)
        codes = np.frombuffer(self._codes(normal), dtype=np.uint64)
        ids, chars = (codes & np.uint64(_LOW)).astype(np.uint32), codes >> np.uint64(32)
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(chars.astype(np.int64), out=at[1:])
        if begins is not None:
            return ids, begins[at]
        if normal and n.prefix:
            at[1:] -= 1
        if not text.isascii():
            begins = np.zeros(len(text) + 1, np.int64)
            np.cumsum(_widths(_codes(text)), out=begins[1:])
            at = begins[at]
        return ids, at


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a model file that every executor has."""
    if path not in _ENCODERS:
        e = _ENCODERS[path] = Encoder(Model.load(path))
        shared.remembered("pieces", e._words, e._bits)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, bounds array<long>, decoded) per row: the whole text's pieces, the bytes of the text
    that each spans (piece k: bounds[k] to bounds[k + 1]), and the text that the ids decode to.

    Null texts count as empty: no ids, bounds [0]. Texts of any length are encoded whole, a very long word in
    n log n; repeated rows and null ids have rows of their own. Other columns, whatever their names, are
    ignored; an empty table gives no rows. Bytes that are no UTF-8 count as U+FFFD, each.
    """
    return _encoded(docs, path, id_col, text_col, False)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 (hex) of the decimal ids joined by commas and of the decoded text's UTF-8,
    and CRC-32 of the bounds (little-endian, 64 bits each). Odd rows as in ``encode``.
    """
    return _encoded(docs, path, id_col, text_col, True)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    shared.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "bounds_crc32"] if digest else ["id", "ids", "bounds", "decoded"]
    types = ["long", "string", "string", "long"] if digest else ["array<int>", "array<long>", "string"]
    arrow = [pa.int64(), pa.string(), pa.string(), pa.int64()] if digest else [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.remember_only("pieces")
        e = encoder(path)
        said = [str(k) for k in range(len(e.model.texts))]
        for b in batches:
            rows = []
            for raw in b.column(1):
                ids, bounds = e.encode(_decoded(raw.as_py()))
                listed = ids.tolist()
                back = e.model.decode(listed)
                if digest:
                    joined = ",".join([said[k] for k in listed]).encode()
                    crc = zlib.crc32(bounds.astype("<i8").tobytes())
                    rows.append((len(listed), hashlib.sha256(joined).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), crc))
                else:
                    rows.append((ids.astype(np.int32), bounds, back))
            columns = zip(*rows) if rows else ((),) * len(arrow)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, arrow))], names=names)

    given = docs.select(F.col(id_col).alias("id"), shared.text_bytes(text_col).alias("t"))
    schema = f"id {kind}, " + ", ".join(f"{n} {t}" for n, t in zip(names[1:], types))
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
