"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of n-grams: of its words, and of its words' shapes (letters by case,
digits, other signs, whether the word repeats the one before). Each indicator is scaled by its
log-count ratio between the classes; a linear model of the hinge loss is then fitted by dual coordinate
descent, and its margins are turned into chances by a sigmoid fitted on margins of texts that the model
had not seen.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from barwright.llm import learning, shared
from barwright.llm.bpe import Recent

SHAPE_GRAMS = 4
MIN_TEXTS = 5
_SHAPES = (
    (re.compile(r"[^\W\d_]+"), lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a"),
    (re.compile(r"\d+"), lambda m: "0"),
    (re.compile(r"([^\w\s])\1+"), lambda m: m[1] + "+"),
)
_known = Recent(200_000)
shared.remembered("nbsvm", _known)
_REPEAT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _word(word: str) -> int:
    """Hashes of a word's shape (upper 32 bits) and of the word in lower case (lower 32 bits)."""
    code = _known.recall(word)
    if code is None:
        shape = word
        for pattern, to in _SHAPES:
            shape = pattern.sub(to, shape)
        code = zlib.crc32(shape.encode()) << 32 | zlib.crc32(word.lower().encode())
    return _known.put(word, code) if len(word) <= 64 else code


def features(text: str) -> np.ndarray:
    """The hashed n-grams of a whole text, each once. Every text has one feature at least."""
    words = text.split()
    get = _known.get
    found = list(map(get, words))
    if None in found:
        found = [_word(w) if c is None else c for w, c in zip(words, found)]
    code = np.array(found, dtype=np.uint64)
    shape = code >> np.uint64(32)
    if len(code) > 1:
        shape[1:] ^= np.where(code[1:] == code[:-1], _REPEAT, np.uint64(0))
    grams = [np.zeros(1, np.uint64), (code & np.uint64(0xFFFFFFFF)) * _MIX + np.uint64(77)]
    run = np.zeros(len(shape), np.uint64)
    for n in range(SHAPE_GRAMS):
        if n >= len(shape):
            break
        run = (run[: len(shape) - n] ^ shape[n:]) * _MIX + np.uint64(n + 1)
        run ^= run >> np.uint64(29)
        grams.append(run)
    return np.unique((np.concatenate(grams) >> np.uint64(16)).astype(np.uint32))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, width: int, alpha: float = 1.0) -> np.ndarray:
    counts = []
    for label in (1, 0):
        held = [r for r, k in zip(rows, y) if k == label]
        p = np.bincount(np.concatenate(held), minlength=width) if held else np.zeros(width)
        counts.append((p + alpha) / (p + alpha).sum())
    return np.log(counts[0] / counts[1])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 0.1, rounds: int = 20) -> np.ndarray:
    """Weights of the scaled indicators that minimise the L2-regularised hinge loss."""
    sign = np.where(y == 1, 1.0, -1.0)
    w = np.zeros(len(ratio))  # already times ratio: the weight of the plain indicator
    square = ratio**2
    norm = np.array([square[r].sum() for r in rows])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for k in rng.permutation(len(rows)):
            if norm[k] <= 0:
                continue
            r = rows[k]
            g = sign[k] * w[r].sum() - 1
            new = min(max(alpha[k] - g / norm[k], 0.0), c)
            if new != alpha[k]:
                w[r] += (new - alpha[k]) * sign[k] * square[r]
                most = max(most, abs(g))
                alpha[k] = new
        if most < 0.01:
            break
    return w


def train(rows: list[np.ndarray], y: np.ndarray, c: float = 0.1) -> dict:
    """Feature ids (sorted), their weights, and the sigmoid; or a constant where there is one class only."""
    y = (y == 1).astype(int)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y[0])}
    ids, counts = np.unique(np.concatenate(rows), return_counts=True)
    ids = ids[counts >= min(MIN_TEXTS, len(rows))]
    place = [np.flatnonzero(np.isin(ids, r, assume_unique=True)) for r in rows]
    half = np.random.default_rng(11).permutation(len(y)) % 2
    margins = np.zeros(len(y))
    for k in (0, 1):
        seen = [i for i in range(len(y)) if half[i] == k]
        ratio = log_count_ratios([place[i] for i in seen], y[seen], len(ids))
        w = dual_descent([place[i] for i in seen], y[seen], ratio, c)
        for i in np.flatnonzero(half != k):
            margins[i] = w[place[i]].sum()
    a, b = learning.platt(margins, y)
    w = dual_descent(place, y, log_count_ratios(place, y, len(ids)), c)
    used = w != 0
    return {"ids": ids[used], "w": w[used], "a": a, "b": b}


def score(model: dict | None, text: str, without_labels: float = 1.0) -> float:
    """The chance of label 1; a fixed score where there was nothing to learn from."""
    if model is None:
        return without_labels
    if "constant" in model:
        return model["constant"]
    f, ids = features(text), model["ids"]
    if not len(ids):
        return learning.sigmoid(model["b"])
    at = np.minimum(np.searchsorted(ids, f), len(ids) - 1)
    return learning.sigmoid(model["a"] * model["w"][at[ids[at] == f]].sum() + model["b"])


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> dict | None:
    return learning.fit(learning.labelled_sample(docs, labels, "quality", **bounds), features, train, "nbsvm")


def classify(
    docs: DataFrame, labels: DataFrame, cut: float = 0.3, bound: int = learning.SAMPLE_ROWS, sample_bytes: int | None = None,
    longest_bytes: int | None = None,
) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, the chance of quality 1), predicted.

    The model is fitted on at most ``bound`` labelled documents that are not held out, of ``sample_bytes`` of
    text together and none longer than ``longest_bytes``; every whole text is scored, however long. Null and empty texts get the score of a text without words; null ids are
    scored and not held out; repeated rows are scored alike; without labels the score is 1, with labels of
    one class that class. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound=bound, sample_bytes=sample_bytes, longest_bytes=longest_bytes))
    return learning.scored(docs, lambda t: score(model.value, t), "doc_id", "text", cut, "nbsvm")


def keep_good(
    docs: DataFrame, labels: DataFrame, cut: float = 0.3, bound: int = learning.SAMPLE_ROWS, sample_bytes: int | None = None,
    longest_bytes: int | None = None,
) -> DataFrame:
    """The documents that score at least ``cut``, all columns as they are.

    Null and empty texts score like texts without words; rows without an id and repeated rows are judged
    by their text like any other; columns may have any names. An empty table gives no rows. Whole texts are scored, however long; the
    sample is bounded as in ``classify``.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound=bound, sample_bytes=sample_bytes, longest_bytes=longest_bytes))
    return learning.kept_where(docs, lambda t: score(model.value, t), "text", lambda s: s >= cut, "nbsvm")
