"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words in lower case without outer punctuation, and the words' first letters (so
that inflected forms share a term). The machine scores w0 + sum w_i + sum over pairs <v_i, v_j> over the
terms present: the linear weights find words that are enough on their own, the factors find pairs, such
as an insult with a group's mention, that are worse together than apart. A term takes part if it goes
with the label alone, or if some pair that it is in does beyond what its two terms do by themselves; so
a pair of words that each say nothing is learnt too, however rare its words are, from a few texts on. All terms that take part have factors. Linear
weights are learnt by follow-the-regularised-leader steps with an L1 penalty, factors by AdaGrad.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame

from barwright.llm import learning, shared
from barwright.llm.bpe import Recent

#: Letters of the word beginnings that are terms of their own.
PREFIXES = (5, 7)
FACTORS = 4
FOLDS = 3
#: Rounds of linear weights alone, and the round from which factors that don't pay for themselves are shrunk.
ALONE, SHRINK_FROM = 2, 4
MIN_TEXTS = 3
#: Least chi-square of a term's presence against the label for the term to take part on its own.
MIN_ASSOCIATION = 12.0
#: Distinct texts that a term, and a pair of terms, must stand in for the pair to be tested; and the number of
#: pairs that may pass by chance among all that are tested, with labels at random.
PAIR_TEXTS, BY_CHANCE = 20, 0.1
_OUTER = ".,;:!?\"'()[]{}<>|*#$%&-_"
_known = Recent(200_000)
shared.remembered("fm", _known)


def terms(word: str) -> tuple[int, ...]:
    """The hashed terms of one word: its own is odd, those of its beginnings are even."""
    found = _known.recall(word)
    if found is None:
        bare = word.lower().strip(_OUTER)
        parts = [f"{n} {bare[:n]}" for n in PREFIXES if len(bare) > n]
        found = (zlib.crc32(f"w {bare}".encode()) | 1, *(zlib.crc32(p.encode()) & ~1 for p in parts)) if bare else ()
    return _known.put(word, found) if len(word) <= 64 else found


def features(text: str) -> np.ndarray:
    """The hashed terms of a whole text, each once."""
    get = _known.get
    seen: set[int] = set()
    for word in set(text.split()):
        seen.update(get(word) or terms(word))
    return np.fromiter(sorted(seen), dtype=np.uint32, count=len(seen))


def _margin(w0: float, w: np.ndarray, v: np.ndarray) -> float:
    if not len(w):
        return w0
    s = v.sum(axis=0)
    return w0 + w.sum() + 0.5 * ((s * s).sum() - (v * v).sum())


def telling_terms(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The terms, sorted, whose presence goes with the label more than chance would have it."""
    ids, counts = np.unique(np.concatenate(rows), return_counts=True)
    ones, in_ones = np.unique(np.concatenate([r for r, k in zip(rows, y) if k == 1]), return_counts=True)
    a = np.zeros(len(ids))
    a[np.searchsorted(ids, ones)] = in_ones
    n, n1 = len(y), y.sum()
    b, c = counts - a, n1 - a
    d = n - n1 - b
    chi = n * (a * d - b * c) ** 2 / np.maximum(counts * (n - counts) * n1 * (n - n1), 1e-9)
    return ids[(chi >= MIN_ASSOCIATION) & (counts >= min(MIN_TEXTS, n))]


def _joint_evidence(n11, t11, ni, ti, nj, tj, n: int, t: float) -> np.ndarray:
    """Twice the log-likelihood ratio of the share of label 1 among texts with both terms against the share that
    adds up from the texts with one or neither; that share is first moved towards the one seen by three of its own
    deviations. By Chernoff's bound chance reaches a value of g with a probability of exp(-g / 2) at most.
    """
    def share(m, k):
        p = (k + t / n) / (m + 1.0)
        return p, p * (1 - p) / (m + 1.0)

    a, va = share(ni - n11, ti - t11)
    b, vb = share(nj - n11, tj - t11)
    c, vc = share(n - ni - nj + n11, t - ti - tj + t11)
    seen, slack = t11 / n11, 3 * np.sqrt(va + vb + vc)
    sums = np.clip(a + b - c, 0.0, 1.0)
    p = np.clip(np.where(seen > sums, np.minimum(seen, sums + slack), np.maximum(seen, sums - slack)), 1e-3, 1 - 1e-3)

    def part(k, q):
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / (n11 * q)), 0.0)

    return 2 * (part(t11, p) + part(n11 - t11, 1 - p))


def paired_terms(rows: list[np.ndarray], y: np.ndarray, least: int = PAIR_TEXTS, by_chance: float = BY_CHANCE) -> np.ndarray:
    """The terms, sorted, of pairs whose presence together goes with the label beyond the terms' own parts.

    All pairs of words (not of their beginnings) that stand together in ``least`` texts or more are tested, and as many may pass in error as
    ``by_chance`` says, all pairs taken together. Texts with the same terms count once, so copies don't make a pair
    look certain. The pairs of one term are counted at a time, over the texts that have it: the memory is that of
    the texts, the time the sum of the squared numbers of their terms.
    """
    alike = {r.tobytes(): k for k, r in enumerate(rows)}
    rows, y = [rows[k] for k in alike.values()], y[list(alike.values())]
    ids, counts = np.unique(np.concatenate(rows), return_counts=True)
    ids = ids[(counts >= least) & (ids % 2 == 1)]
    if len(ids) < 2:
        return ids[:0]
    place = [np.searchsorted(ids, r[np.isin(r, ids, assume_unique=True)]) for r in rows]
    ones = [p for p, k in zip(place, y) if k == 1]
    c, c1 = (np.bincount(np.concatenate([*x, np.zeros(0, np.int64)]), minlength=len(ids)) for x in (place, ones))
    sizes = [len(p) for p in place]
    order = np.argsort(np.concatenate(place), kind="stable")
    holders = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[order]
    # of each text that has a term, how many of its terms come before it: with those it makes pairs
    before = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])[order]
    ends, toxic = np.cumsum(c).tolist(), (y == 1).tolist()
    n, n1, size = len(rows), float(y.sum()), len(ids)
    need = 2 * np.log(max(1.0, size * (size - 1) / 2 / by_chance))
    found, at = np.zeros(size, dtype=bool), 0
    for i, end in enumerate(ends):
        mine, at = list(zip(holders[at:end].tolist(), before[at:end].tolist())), end
        both = np.bincount(np.concatenate([place[k][:m] for k, m in mine]), minlength=i)
        j = np.flatnonzero(both >= least)
        if not len(j):
            continue
        with_label = [place[k][:m] for k, m in mine if toxic[k]]
        label = np.bincount(np.concatenate(with_label), minlength=i)[j] if with_label else np.zeros(len(j))
        told = j[_joint_evidence(both[j], label, c[i], c1[i], c[j], c1[j], n, n1) >= need]
        found[told] = True
        found[i] |= len(told) > 0
    return ids[found]


def descend(
    rows: list[np.ndarray], y: np.ndarray, rounds: int = 7, rate: float = 0.3, l1: float = 0.3, l2: float = 1e-3, group: float = 0.3
) -> dict:
    """Term ids (sorted), weights and factors that minimise the logistic loss.

    The linear weights go first, so that factors learn what these leave over; terms whose factors don't
    pay for themselves end without any.
    """
    ids = np.union1d(telling_terms(rows, y), paired_terms(rows, y))
    place = [np.flatnonzero(np.isin(ids, r, assume_unique=True)) for r in rows]
    rng = np.random.default_rng(5)
    z, n = np.zeros(len(ids)), np.zeros(len(ids))
    w = np.zeros(len(ids))
    v = rng.normal(0, 0.01, (len(ids), FACTORS))
    nv = np.full((len(ids), FACTORS), 0.1)
    w0, n0 = 0.0, 1.0
    for at in range(rounds):
        alone, shrink = at < ALONE, group if at >= SHRINK_FROM else 0.0
        for k in rng.permutation(len(rows)):
            r = place[k]
            vr = v[r]
            g = learning.sigmoid(_margin(w0, w[r], vr)) - y[k]
            if abs(g) < 1e-3:
                continue
            n0 += g * g
            w0 -= rate * g / np.sqrt(n0)
            if not len(r):
                continue
            old = n[r]
            new = old + g * g
            z[r] += g - (np.sqrt(new) - np.sqrt(old)) / rate * w[r]
            n[r] = new
            zr = z[r]
            w[r] = np.where(np.abs(zr) <= l1, 0.0, -(zr - np.sign(zr) * l1) / (np.sqrt(new) / rate + l2))
            if alone:
                continue
            gv = g * (vr.sum(axis=0) - vr) + l2 * vr
            nv[r] += gv * gv
            step = 0.1 / np.sqrt(nv[r])
            moved = vr - step * gv
            # all factors of a term shrink together, so those that don't pay for themselves vanish
            size = np.sqrt((moved * moved).sum(axis=1, keepdims=True)) + 1e-12
            v[r] = moved * np.maximum(0.0, 1 - shrink * step.mean(axis=1, keepdims=True) / size)
    used = (w != 0) | (v != 0).any(axis=1)
    return {"ids": ids[used], "w": w[used], "v": v[used], "w0": w0}


def train_part(rows: list[np.ndarray], y: np.ndarray, k: int) -> dict:
    """Part k of the fit: for k below FOLDS the margins of a fold's texts by a machine that had not seen them,
    for k = FOLDS the machine of all texts; or a constant where there is one class only."""
    y = (y == 1).astype(float)
    if len(set(y.tolist())) < 2:
        return {"constant": float(y[0])}
    if k == FOLDS:
        return descend(rows, y)
    fold = np.random.default_rng(11).permutation(len(y)) % FOLDS
    seen, kept = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
    part = descend([rows[i] for i in seen], y[seen]) if 0 < y[seen].sum() < len(seen) else None
    margins = [margin(part, np.flatnonzero(np.isin(part["ids"], rows[i], assume_unique=True))) if part else 0.0 for i in kept]
    return {"margins": np.array(margins), "y": y[kept]}


def joined(parts: list[dict]) -> dict:
    """The machine with a sigmoid fitted on the margins of all folds."""
    *folds, model = parts
    if "constant" in model:
        return model
    a, b = learning.platt(*(np.concatenate([f[c] for f in folds]) for c in ("margins", "y")))
    return model | {"a": a, "b": b}


def train(rows: list[np.ndarray], y: np.ndarray) -> dict:
    """All parts of the fit, one after the other."""
    return joined([train_part(rows, y, k) for k in range(FOLDS + 1)])


def margin(model: dict, at) -> float:
    return _margin(model["w0"], model["w"][at], model["v"][at])


def score(model: dict | None, text: str, without_labels: float = 0.0) -> float:
    """The chance of label 1; a fixed score where there was nothing to learn from."""
    if model is None:
        return without_labels
    if "constant" in model:
        return model["constant"]
    table = model.get("places")
    if table is None:
        table = model["places"] = {int(i): k for k, i in enumerate(model["ids"])}
    get, place = _known.get, table.get
    hits = set()
    for word in set(text.split()):
        for t in get(word) or terms(word):
            k = place(t)
            if k is not None:
                hits.add(k)
    return learning.sigmoid(model["a"] * margin(model, sorted(hits)) + model["b"])


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> dict | None:
    parts = learning.fit_parts(learning.labelled_sample(docs, labels, "toxic", **bounds), features, train_part, FOLDS + 1, "fm")
    return joined(parts) if parts else None


def classify(
    docs: DataFrame, labels: DataFrame, cut: float = 0.5, bound: int = learning.SAMPLE_ROWS, sample_bytes: int | None = None,
    longest_bytes: int | None = None,
) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, the chance of being toxic), predicted.

    The machine is fitted on at most ``bound`` labelled documents that are not held out, of ``sample_bytes`` of
    text together and none longer than ``longest_bytes``; every whole text is scored, however long. Null and empty texts get the score of a text without terms; null ids are
    scored and not held out; repeated rows are scored alike; without labels the score is 0, with labels of
    one class that class. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound=bound, sample_bytes=sample_bytes, longest_bytes=longest_bytes))
    return learning.scored(docs, lambda t: score(model.value, t), "doc_id", "text", cut, "fm")


def keep_civil(
    docs: DataFrame, labels: DataFrame, cut: float = 0.5, bound: int = learning.SAMPLE_ROWS, sample_bytes: int | None = None,
    longest_bytes: int | None = None,
) -> DataFrame:
    """The documents that score below ``cut``, all columns as they are.

    Null and empty texts score like texts without terms; rows without an id and repeated rows are judged
    by their text like any other; columns may have any names. An empty table gives no rows. Whole texts are scored, however long; the
    sample is bounded as in ``classify``.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound=bound, sample_bytes=sample_bytes, longest_bytes=longest_bytes))
    return learning.kept_where(docs, lambda t: score(model.value, t), "text", lambda s: s < cut, "fm")
