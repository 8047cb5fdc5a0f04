"""The factorization machine's pair search and descent against plain Python."""

import itertools
import math

import numpy as np

from barwright.llm import fm, learning, nearcopies, shared


def texts(n, words, each, rng):
    return [np.array(sorted(2 * rng.choice(words, each, replace=False) + 11), dtype=np.uint32) for _ in range(n)]


def test_two_words_that_say_nothing_alone_are_found_however_rare():
    rng = np.random.default_rng(1)
    rows, y = texts(4000, 3000, 40, rng), rng.integers(0, 2, 4000)
    for k in range(180):
        add, y[k] = (((1, 3), 1), ((1,), 0), ((3,), 0))[k % 3]
        rows[k] = np.union1d(rows[k], np.array(add, dtype=np.uint32))
    assert fm.paired_terms(rows, y).tolist() == [1, 3]
    assert not len(fm.telling_terms(rows, y)) or not {1, 3} & set(fm.telling_terms(rows, y).tolist())


def test_labels_at_random_select_next_to_nothing():
    rng = np.random.default_rng(2)
    rows = texts(2000, 400, 30, rng)
    passed = [len(fm.paired_terms(rows, rng.permutation(np.arange(2000) % 10 == 0).astype(int))) for _ in range(5)]
    assert sum(passed) <= 2


def test_every_pair_is_looked_at():
    rng = np.random.default_rng(3)
    rows = texts(1200, 30, 7, rng)
    y = np.array([int({11, 13} <= set(r.tolist()) or rng.random() < 0.2) for r in rows])
    distinct = {r.tobytes(): k for k, r in enumerate(rows)}
    rows, y = [rows[k] for k in distinct.values()], y[list(distinct.values())]
    sets, n, t = [set(r.tolist()) for r in rows], len(rows), int(sum(y))
    ids = sorted(w for w in set().union(*sets) if sum(w in s for s in sets) >= fm.PAIR_TEXTS)
    need = 2 * math.log(len(ids) * (len(ids) - 1) / 2 / 0.1)

    def share(cell):
        p = (sum(y[k] for k in cell) + t / n) / (len(cell) + 1)
        return p, p * (1 - p) / (len(cell) + 1)

    want = set()
    for i, j in itertools.combinations(ids, 2):
        cells = {(a, b): [k for k, s in enumerate(sets) if (i in s, j in s) == (a, b)] for a in (True, False) for b in (True, False)}
        both = cells[True, True]
        if len(both) < fm.PAIR_TEXTS:
            continue
        (a, va), (b, vb), (c, vc) = (share(cells[x]) for x in ((True, False), (False, True), (False, False)))
        ones, sums, slack = sum(y[k] for k in both), min(1, max(0, a + b - c)), 3 * math.sqrt(va + vb + vc)
        seen = ones / len(both)
        p = min(seen, sums + slack) if seen > sums else max(seen, sums - slack)
        p = min(1 - 1e-3, max(1e-3, p))
        g = 2 * sum(k * math.log(k / (len(both) * q)) for k, q in ((ones, p), (len(both) - ones, 1 - p)) if k)
        if g >= need:
            want |= {i, j}
    assert set(fm.paired_terms(rows, y).tolist()) == want and {11, 13} <= want


def plain_descend(ids, rows, y, rounds=7, rate=0.3, l1=0.3, l2=1e-3, group=0.3):
    """The same steps, one number at a time."""
    rng, f = np.random.default_rng(5), fm.FACTORS
    z, n, w = ({i: 0.0 for i in ids} for _ in range(3))
    start = rng.normal(0, 0.01, (len(ids), f)).tolist()
    v = dict(zip(ids, start))
    nv = {i: [0.1] * f for i in ids}
    w0, n0 = 0.0, 1.0
    for at in range(rounds):
        for k in rng.permutation(len(rows)):
            here = [i for i in ids if i in rows[k]]
            sums = [sum(v[i][q] for i in here) for q in range(f)]
            pairs = 0.5 * sum(sums[q] ** 2 - sum(v[i][q] ** 2 for i in here) for q in range(f))
            g = learning.sigmoid(w0 + sum(w[i] for i in here) + pairs) - y[k]
            if abs(g) < 1e-3:
                continue
            n0 += g * g
            w0 -= rate * g / math.sqrt(n0)
            for i in here:
                new = n[i] + g * g
                z[i] += g - (math.sqrt(new) - math.sqrt(n[i])) / rate * w[i]
                n[i] = new
                w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / (math.sqrt(new) / rate + l2)
            if at < fm.ALONE:
                continue
            for i in here:
                grad = [g * (sums[q] - v[i][q]) + l2 * v[i][q] for q in range(f)]
                nv[i] = [a + b * b for a, b in zip(nv[i], grad)]
                step = [0.1 / math.sqrt(a) for a in nv[i]]
                moved = [a - s * b for a, s, b in zip(v[i], step, grad)]
                size = math.sqrt(sum(a * a for a in moved)) + 1e-12
                shrink = group if at >= fm.SHRINK_FROM else 0.0
                v[i] = [a * max(0.0, 1 - shrink * sum(step) / f / size) for a in moved]
    return w0, w, v


def test_descent_takes_the_same_steps_as_plain_python():
    rng = np.random.default_rng(4)
    rows = texts(1200, 30, 6, rng)
    y = np.array([float(11 in r or {13, 15} <= set(r.tolist()) or rng.random() < 0.05) for r in rows])
    ids = np.union1d(fm.telling_terms(rows, y), fm.paired_terms(rows, y))
    assert len(ids) >= 2
    model = fm.descend(rows, y)
    w0, w, v = plain_descend(ids.tolist(), [set(r.tolist()) for r in rows], y)
    assert math.isclose(model["w0"], w0, rel_tol=1e-6)
    kept = dict(zip(model["ids"].tolist(), range(len(model["ids"]))))
    for i in ids.tolist():
        mine = (model["w"][kept[i]], model["v"][kept[i]]) if i in kept else (0.0, np.zeros(fm.FACTORS))
        assert np.allclose(mine[0], w[i], atol=1e-6) and np.allclose(mine[1], v[i], atol=1e-6)


def test_sample_bounds_are_parameters(spark):
    docs = spark.createDataFrame([(i, "word " * (10 + i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    texts = [r["t"] for r in learning.labelled_sample(docs, labels, "toxic", 40, sample_bytes=3000, longest_bytes=200).collect()]
    assert 0 < sum(map(len, texts)) <= 3000 and max(map(len, texts)) <= 200
    assert len(fm.classify(docs, labels, sample_bytes=3000, longest_bytes=200).collect()) == 60


def edited(rng, n, words, most):
    """n texts, each with up to ``most`` words of one base replaced."""
    base, out = [f"w{k}" for k in range(words)], []
    for k in range(n):
        mine = list(base)
        for at in rng.choice(words, rng.integers(0, most + 1), replace=False):
            mine[at] = f"x{rng.integers(10**9)}"
        out.append(" ".join(mine).encode())
    return out


def components_and_pairs(spark, monkeypatch, texts):
    """Roots by text, and how many pairs were compared whole."""
    compared, whole = [], nearcopies._alike_pairs
    monkeypatch.setattr(nearcopies, "_alike_pairs", lambda pairs, sets: compared.append(pairs.count()) or whole(pairs, sets))
    sets = [nearcopies.shingles(t) for t in texts]
    nodes = spark.createDataFrame([(k, len(h), nearcopies.bands(h).tolist()) for k, h in enumerate(sets)], "node long, size long, bands array<long>")
    given = spark.createDataFrame(list(enumerate(texts)), "node long, t binary")
    roots = nearcopies.components(shared.stored(nodes), lambda some: given.join(some, "node")).collect()
    by_node = dict(enumerate(range(len(texts)))) | {r["node"]: r["root"] for r in roots}
    return [by_node[k] for k in range(len(texts))], sum(compared)


def least_roots(texts):
    sets, parent = [nearcopies.shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if parent[i] != parent[j] and nearcopies.alike(sets[i], sets[j]):
            a, b = sorted((parent[i], parent[j]))
            parent = [a if p == b else p for p in parent]
    return parent


def test_texts_that_share_much_but_too_little_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 240
    texts = [t for t in edited(rng, 4 * n, 140, 8) if t.count(b"x") > 3][:n]
    texts += [b" ".join([*t.split()[:-6], *(b"%d" % (k % 3) for k in range(6))]) for t in texts[:12]]  # alike to some
    got, pairs = components_and_pairs(spark, monkeypatch, texts)
    assert got == least_roots(texts)
    assert len(set(got)) > n / 2 and pairs < n * n / 8


def test_close_pairs_leave_out_no_alike_pair_whatever_the_sizes(spark, monkeypatch):
    rng = np.random.default_rng(7)
    texts = []
    for words, most in ((6, 2), (30, 4), (60, 6), (140, 9)):
        some = edited(rng, 40, words, most)
        texts += [b" ".join(t.split()[: len(t.split()) - rng.integers(0, words // 4)]) for t in some]
    texts = list(dict.fromkeys(texts))
    got, _ = components_and_pairs(spark, monkeypatch, texts)
    want = least_roots(texts)
    assert got == want and 4 < len(set(want)) < len(texts)
