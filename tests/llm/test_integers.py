"""Clusters, vector codes and pieces against brute force and the library they must agree with."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from barwright.llm import lattice, pieces, shallot, slices

MODEL = P.path("piece_bpe_32k.model")
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({n: F.lit("clash") for n in ("id", "x", "a", "b", "d", "of", "code", "error", "cluster")})


def slow_assign(x, points):
    d = [[int(((np.array(v) - np.array(p)) ** 2).sum()) for p in points] for v in x]
    return [r.index(min(r)) for r in d], [min(r) for r in d]


def floor_mean(rows):
    return [int(sum(c)) // len(rows) for c in zip(*rows)]


def slow_clusters(rows, k, rounds, scale, dim):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept)
    points = [v for _, v in order[:k]]
    for _ in range(rounds):
        a, _ = slow_assign([v for _, v in kept], points)
        points = [floor_mean(mine) if (mine := [v for (_, v), c in zip(kept, a) if c == j]) else p for j, p in enumerate(points)]
    a, d = slow_assign([v for _, v in kept], points)
    by = {j: sum(e for c, e in zip(a, d) if c == j) for j in a}
    said = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted((str(i), c, e, by[c], sum(d), said[c]) for (i, _), c, e in zip(kept, a, d))


ODD = [
    (1, [0.5] * 4, 1), (1, [0.5] * 4, 1), (2, None, 1), (3, [0.1, None, 0.2, 0.3], 2), (4, [NAN, 0.0, 0.0, 0.0], 2),
    (5, [INF, 0.0, 0.0, 0.0], None), (None, [0.25, -0.5, 0.125, 0.0], None), (6, [-0.5] * 4, None), (7, [0.5, 0.5, -0.5, -0.5], 3),
]


@pytest.mark.parametrize("k", [1, 2, 3, 16])
def test_clusters_of_odd_rows(spark, k):
    rows = [*ODD, (8, [1.0, 2.0], 1), (9, [], 1)]
    got = shallot.cluster(vectors(spark, rows), k=k, dim=4).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == slow_clusters(rows, k, 3, 64, 4)


def test_clusters_with_ties_and_groups_of_copies(spark):
    rng = np.random.default_rng(3)
    # few distinct integer vectors: equal distances, equal centroids and empty clusters all occur
    rows = [(i, (rng.integers(-2, 3, 6) / 64).astype(float).tolist(), 0) for i in range(150)]
    rows += [(1000 + i, [1.0] * 6, 0) for i in range(80)]
    got = shallot.cluster(vectors(spark, rows), k=12, rounds=4, dim=6).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == slow_clusters(rows, 12, 4, 64, 6)


def test_no_vector_kept(spark):
    for rows in ([], ODD[2:6]):
        df = shallot.cluster(vectors(spark, rows), dim=4)
        assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not df.collect()
    for rows in ([], ODD[2:6]):
        df = slices.compress(vectors(spark, rows), parts=2)
        assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not df.collect()


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 4), st.sampled_from([2, 30, 10**5]))
def test_search_after_moves_equals_a_full_scan(seed, k, dim, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread + 1, (60, dim))
    points = rng.integers(-spread, spread + 1, (k, dim))
    a, b, da, db = shallot.scan_all(x, shallot.Centroids(points))
    state = a, b, np.sqrt(da), np.where(db < 0, INF, np.sqrt(np.abs(db)))
    for _ in range(4):
        before, points = points, points + rng.integers(-2, 3, points.shape) * rng.integers(0, 2, (k, 1))
        now = shallot.Centroids(points, before)
        state, _ = shallot.search(x, now, *state)
        assert (state[0] == shallot.scan_all(x, now)[0]).all()
        true = np.sqrt(lattice.squares(x, points[state[0]]))
        assert (state[2] >= true - 1e-6).all()
        for j in range(k):
            assert (np.where(state[0] == j, INF, np.sqrt(lattice.squares(x, points[j]))) >= state[3] - 1e-6).all()


def test_search_spares_distances_on_clusters():
    rng = np.random.default_rng(5)
    middle = rng.integers(-1000, 1000, (16, 8))
    x = middle[rng.integers(0, 16, 4000)] + rng.integers(-40, 41, (4000, 8))
    first = shallot.Centroids(middle)
    a, b, da, db = shallot.scan_all(x, first)
    now = shallot.Centroids(middle + rng.integers(-5, 6, middle.shape), middle)
    _, taken = shallot.search(x, now, a, b, np.sqrt(da), np.sqrt(db))
    assert taken < 0.2 * len(x) * 16


def test_vectors_too_large_for_a_long_raise(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        shallot.cluster(vectors(spark, [(1, [3e38] * 4, 1), (2, [0.0] * 4, 1)]), dim=4).collect()


def slow_codes(rows, parts, entries, rounds, scale):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v], y) for i, v, y in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    for r in range(rounds + 1):
        found = [slow_assign([cut(v, p) for _, v, _ in kept], books[p]) for p in range(parts)]
        if r < rounds:
            books = [
                [floor_mean(mine) if (mine := [cut(v, p) for (_, v, _), c in zip(kept, found[p][0]) if c == e]) else old for e, old in enumerate(books[p])]
                for p in range(parts)
            ]
    said = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(found[p][1][k] for p in range(parts)) for k in range(len(kept))]
    by = {y: sum(e for (_, _, z), e in zip(kept, error) if z == y) for _, _, y in kept}
    return sorted((str(i), "".join(f"{found[p][0][k]:02x}" for p in range(parts)), error[k], by[y], said) for k, (i, _, y) in enumerate(kept))


def test_codes_of_odd_rows(spark):
    got = slices.compress(vectors(spark, ODD), parts=2, scale=16).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == slow_codes(ODD, 2, 16, 6, 16)


def test_codes_with_ties_and_more_than_a_word_of_entries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-4, 5, 6) / 16).tolist(), None if i % 3 else 7) for i in range(200)] + [(900 + i, [1.0] * 6, 7) for i in range(70)]
    for entries in (5, 90):
        got = slices.compress(vectors(spark, rows), parts=3, entries=entries, rounds=3, scale=16).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == slow_codes(rows, 3, entries, 3, 16)


def test_vectors_of_other_lengths_raise(spark):
    for rows in ([(1, [1.0] * 4, 1), (2, [1.0] * 6, 1)], [(1, [1.0] * 5, 1)]):
        with pytest.raises(ValueError):
            slices.compress(vectors(spark, rows), parts=2)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 130), st.integers(1, 5), st.sampled_from([1, 5, 10**6]))
def test_masks_hold_every_nearest_entry(seed, entries, width, spread):
    rng = np.random.default_rng(seed)
    book = slices.Book(rng.integers(-spread, spread + 1, (entries, width)))
    y = rng.integers(-spread, spread + 1, (40, width))
    code, d = book.nearest(y)
    all_ = np.stack([lattice.squares(y, e) for e in book.entries], axis=1)
    assert (code == all_.argmin(axis=1)).all() and (d == all_.min(axis=1)).all()
    mask = book.candidates(y)
    within = np.stack([mask[:, e // 64] >> np.uint64(e % 64) & np.uint64(1) for e in range(entries)], axis=1)
    assert (within[all_ == all_.min(axis=1, keepdims=True)] == 1).all()


def test_masks_leave_few_entries():
    rng = np.random.default_rng(6)
    book = slices.Book(rng.integers(-1000, 1000, (64, 8)))
    mask = book.candidates(book.entries[rng.integers(0, 64, 500)] + rng.integers(-50, 51, (500, 8)))
    assert np.bitwise_count(mask).sum() < 0.2 * 500 * 64


def test_codes_stand_for_vectors():
    rng = np.random.default_rng(7)
    books = rng.integers(-50, 50, (2, 9, 3))
    codes = rng.integers(0, 9, (30, 2))
    x = slices.decode(codes, books)
    back, error = slices.encode(x, [slices.Book(b) for b in books])
    assert (slices.decode(back, books) == x).all() and not error.any()


def models():
    data = open(MODEL, "rb").read()
    rules = ("nmt_nfkc", "nfkc", "nmt_nfkc_cf")
    # a second normaliser's fields take the first one's places
    return [("plain", data)] + [(r, data + sentencepiece.SentencePieceNormalizer(rule_name=r).serialized_model_proto()) for r in rules]


def piece_texts():
    rng = random.Random(1)
    chars = "ab e\n\t é日▁本\U0001f600  .,<0x0A><s>ﬁ① 　ｶﾞ́"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(3000)]
    tokens = [p for p in pieces.Model.load(MODEL).texts if not p.startswith("<")]
    texts += ["".join(rng.choice(tokens) for _ in range(rng.randrange(1, 12))).replace("▁", " ") for _ in range(3000)]
    return texts + ["lorem ipsum " * 3000 + "x" * 20000, "", " ", "  ", "\n", "▁", " a  b "]


@pytest.mark.parametrize("name, data", models())
def test_pieces_are_the_librarys(name, data):
    lib, mine = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Encoder(pieces.Model(data))
    texts = piece_texts()
    for t, p in zip(texts, lib.encode(texts, return_type="proto")):
        ids, bounds = mine.encode(t)
        assert ids.tolist() == [x.id for x in p.pieces], t
        assert mine.model.decode(ids.tolist()) == lib.decode(ids.tolist())
        assert [(x.begin, x.end) for x in p.pieces] == list(zip(bounds.tolist(), bounds[1:].tolist())), t
    assert (mine.model.normalizer("ﬁ①")[0] == "▁fi1") == (name != "plain")


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_pieces_of_any_text(text):
    lib, mine = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.encoder(MODEL)
    ids, bounds = mine.encode(text)
    assert ids.tolist() == lib.encode(text) and mine.model.decode(ids.tolist()) == lib.decode(ids.tolist())
    assert bounds[0] == 0 and bounds[-1] == len(text.encode()) and (np.diff(bounds) >= 0).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    lib, mine = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.encoder(MODEL)
    assert mine.model.decode(ids) == lib.decode(ids)


def test_words_cut_apart_are_encoded_like_the_whole():
    model = pieces.Model.load(MODEL)
    assert model.by_word
    rng = random.Random(2)
    for _ in range(500):
        s = "▁" + "".join(rng.choice("abtheins.,!-0▁'é") for _ in range(60))
        assert model._merge_long(s) == model._merge_short(s)


def test_models_that_are_no_bpe_raise():
    with pytest.raises(ValueError):
        pieces.Model(open(MODEL, "rb").read() + b"\x12\x02\x18\x01")


def test_pieces_of_odd_rows(spark):
    long = "lorem ipsum " * 30_000 + "x" * 50_000
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "a b"), (4, long), (5, " é\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("id", "t", "ids", "n_tokens")})
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {(r[0], len(r[1])): r for r in pieces.encode(df, MODEL).collect()}
    assert len(got) == 6  # the first two rows are alike
    for i, t in rows:
        ids = lib.encode(t or "")
        r = got[i, len(ids)]
        assert r["ids"] == ids and r["decoded"] == lib.decode(ids) and r["bounds"][-1] == len((t or "").encode())
    said = pieces.digests(df, MODEL)
    assert said.count() == 7 and said.where("doc_id = 3").first()["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    bad = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text")
    assert pieces.encode(bad, MODEL).first()["decoded"] == "a�b"
    assert not pieces.encode(df.limit(0), MODEL).collect()


def test_query_is_the_librarys_on_documents(spark):
    from barwright.llm import queries

    sf = "/root/testdata/sf0.001"
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {}
    for r in pq.read_table(f"{sf}/documents.parquet").to_pylist():
        ids = lib.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_sentence_pieces(spark, sf).collect()}
    assert got == want
