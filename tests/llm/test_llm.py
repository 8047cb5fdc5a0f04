"""The training-data operators on small tables: brute force, round trips, held-out accuracy, odd input."""

import base64
import collections
import glob
import hashlib
import json
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barwright.llm import bpe, capfilter, chat, fm, learning, nbsvm, nearcopies, packing, queries, shardtree, shared, simhash, topk, warc

SF = "/root/testdata/sf0.001"
BPE, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
LONG = "lorem ipsum " * 30_000 + "x" * 50_000
#: Repeated rows, nulls, empty and long texts; columns that share names with the operators' own.
ODD = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (None, "a b c d"), (None, None), (4, LONG), (5, "A b\tC d"), (6, " \n ")]


@pytest.fixture(scope="module")
def odd(spark):
    names = ("id", "fp", "t", "score", "row", "label", "shard", "piece", "root", "_kept", "_id", "n", "y")
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(ids, near):
    """ids: list; near(i, j): whether positions link. The least id (nulls last) reachable from each."""
    todo, comp = set(range(len(ids))), {}
    while todo:
        stack, group = [todo.pop()], []
        while stack:
            i = stack.pop()
            group.append(i)
            for j in [j for j in todo if near(i, j)]:
                todo.discard(j)
                stack.append(j)
        known = [ids[i] for i in group if ids[i] is not None]
        comp.update({i: min(known) if known else None for i in group})
    return comp


def test_simhash_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    fps = [slow_fingerprint(t) for _, t in ODD]
    comp = least_reachable([i for i, _ in ODD], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    want = sorted((str(i), f"{fps[k]:016x}", str(comp[k])) for k, (i, _) in enumerate(ODD))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_simhash_links_are_all_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    codes = set(base)
    for c in base[:15]:
        for _ in range(30):
            codes.add(c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    codes = sorted(codes)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in shared.components(simhash.link(df)).collect()}
    comp = least_reachable(codes, lambda i, j: (codes[i] ^ codes[j]).bit_count() <= 2)
    for i in range(len(codes)):
        for j in range(i):
            same = roots.get(codes[i], codes[i]) == roots.get(codes[j], codes[j])
            assert same == (comp[i] == comp[j])


def test_gray_rank_orders_the_reflected_code():
    codes = np.array([i ^ i >> 1 for i in range(1000)], dtype=np.uint64)
    assert (simhash.gray_rank(codes) == np.arange(1000)).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (12, 11), (3, 9)] + [(100, i) for i in range(101, 160)]
    got = {r["node"]: r["root"] for r in shared.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 12: 10, **{i: 100 for i in range(100, 160)}}


def test_bpe_is_tiktoken(spark, odd):
    v = bpe.Vocabulary.load(BPE)
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    e = bpe.Encoder(v, P.PATTERN)
    rng, tokens = random.Random(2), list(v.ranks)
    texts = [b"".join(rng.choice(tokens) for _ in range(5)).decode("utf-8", "ignore") for _ in range(3000)]
    texts += ["".join(rng.choice("ab \n\t'sé 12中🙂") for _ in range(30)) for _ in range(1000)] + ["", "  ", LONG]
    assert all(e.encode(x).tolist() == t.encode_ordinary(x) for x in texts)
    got = bpe.digests(odd, BPE, P.PATTERN).collect()
    want = []
    for i, x in ODD:
        ids = t.encode_ordinary(x or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    back = bpe.encode(odd, BPE, P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in back) == sorted(x or "" for _, x in ODD)


def test_bpe_appends_and_edits():
    v, rng = bpe.Vocabulary.load(BPE), random.Random(3)
    word = lambda n: bytes(rng.choice(b"abcthe ing") for _ in range(rng.randrange(n)))
    for _ in range(200):
        a, b = word(400), word(40)
        table = bpe.PrefixTable(v, a)
        table.append(b)
        assert table.encoding() == bpe.PrefixTable(v, a + b).encoding()
        i = rng.randrange(len(a) + 1)
        j = min(len(a), i + rng.randrange(5))
        table = bpe.PrefixTable(v, a)
        anew = table.replace(i, j, b)
        assert table.last == bpe.PrefixTable(v, a[:i] + b + a[j:]).last
        assert anew <= len(table.piece) - i


def slow_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_packing_plan():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([5, 10, 60])
        h = {n: rng.randrange(1, 20) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 10)))}
        used, count = collections.defaultdict(list), collections.Counter()
        for n, _, k, first, at in packing.plan(h, capacity):
            count[n] += k
            for s in range(first, first + k):
                used[s].append((at, n))
        assert count == h
        for parts in used.values():
            end = 0
            for at, n in sorted(parts):
                assert at == end
                end += n
            assert end <= capacity
        assert len(used) <= slow_best_fit([n for n, k in h.items() for _ in range(k)], capacity)


def test_packing_rows(odd, none):
    t = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for i, x in ODD:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k in range(0, len(ids), 256):
            cut = ids[k : k + 256]
            want[str(i), k // 256, k, len(cut), zlib.crc32(cut.tobytes())] += 1
    got = packing.pack(odd, WORDS, 256).collect()
    assert collections.Counter((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 256
    assert packing.pack(none, WORDS, 256).count() == 0


def test_word_tokenizer_goes_word_by_word():
    w, rng = packing.WordTokenizer(WORDS), random.Random(5)
    parts = ["ab", "ΑΣ", "ΑΣ.", "THE!!", "é", "é", " ", "\n", "\x1c", " ", "'s", "12", "<|endoftext|>", "İ", "🙂", "́", "ß."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(1500)]
    got = w.encode(texts)
    assert all(np.frombuffer(g, "<u4").tolist() == w.tokenizer.encode(x, add_special_tokens=False).ids for g, x in zip(got, texts))


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A file that keeps case, or that prefixes spaces, doesn't go word by word."""
    settings = json.load(open(WORDS))
    assert packing.goes_by_word(settings)
    settings["normalizer"]["normalizers"] = settings["normalizer"]["normalizers"][:2]
    cased = tmp_path / "cased.json"
    cased.write_text(json.dumps(settings))
    w = packing.WordTokenizer(str(cased))
    assert not w.by_word
    texts = ["Some Words, here.", "", "AB ab", LONG[:1000]]
    want = [w.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in w.encode(texts)] == want


def labelled(spark, n=600):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("the of and stone river cloud walk green".split()) for _ in range(rng.randrange(20, 60))]
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words]
        if rude:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(rude)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("model, label", [(nbsvm, "quality"), (fm, "toxic")])
def test_classifiers_on_held_out(spark, model, label, odd, none):
    docs, labels = labelled(spark)
    got = model.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    unseen = [r for r in got if r["held_out"]]
    assert len(unseen) > 50 and np.mean([r["predicted"] == r[label] for r in unseen]) > 0.95
    assert model.classify(odd, labels).count() == len(ODD)
    assert model.classify(none, labels).count() == 0
    bare = {r["score"] for r in model.classify(odd, labels.limit(0)).collect()}
    assert bare == {1.0 if model is nbsvm else 0.0}


def test_held_out_labels_change_nothing(spark):
    docs, labels = labelled(spark, 200)
    turned = labels.withColumn("quality", F.when(shared.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in nbsvm.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_nbsvm_sees_all_of_a_long_word():
    word = "a" * 200 + "1=&%" * 12_000
    assert nbsvm._word(word) >> 32 != nbsvm._word("a" * 200) >> 32
    assert set(nbsvm.features(word)) != set(nbsvm.features("a" * 200))
    shapes = {nbsvm._word("a" * 200 + end) >> 32 for end in ("", "1", "_", "!!", "a?")}
    assert len(shapes) == 5


def test_pairs_without_marginals_are_learnt():
    """Texts are toxic where two words stand both or neither: each word alone says nothing."""
    rng, rows, y = random.Random(1), [], []
    for _ in range(4000):
        words = [w for w in "the of and stone river cloud walk green ash bend cart dune elm fog gate hill".split() if rng.random() < 0.4]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(fm.features(" ".join([*words, *["alpha"] * a, *["beta"] * b])))
        y.append(float(a == b))
    y = np.array(y)
    model = fm.descend(rows[:3000], y[:3000])
    at = [np.flatnonzero(np.isin(model["ids"], r, assume_unique=True)) for r in rows[3000:]]
    assert np.mean([(fm.margin(model, k) > 0) == z for k, z in zip(at, y[3000:])]) > 0.99
    linear = {**model, "v": np.zeros_like(model["v"])}
    assert np.mean([(fm.margin(linear, k) > 0) == z for k, z in zip(at, y[3000:])]) < 0.8
    assert not len(fm.telling_terms(rows[:3000], y[:3000])) and set(fm.terms("alpha")) <= set(fm.paired_terms(rows[:3000], y[:3000]))


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    w, v = rng.normal(size=7), rng.normal(size=(7, 4))
    pairs = sum(v[i] @ v[j] for i in range(7) for j in range(i))
    assert abs(fm._margin(0.3, w, v) - (0.3 + w.sum() + pairs)) < 1e-9


def test_dual_descent_closes_the_gap():
    """The weights' primal loss meets the dual's bound, so they are the minimum of the hinge loss."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(200)]
    y = np.array([int((r < 15).sum() > (r >= 25).sum()) for r in rows])
    ratio, c = nbsvm.log_count_ratios(rows, y, 40), 0.1
    w = nbsvm.dual_descent(rows, y, ratio, c, rounds=2000)
    x = np.zeros((200, 40))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r]
    u = np.divide(w, ratio, out=np.zeros(40), where=ratio != 0)  # weights of the scaled indicators
    sign = np.where(y == 1, 1.0, -1.0)
    loss = lambda u: 0.5 * u @ u + c * np.maximum(0, 1 - sign * (x @ u)).sum()
    slow = np.zeros(40)
    best = np.inf
    for t in range(1, 20_000):  # plain subgradient steps
        slow -= (slow - c * ((sign * (x @ slow) < 1) * sign) @ x) / (1 + t)
        best = min(best, loss(slow))
    assert loss(u) <= best * 1.001  # the descent stops at violations below 0.01


def test_sample_is_bounded_by_bytes(spark, monkeypatch):
    docs, labels = labelled(spark, 200)
    docs = docs.unionByName(spark.createDataFrame([(500, "x" * 5000)], docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(500, 1, 0)], labels.schema))
    monkeypatch.setattr(learning, "SAMPLE_BYTES", 10_000)
    monkeypatch.setattr(learning, "LONGEST_BYTES", 4000)
    texts = [r["t"] for r in learning.labelled_sample(docs, labels, "quality").collect()]
    assert 0 < sum(map(len, texts)) <= 10_000 and max(map(len, texts)) <= 4000


def slow_top_k(rows, k=5, every=50):
    """Per asking row (id, vector): its best by all products."""
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    w = max(len(v) for _, v in good)
    ids, x = np.array([i for i, _ in good]), np.array([np.pad(v, (0, w - len(v))) for _, v in good])
    out, seen = [], set()
    for at in np.flatnonzero(ids % every == 0):
        if (ids[at], x[at].tobytes()) in seen:
            continue
        seen.add((ids[at], x[at].tobytes()))
        s = x @ x[at]
        s[ids == ids[at]] = -np.inf
        best = [j for j in np.lexsort((ids, -s))[:k] if s[j] > -np.inf]
        out += [(int(ids[at]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(best)]
    return sorted(out)


def floats(rows):
    return [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]


def test_topk_is_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 16))
    x[200:260] = x[0] + rng.normal(size=(60, 16)) * 0.01
    rows = floats(enumerate(x)) + floats([(50, x[3]), (50, x[3]), (7, x[7]), (900, None), (901, [None] * 16), (902, [float("nan")] * 16), (None, [1.0] * 16), (950, [3.0, 4.0]), (2**63 - 1, x[0])])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = df.withColumns({n: F.lit("clash") for n in ("id", "x", "row", "cell", "block", "grp", "low", "home", "score")})
    for vectors, parts in ((df, {}), (clash, {"pivots": 7, "data_block": 50, "query_group": 3})):
        got = sorted(map(tuple, topk.top_k(vectors, **parts).collect()))
        assert got == slow_top_k(rows)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 1")).count() == 0
    few = rows[:3]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(few, df.schema)).collect())) == slow_top_k(few)


def test_topk_leaves_out_blocks_of_far_clusters(spark):
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(24, 16)) * 20
    rows = floats(enumerate(centres[k % 24] + rng.normal(size=16) * 0.05 for k in range(3000)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    layout = topk.Layout(topk.usable_rows(df, 256, "vec_id", "embedding"), 50, 24 * 4, 60, 10)
    assert sorted(map(tuple, topk.top_k(df, pivots=24 * 4, data_block=60, query_group=10).collect())) == slow_top_k(rows)
    truth = collections.defaultdict(list)
    for i, _, _, s in slow_top_k(rows):
        truth[i].append(s)
    low = spark.createDataFrame([(i, float(min(s))) for i, s in truth.items()], "id long, low double")
    lows = layout.asked.join(low, "id").groupBy("grp").agg(F.min("low").alias("low"))
    met, every = topk.block_pairs(layout, lows).count(), layout.groups.count() * layout.blocks.count()
    assert every > 500 and met < 0.3 * every


def test_cover_tree_children_lie_within_half():
    rng = np.random.default_rng(18)
    x = np.concatenate([c + rng.normal(size=(200, 4)) * 0.1 for c in rng.normal(size=(20, 4)) * 5])
    tree = topk.CoverTree(x, leaf=16)
    assert len(tree.radius) > 20
    for k, children in enumerate(tree.children):
        assert np.linalg.norm(x[tree.points[k]] - tree.centre[k], axis=1).max() <= tree.radius[k] + 1e-9
        assert all(tree.radius[c] <= tree.radius[k] / 2 + 1e-9 for c in children)
        if children:
            assert sorted(np.concatenate([tree.points[c] for c in children])) == sorted(tree.points[k])


def test_cap_filters_are_all_pairs(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 24))
    x[100:250] = x[0] + rng.normal(size=(150, 24)) * 0.12
    x[300] = x[299]
    rows = [(i, [float(v) for v in r], i % 2 if i >= 250 else 1) for i, r in enumerate(x)]
    rows += [(600, None, 1), (601, [0.0] * 24, 1), (602, [float("nan")] * 24, 1), (603, rows[0][1], None), (604, [None] * 24, 1), (0, rows[0][1], 1), (605, [1.0, 2.0], 1)]
    got = sorted(tuple(r) for r in capfilter.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    ok = [v is not None and l is not None and len(v) == 24 and v[0] is not None and v[0] == v[0] and any(v) for _, v, l in rows]
    u = {k: np.array(v) / np.linalg.norm(v) for k, (_, v, _) in enumerate(rows) if ok[k]}
    near = lambda i, j: i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and u[i] @ u[j] >= 0.98
    n = [sum(near(i, j) for j in range(len(rows))) for i in range(len(rows))]
    comp = least_reachable([r[0] for r in rows], near)
    assert got == sorted((r[0], n[k], comp[k], r[0] == comp[k]) for k, r in enumerate(rows))
    assert sum(n) > 1000
    kinds = "vec_id long, embedding array<double>, label int"
    assert capfilter.near_duplicates(spark.createDataFrame([], kinds)).count() == 0
    clash = spark.createDataFrame(rows[:60], kinds).withColumns({c: F.lit("clash") for c in ("id", "x", "row", "m", "h1", "key", "root", "n", "other")})
    assert {r["n_links"] for r in capfilter.near_duplicates(clash).collect()} == {0}
    copies = [(i, rows[0][1], 1) for i in range(5000)] + [(None, rows[0][1], 1), (9000, rows[1][1], 1)]
    got = capfilter.near_duplicates(spark.createDataFrame(copies, kinds)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got if r["vec_id"] != 9000} == {(5000, 0)} and sum(r["kept"] for r in got) == 2


@pytest.mark.parametrize("dim, n", [(6, 3000), (24, 1200), (96, 4000)])
def test_cap_filters_recall(spark, dim, n):
    """All links by exact filters, and (but for one in a thousand) by those of SIGMAS deviations."""
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(n // 4, dim))
    x = np.concatenate([base, *(base + rng.normal(size=base.shape) * s for s in (0.1, 0.14, 0.2))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.98
    want = close.sum(axis=1) - 1
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    for sigmas, least in ((float("inf"), 1.0), (capfilter.SIGMAS, 0.999)):
        got = {r["vec_id"]: r["n_links"] for r in capfilter.near_duplicates(df, sigmas=sigmas).collect()}
        assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= least * want.sum() > 0


def test_codewords_grow_smoothly():
    filters = [np.prod(capfilter.codewords(n)) / n for n in range(1000, 200_000, 500)]
    assert max(filters) / min(filters) < 1.35


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "[\\\\/INST]", "", None, "a\nb", "\\", "<<s>>", "[INST][INST]", "中🙂</s>"]
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "</s>"]), rng.choice(hard)) for c in range(30) for t in range(rng.randrange(1, 12))]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (0, 0, "user", "tie"), (31, 0, "user", LONG + "</s>"), (31, 1, "assistant", "[INST]" + LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2] is not None, r[2] or ""))
        every = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in turns)
        said = "".join(text or "" for _, role, text in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(said))
        assert r["formatted_chars"] == len(chat.render([(role or "", text or "") for _, role, text in turns])[0])
        assert r["turns_sha256"] == hashlib.sha256(every.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_reply_trees_rank_branches(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.5), ("t", 4, 3, "user", "why", 0.0),
            ("t", 5, 4, "assistant", "so", 0.2), ("t", 6, 4, "assistant", "thus", 0.9), ("x", 1, 99, "user", "orphan", 0.0), ("c", 1, 2, "user", "loop", 0.0), ("c", 2, 1, "user", "loop", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = chat.format_trees(df, top=2).orderBy("tree", "rank").collect()
    said = [(r["tree"], r["rank"], [t for _, t in chat.parse(r["formatted"])]) for r in got]
    assert said == [("t", 1, ["q", "good", "why", "thus"]), ("t", 2, ["q", "good", "why", "so"]), ("x", 1, ["orphan"])]
    first = got[0]
    assert [first["formatted"][s["start"] : s["end"]] for s in first["loss_spans"]] == ["good", "thus"]


def test_warc(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/ü ", "same"), (3, None, ""), (4, "u", None), (5, "u\r\nX: y", "other"), (5, "u", "other"), (None, "v", "same"), (None, "w", "lone"), (6, "u", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(0))
    got = warc.archive_and_read(df).collect()
    most = {}
    for i, _, h in rows:
        if i is not None:
            most[h or ""] = max(most.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = most.get(h or "")
        again = first is not None and i != first
        want.append((str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert sorted(((str(r[0]), *r[1:]) for r in got), key=str) == sorted(want, key=str)
    assert warc.archive_and_read(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "u", "the same page " * 9) for i in range(500)], "page_id long, url string, html string")
    first = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_and_read(copies).collect()}
    assert first == {(499, "response", None), *((i, "revisit", 499) for i in range(499))}
    few = {(r["page_id"], r["record_type"]) for r in warc.archive_and_read(df, min_bytes=5).collect()}
    assert (1, "response") in few and (3, "response") in few


def test_warc_reads_selected_records(spark):
    df = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 50) for i in range(300)], "page_id long, url string, html string")
    base = shared.scratch_dir(spark)
    base = base if "://" in base else f"file://{base}"
    index = warc.write(warc.plan_records(df), base)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(index.where("page_id % 7 = 0"), base).collect()}
    assert got == {i: f"page {i} " * 50 for i in range(0, 300, 7)}


def test_shards(spark, odd, none):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text")).repartition(3)
    got = shardtree.assign(docs).collect()
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    sizes = collections.Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.25 * min(sizes.values())
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got) and 300 < sum(r["grown_shard"] == 8 for r in got) < 600
    for n in (3, 5, 8):  # one more shard takes rows only into itself, wherever it stands in the tree
        a, b = ({r["doc_id"]: r["shard"] for r in shardtree.assign(docs, shards=k).collect()} for k in (n, n + 1))
        assert all(b[i] in (a[i], n) for i in a)
    rows = shardtree.assign(odd).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in ODD)
    assert shardtree.assign(none).count() == 0


def slow_shard(doc_id, tree):
    """Every leaf's time by plain code: its ancestors' times plus what its own draw exceeds its siblings' least by."""
    def draw(path):
        below = [x for x in tree if (x.region, x.rack, x.shard)[: len(path)] == path]
        seed = xxhash.xxh64_intdigest("/".join(map(str, path)).encode(), 42)
        h = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), seed)
        return -math.log(((h >> 11) + 0.5) / 2.0**53) / sum(x.weight for x in below)

    times = {}
    for x in tree:
        path, time = (x.region, x.rack, x.shard), draw((x.region,))
        for k in (2, 3):
            siblings = {(y.region, y.rack, y.shard)[:k] for y in tree if (y.region, y.rack, y.shard)[: k - 1] == path[: k - 1]}
            time += draw(path[:k]) - min(map(draw, siblings))
        if not x.reserved:
            times[x.shard] = time
    return min(times, key=times.get)


def test_shards_are_the_least_times(spark):
    docs = spark.range(300).select((F.col("id") * 7919 - 500_000).alias("doc_id"), F.lit("x").alias("text")).withColumn("shard", F.lit("clash"))
    odd_tree = [shardtree.Leaf(0, 0, 5, 2.0), shardtree.Leaf(0, 0, 9, 0.5), shardtree.Leaf(0, 1, 2, 1.0, True), shardtree.Leaf(3, 4, 7, 3.0)]
    for tree in (*(shardtree.even_tree(n) for n in (1, 2, 3, 7, 8, 9)), shardtree.even_tree(11, 3, 2), odd_tree):
        grown, new = shardtree.with_one_more(tree)
        for r in shardtree.assign(docs, tree=tree).collect():
            assert r["shard"] == slow_shard(r["doc_id"], tree) and r["grown_shard"] == slow_shard(r["doc_id"], grown)
            assert r["grown_shard"] in (r["shard"], new)


def test_shard_movement_stays_in_the_changed_subtree(spark):
    tree = shardtree.even_tree(8)
    heavier = [*tree[:5], shardtree.Leaf(1, 2, 5, 3.0), *tree[6:]]
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    a, b = ({r["doc_id"]: r["shard"] for r in shardtree.assign(docs, tree=t).collect()} for t in (tree, heavier))
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    assert moved and all(y in (4, 5, 6, 7) for _, y in moved)  # into the region whose weight grew
    assert all(y in (4, 5) for x, y in moved if x in (4, 5, 6, 7)) and all(y == 5 for x, y in moved if x == 4)
    n = collections.Counter(b.values())
    assert abs(n[5] - 1800) < 200 and all(abs(n[s] - 600) < 120 for s in range(8) if s != 5)


def test_shard_weights(spark):
    tree = [shardtree.Leaf(0, 0, 0, 1.0), shardtree.Leaf(0, 1, 1, 3.0), shardtree.Leaf(1, 2, 2, 4.0)]
    heavier = [*tree[:2], shardtree.Leaf(1, 2, 2, 8.0)]
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    a, b = ({r["doc_id"]: r["shard"] for r in shardtree.assign(docs, tree=t).collect()} for t in (tree, heavier))
    n = collections.Counter(a.values())
    assert abs(n[0] - 1000) < 150 and abs(n[1] - 3000) < 250
    assert all(b[i] in (a[i], 2) for i in a)


def test_pipeline_stages(spark):
    docs = shared.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = shared.stored(stage(spark, docs, SF))
        assert kept.columns == columns and kept.exceptAll(docs).count() == 0 and 0 < kept.count() <= docs.count()
        if name == "near_dedup":  # by all pairs: two bits of fingerprint, or 0.8 of five-word shingles
            rows = docs.select("doc_id", "text").collect()
            fps, sets = [slow_fingerprint(r["text"]) for r in rows], word_sets(r["text"] for r in rows)
            near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2 or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            comp = least_reachable([r["doc_id"] for r in rows], near)
            assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp.values()))
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in docs.collect()}


def test_keep_one_goes_by_id_and_text(spark):
    copies = " ".join(f"word{k}" for k in range(40))
    rows = [(1, "alpha beta gamma delta", 1), (1, "completely other words here", 1), (2, copies, 5), (3, copies, 6), (2, copies, 4), (2, copies, 5), (None, copies, 7), (None, "lone text", 8), (None, None, 9), (7, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("k", F.lit("clash")).withColumn("h1", F.create_map(F.lit(1), F.lit(2)))
    for similar in (False, True):
        got = simhash.keep_one(df, similar=similar)
        assert got.columns == df.columns
        kept = got.select("doc_id", "text").collect()
        assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, "alpha beta gamma delta"), (1, "completely other words here"), (2, copies), (None, "lone text"), (7, "")]))
        assert simhash.keep_one(df.limit(0), similar=similar).count() == 0


def word_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return out


def test_near_copies_are_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(1, 25)):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"v{rng.randrange(5000)}"
            rows.append((len(rows) if rng.random() < 0.9 else None, " ".join(words)))
    rows += [(3, "another text under a known id"), (None, None), (900, ""), (None, "a b"), (None, "a  B"), *rows[:5]]
    sets = word_sets(t for _, t in rows)
    comp = least_reachable(list(range(len(rows))), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), similar=True).collect()
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(comp[k], []).append((i is None, i))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((a, b or 0) for a, b in map(min, ([(n, i or 0) for n, i in g] for g in groups.values())))


def test_counts_leave_out_no_alike_pair(spark):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join([*base[: 400 - cut], *(f"x{rng.randrange(10**6)}" for _ in range(cut))]) for cut in range(0, 200, 4)]
    texts += [" ".join(base[:n]) for n in (1, 4, 5, 6, 320, 321)] + [""]
    sets = shared.stored(nearcopies.held_sets(spark.createDataFrame(list(enumerate(t.encode() for t in texts)), "node long, t binary")))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    whole = [nearcopies.shingles(t.encode()) for t in texts]
    got = nearcopies._alike_pairs(spark.createDataFrame(pairs, "u long, v long"), sets).collect()
    assert sorted(map(tuple, got)) == sorted(p for p in pairs if nearcopies.alike(whole[p[0]], whole[p[1]]))
    assert 0 < len(got) < len(pairs)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df, got = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    order = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(order)
    assert sorted(map(str, map(tuple, df.select(*order).collect()))) == sorted(map(str, got.fetchall()))


def test_pipeline_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() > 0
        assert stage(spark, odd.limit(0), SF).count() == 0
