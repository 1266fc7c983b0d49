"""Deduplication against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import common as c
from quarry.llm import components, embeddings, phrases, simhash, suffix_repeats


def raw(corpus):
    return [(r[0], (r[1] or "").encode()) for r in corpus]


@pytest.mark.parametrize("long", [4096, 7])
def test_phrases(spark, docs, corpus, monkeypatch, long):
    monkeypatch.setattr(phrases, "LONG", long)
    out = phrases.remove_repeats(docs)
    assert "block" in out.columns and out.where("block <> 'mine'").count() == 0
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect())
    split = [(i, t.split()) for i, t in raw(corpus)]
    seen = Counter(tuple(w[i : i + 35]) for _, w in split for i in range(len(w) - 34))
    want = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                gone[j : j + 35] = [True] * 35
        want[(i, len(w), sum(gone), b" ".join(a for a, g in zip(w, gone, strict=True) if not g).decode())] += 1
    assert got == want and sum(k[2] for k in want) > 1000


def test_phrase_shards(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_CHARS", 5)
    marks = phrases.covered_words([" a b c d ", " x b c "], [" a b ", " b c ", " d "])
    assert [m.tolist() for m in marks] == [[[0, 2], [1, 3], [3, 4]], [[1, 3]]] or sorted(map(tuple, marks[0].tolist())) == [(0, 2), (1, 3), (3, 4)]


def repeats_by_brute_force(items, size):
    first = {}
    for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0)):
        for j in range(len(t) - size + 1):
            first.setdefault(t[j : j + size], i)
    out = Counter()
    for i, t in items:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - size + 1):
            low = first[t[j : j + size]]
            if low is not None and (i is None or low < i):
                gone[j : j + size] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        out[(i, len(t), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [256, 0])
def test_suffix_repeats(docs, corpus, hot):
    out = suffix_repeats.remove_repeats(docs, hot_blocks=hot).withColumn("h", F.sha2("kept", 256))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.h) for r in out.collect())
    assert got == repeats_by_brute_force(raw(corpus), 50)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=40).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=1, max_size=6))
def test_maximal_repeats(segments):
    """All occurrences of each string that can't be longer on either side."""
    got = {(n, tuple(sorted(w))) for n, w in suffix_repeats.maximal_repeats(segments, 4)}
    places = {}
    for i, s in enumerate(segments):
        for j in range(len(s)):
            for k in range(j + 4, len(s) + 1):
                places.setdefault(s[j:k], []).append((i, j))
    want = set()
    for s, w in places.items():
        if len(w) < 2:
            continue
        after = [segments[i][j + len(s)] if j + len(s) < len(segments[i]) else -1 - n for n, (i, j) in enumerate(w)]
        before = [segments[i][j - 1] if j else -1 - n for n, (i, j) in enumerate(w)]
        if len(set(after)) > 1 and len(set(before)) > 1:
            want.add((len(s), tuple(sorted(w))))
    assert got == want


def test_simhash(docs, corpus):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = []
    for _, t in raw(corpus):
        w = bytes(x + 32 if 65 <= x <= 90 else x for x in t).split()
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    up = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    up[i] = up[j] = min(up[i], up[j])
    least = {}
    for k, (i, _) in enumerate(raw(corpus)):
        if i is not None:
            least[up[k]] = min(least.get(up[k], i), i)
    want = Counter((i, f"{p:016x}", least.get(up[k])) for k, ((i, _), p) in enumerate(zip(raw(corpus), prints, strict=True)))
    assert got == want


def test_close_pairs():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([centre, *[centre ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 6)]]))
    got = {tuple(sorted(p)) for i, j in simhash.close_pairs(x, 2) for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 2}
    assert got == want and len(want) > 100


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(9) == 1 and 1 in ids and 2 not in ids and ids.count(None) == 2


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 7, 8, 9), 1), 20: 20, 21: 20}
    assert components.components(edges.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((5, 16))
    vectors = [v + 0.02 * rng.standard_normal(16) for v in centre for _ in range(40)] + list(rng.standard_normal((50, 16)))
    rows = [(i, v.astype(float).tolist(), i % 2) for i, v in enumerate(vectors)]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1002, None, 0), (1003, [0.0] * 16, 1), (1004, [float("nan")] * 16, 1), (1005, rows[0][1], None), (1006, [], 0), (1007, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("mine"))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=16).collect()}
    good = [(i, np.array(v), y) for i, v, y in rows if i not in (1002, 1003, 1004, 1005, 1006, 1007)]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in good])
    same = np.array([[a[2] == b[2] for b in good] for a in good])
    link = (unit @ unit.T >= 0.98) & same & ~np.eye(len(good), dtype=bool)
    label = np.arange(len(good))
    for _ in good:
        label = np.array([min([label[k], *label[link[k]]]) for k in range(len(good))])
    assert len(got) == len(rows) and link.sum() > 1000
    for k, (i, _, _) in enumerate(good):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[k].sum(), good[label[k]][0], label[k] == k)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (1002, 1003, 1004, 1005, 1006, 1007))


def test_embeddings_with_a_common_direction(spark):
    """Isolated pairs among vectors of a mean cosine of 0.8; few and narrow windows."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    first = unit(2 * unit(rng.standard_normal((1, 64))) + unit(rng.standard_normal((1500, 64))))
    both = unit(np.concatenate([first, first + 0.19 * unit(rng.standard_normal((1500, 64)))]))
    link = both @ both.T >= 0.98
    assert link.sum() > 3000 + 2000
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, passes=8, window=8).collect()}
    assert got == dict(enumerate((link.sum(1) - 1).tolist()))


def test_recall_on_spread_clusters(spark):
    """Chains at 0.98 to 0.99, components over a block, several labels; nothing is a copy.  Brute force gives the links."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    vectors, labels = [], []
    for label, (chains, length) in enumerate([(2, 400), (20, 40), (300, 3), (700, 1)]):
        for _ in range(chains):
            v = unit(rng.standard_normal(48))
            for _ in range(length):
                vectors.append(v)
                labels.append(label % 3)
                v = unit(v + rng.uniform(0.14, 0.2) * unit(rng.standard_normal(48)))
    x, y = np.array(vectors), np.array(labels)
    link = (x @ x.T >= 0.98) & (y[:, None] == y[None, :]) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "vec_id long, embedding array<double>, label int")
    got = np.array([r.n_links for r in embeddings.near_duplicates(df).orderBy("vec_id").collect()])
    assert (got <= link.sum(1)).all() and link.sum() > 2000
    assert got.sum() >= 0.99 * link.sum()


def test_nothing(spark, nothing):
    assert phrases.remove_repeats(nothing).count() == 0
    assert suffix_repeats.remove_repeats(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = np.random.default_rng(2)
    text = b" ".join(rng.choice([b"aa", b"b", b"ccc", b"\xc3\xa9"], 3000).tolist())
    whole = dict(c.word_hashes([text]))[0]
    monkeypatch.setattr(c, "PIECE", 500)
    assert (dict(c.word_hashes([text]))[0] == whole).all()
    windows = [w for p in c.pieces([(0, whole)], 35) for w in p.at[np.flatnonzero(p.valid)].tolist()]
    assert windows == list(range(len(whole) - 34))
