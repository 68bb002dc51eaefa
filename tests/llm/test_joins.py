"""Near duplicates, repeated passages, vectors: against brute force, with copies, ties, nulls and empty tables."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeq.llm import ann, covertree, neardup, suffix
from treeq.llm.components import components


def roots(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == roots({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def corpus(seed=2):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 3))
    passage, rows = [word() for _ in range(60)], []
    for group in range(14):
        base = [word() for _ in range(int(rng.integers(4, 160)))]
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = word()
            rows.append((" ".join(w + (passage if rng.random() < 0.3 else []))))
    big = [word() for _ in range(120)]
    for i in range(330):  # a group larger than a bucket and a block
        w = list(big)
        w[i % 120] = word()
        rows.append(" ".join(w))
    rows += [rows[0]] * 5 + [rows[0].upper() + " "] + ["", " ", "hi", "hi", "hi there"]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame([(i, t, "s", i) for i, t in [*rows, (5000, None), (None, rows[0][1])]], "doc_id long, text string, source string, node long")


def test_near_duplicates(docs):
    rows, df = docs
    sets = {i: shingles(t) for i, t in rows}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    count, top = Counter(x for e in links for x in e), roots(sets, links)
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2 and len(links) > 10000
    for r in got:
        if r.doc_id is None or r.doc_id == 5000:
            assert (r.class_id, r.n_links, r.kept) == (r.doc_id, 0, True)
        else:
            assert (r.n_links, r.class_id, r.kept) == (count[r.doc_id], top[r.doc_id], top[r.doc_id] == r.doc_id), r


def test_near_duplicates_empty(docs):
    assert neardup.near_duplicates(docs[1].limit(0)).count() == 0


def test_repeated_passages(spark, docs):
    rows, df = docs
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for i, t in rows}
    seen = {}
    for i, w in words.items():
        for s in range(len(w) - 49):
            seen.setdefault(tuple(w[s : s + 50]), set()).add(i)
    want = {}
    for i, w in words.items():
        for s in range(len(w) - 49):
            if len(seen[tuple(w[s : s + 50])]) > 1:
                spans = want.setdefault(i, [])
                if spans and spans[-1][1] >= s:
                    spans[-1][1] = s + 50
                else:
                    spans.append([s, s + 50])
    got = {}
    for r in suffix.repeated_passages(df).collect():
        got.setdefault(r.doc_id, []).append([r.start, r.end])
    assert {i: sorted(x) for i, x in got.items()} == want and len(want) > 100
    spark.conf.set("spark.sql.shuffle.partitions", "37")  # beginnings that span partitions
    try:
        assert suffix.repeated_passages(df).count() == sum(map(len, want.values()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    loop = spark.createDataFrame([(1, "a b " * 80), (None, "x " * 99), (2, None)], "doc_id long, text string")
    assert suffix.repeated_passages(loop).count() == 0  # inside one document nothing repeats across documents


def vectors(seed=3, n=260, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    x = np.where(rng.random((n, 1)) < 0.6, centres[rng.integers(0, 9, n)] + rng.normal(0, 0.22, (n, dim)), rng.normal(size=(n, dim)))
    x[200:230] = x[0]
    x[230:233] = 3 * x[1]
    return x.astype(np.float32)


BAD = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0, None] + [0.0] * 14), (9005, []), (None, [1.0] * 16), (9006, [float("inf")] + [1.0] * 15)]


@pytest.fixture(scope="module")
def vecs(spark):
    x = vectors()
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(a, b, None) for a, b in BAD] + [(9100, [1.0, 2.0], 1), (9101, [2.0, 4.0], 1)]
    return x.astype(float), spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("block", [4096, 40])
def test_cover_tree(vecs, block):
    x, df = vecs
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True)]
    top = roots(range(len(x)), links)
    got = {r.vec_id: r for r in covertree.near_vectors(df, block=block).collect() if r.vec_id is not None}
    assert len(got) == len(x) + 8
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[i].sum() - 1, top[i], top[i] == i)
    assert got[9101].component_id == 9100 and got[9100].n_links == 1
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, _ in BAD if i)
    assert covertree.near_vectors(df.limit(0)).count() == 0


def test_whole_subtrees():
    rng = np.random.default_rng(5)
    x = np.concatenate([[1.0, 0, 0, 0] + rng.normal(0, 0.01, (60, 4)), rng.normal(size=(40, 4))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = covertree.Tree(x, covertree._levels(x))
    i, j, whole = covertree.dual(t, t, 0.9, True)
    assert whole  # dense nodes are counted without comparing their members
    na, nb, *_ = covertree.links(t, t, np.ones(100, int), np.ones(100, int), 0.9, True)
    assert (na + nb == (x @ x.T >= 0.9).sum(1) - 1).all()


def test_pruning():
    """From the two roots down, most pairs of nodes fall away with their parents where vectors have clusters."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 32))
    x, y = (centres[rng.integers(0, 40, n)] + rng.normal(0, 0.12, (n, 32)) for n in (1500, 1200))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    a, b = (covertree.Tree(v, covertree._levels(v)) for v in (x, y))
    for tree in (a, b):  # one root; nested centres; true covering radii within the level's; centres of a level apart
        assert len(tree.nodes[0]) == 1 and all(set(u) <= set(v) for u, v in zip(tree.nodes, tree.nodes[1:], strict=False))
        for level in range(covertree.DEPTH):
            away = np.linalg.norm(tree.x - tree.x[tree.below[level]], axis=1)
            assert away.max() <= tree.radius[0][0] / 2**level + 1e-3 and abs(tree.radius[level].max() - away.max()) < 1e-6
    for left, right, same in ((a, a, True), (a, b, False)):
        seen = []
        covertree.dual(left, right, 0.9, same, seen)
        assert sum(seen) < 0.15 * len(left.x) * len(right.x), seen
        ones = [np.ones(len(t.x), np.int64) for t in (left, right)]
        na, nb, *_ = covertree.links(left, right, *ones, 0.9, same)
        hit = left.x @ right.x.T >= 0.9
        assert (na + nb == hit.sum(1) - 1).all() if same else (na == hit.sum(1)).all() and (nb == hit.sum(0)).all()


def test_nearest(vecs):
    x, df = vecs
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r
    hits = 0
    for q in range(0, len(x), 10):
        s = u @ u[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -np.round(s, 12))) if i != q][:5]
        mine = [got[q][k] for k in range(1, 6)]
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        assert [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
        hits += len(set(order) & {r.vec_id for r in mine})
    assert hits / (5 * len(range(0, len(x), 10))) > 0.95
    assert len(got[9100]) == 1 and got[9100][1].vec_id == 9101  # fewer candidates than asked for
    assert ann.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_nearest_recall(spark, small):
    from treeq.llm import queries

    d = small.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    u = np.array([r.embedding for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = queries.op6_anisotropic_ann(spark, d).collect()
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(ids[np.argsort(-s)[:5]]) & {r.vec_id for r in got if r.query_id == ids[q]})
    assert hits / len(got) >= 0.9 and len(got) == 5 * (ids % 50 == 0).sum()


def test_nearest_dense_group(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x[::3] = rng.normal(size=64) + rng.normal(0, 0.1, (1000, 64))  # a third of the rows: cosines of about 0.99
    x = x.astype(np.float32)
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -9
        assert [got[q][k] for k in range(1, 6)] == np.argsort(-s)[:5].tolist(), q
