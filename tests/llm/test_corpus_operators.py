"""Packing, mixing, URL rules and the pipeline."""

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeq.llm import mixing, packing, pii, queries, urls


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 31)), max_size=60))
def test_best_fit_is_tightest(pieces):
    pieces = sorted(pieces, reverse=True)
    got = packing.best_fit([p[0] for p in pieces], [p[1] for p in pieces], 40)
    room, mask = {}, {}
    for (size, bits), b in zip(pieces, got, strict=True):
        fits = [room[x] for x in room if room[x] >= size and not mask[x] & bits]
        assert (room[b] == min(fits)) if fits else b not in room
        assert not mask.get(b, 0) & bits
        room[b], mask[b] = room.get(b, 40) - size, mask.get(b, 0) | bits


def test_pack_without_conflicts(spark):
    sizes = [1, 1, 1] + np.random.default_rng(8).integers(1, 60, 300).tolist()
    rows = [(i, f"t{i} " * n, f"s{i}") for i, n in enumerate(sizes)]
    got = {r.bin: r.bin_words for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=64).collect()}
    rooms = []
    for n in sorted(sizes, reverse=True):  # naive best fit
        room = min((r for r in rooms if r >= n), default=None)
        if room is not None:
            rooms.remove(room)
        rooms.append((64 if room is None else room) - n)
    assert sorted(got.values()) == sorted(64 - r for r in rooms)
    three = packing.pack(spark.createDataFrame(rows[:3], "doc_id long, text string, source string")).collect()
    assert len(three) == 3 and len({r.bin for r in three}) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 30), st.integers(0, 50)), max_size=60))
def test_pack_rare_sources(pieces):
    pieces = sorted(pieces, reverse=True)
    sizes, sources, clusters = ([p[j] for p in pieces] for j in range(3))
    got = packing.best_fit(sizes, packing._masks(pd.Series(sources), pd.Series(clusters)), 40)
    bins = {}
    for size, source, cluster, b in zip(sizes, sources, clusters, got, strict=True):
        room = {x: 40 - sum(p[0] for p in inside) for x, inside in bins.items()}
        fits = [room[x] for x, inside in bins.items() if room[x] >= size and all(source != s and cluster != c for _, s, c in inside)]
        assert (room[b] == min(fits)) if fits else b not in bins
        bins.setdefault(b, []).append((size, source, cluster))
        assert len({p[1] for p in bins[b]}) == len(bins[b]) == len({p[2] for p in bins[b]})


DOCS = [(1, "a b c " * 50, "x"), (1, "a b c " * 50, "x"), (2, None, None), (3, "", "x"), (None, "w " * 9, None), (4, "q " * 500, "y"), (5, "A  b c " * 50, "z"), (6, "r " * 64, "x")] + [(10 + i, f"t{i} " * (i % 37 + 1), f"s{i % 5}") for i in range(200)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, 1, "k") for d in DOCS], "doc_id long, text string, source string, size int, cluster string")


@pytest.mark.parametrize("shard_rows", [4096, 20])
def test_pack(docs, shard_rows):
    rows = packing.pack(docs, capacity=64, shard_rows=shard_rows).collect()
    words, bins = Counter(), defaultdict(list)
    for r in rows:
        words[r.doc_id] += r.n_words
        assert r.first_word == 64 * r.piece
        if r.bin:
            bins[r.bin].append(r)
    want = Counter()
    for i, t, _ in DOCS:
        want[i] += len((t or "").split())
    assert words == want
    for inside in bins.values():
        assert sum(r.n_words for r in inside) == inside[0].bin_words <= 64
        assert len({r.source for r in inside}) == len(inside) == len({r.cluster for r in inside})
    assert [r.bin for r in rows if r.doc_id in (2, 3)] == [None, None]
    assert len({r.cluster for r in rows if r.doc_id in (1, 5)}) == 1
    assert packing.pack(docs.limit(0)).count() == 0


def levels(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in rows) == sorted((i is None, i, len((t or "").split())) for i, t, _ in DOCS)
    sizes, took = Counter(), Counter()
    for i, t, s in DOCS:
        sizes[s] += len((t or "").split())
    want = levels(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        took[r.source] += r.taken
    assert sum(took.values()) == int(sum(want.values()))
    for s in sizes:
        assert abs(took[s] - want[s]) <= max(r.size for r in rows if r.source == s) + 1
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))  # reruns agree
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_over_all_data(spark, small):
    rows = queries.op10_weighted_mixing(spark, small).collect()
    assert abs(sum(r.taken for r in rows) - 1.5 * sum(r.size for r in rows)) < 1


PAGES = [
    (1, "https://blog.example.com/en/1#top", "", ("com/", "block", "example.com/en/")), (2, "http://www.EXAMPLE.com/en/1?x=2", None, (None, "allow", "www.example.com/en/")),
    (3, None, "<p>", (None, "allow", None)), (4, "no address", "", (None, "allow", None)), (5, "http://a.net/fr/x", '<link rel="canonical" href="http://b.org/page.html">', (None, "block", "net/fr/")),
    (6, "https://www.b.org/page/", "", (None, "block", None)), (7, "http://m.b.org/page?utm_source=q", "", (None, "block", None)), (8, "http://c.org/z", "<META http-equiv='refresh' content='0; url=/page'>", (None, "allow", None)),
    (9, "http://d.org/a/b", '<link href="http://a.net/es/1" rel=canonical>', (None, "allow", None)), (10, "http://a.net/es/1", '<link rel="canonical" href="http://ok.com/">', (None, "block", "net/es/")), (11, "http://ok.com/", "", (None, "allow", "com/")),
    (12, "http://notexample.com/en/", "", (None, "allow", "com/")), (13, "http://x.com", "", (None, "allow", None)), (13, "http://x.com", "", (None, "allow", None)),
]


def test_urls(spark):
    rows = urls.judge(spark.createDataFrame([(*p[:3], 1, "v") for p in PAGES], "page_id long, url string, html string, said int, link string")).collect()
    assert sorted((r.page_id, r.verdict, r.rule or "") for r in rows) == sorted((p[0], p[3][1], p[3][2] or "") for p in PAGES)
    by = {r.page_id: r for r in rows}
    assert (by[2].host, by[2].path, by[2].said, by[2].link) == ("www.example.com", "/en/1", 1, "v") and (by[4].host, by[4].path) == ("", "") == (by[3].host, by[3].path)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        kept = cp.cut(stage(spark, kept, small))
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and {r.doc_id for r in rows} <= ids
        if name == "pii":
            assert not any(pii.base_spans(r.text) for r in rows)
            before = len(rows)
        if name != "mixing":
            assert len({r.doc_id for r in rows}) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r.doc_id] += len(r.text.split())
    assert max(Counter(r.doc_id for r in rows).values()) == 2 and before > 0.3 * len(ids)
    got = Counter()
    for r in cp.run(spark, small).collect():
        got[r.doc_id] += r.n_words
    assert got == sizes


def test_pipeline_repeated_rows(spark, docs):
    import corpus_pipeline as cp

    rows = docs.select("doc_id", "text", "source")
    assert cp.once(rows).count() == len(set(DOCS)) and cp.drop_near_duplicates(spark, rows, "").where("doc_id = 1").count() == 1
    mixed = cp.mix_sources(spark, rows, "").collect()
    assert max(Counter(r.doc_id for r in mixed).values()) <= 4 and np.sum([len(r.text.split()) for r in mixed]) > 0


def test_pipeline_clashing_columns(spark, small):
    """Columns of any name keep their values through the stages."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    names = ["score", "predicted", "size", "part", "key", "row", "id", "text_key", "text_hash", "spans", "node", "n", "copies", "Target"]
    more = docs.select("*", *(F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in names))
    for name, stage in cp.STAGES[:-1]:
        kept = cp.cut(stage(spark, more, small))
        assert kept.columns == more.columns, name
        rows = kept.collect()
        assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in names), name
    assert cp.STAGES[-1][1](spark, more, small).count() >= 60
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0


def test_pack_any_ids(spark):
    rows = [("x", "a b c " * 30, "s"), ("y", "d " * 130, "s"), (None, "e f", None), ("x", "a b c " * 30, "s"), ("x", "q " * 70, "s")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id string, text string, source string"), capacity=64).collect()
    words = Counter()
    for r in got:
        words[r.doc_id] += r.n_words
        assert r.bin_words <= 64
    assert words == Counter({"x": 250, "y": 130, None: 2})
    full = [r.bin for r in got if r.n_words == 64]
    assert len(set(full)) == len(full) == 1 + 2 + 1 + 1
    big = (1 << 60) + 1  # more than a floating point number holds
    got = packing.pack(spark.createDataFrame([(big, "a", "s"), (None, "b", "s")], "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got} == {big, None}


def test_many_copies(spark):
    from treeq.llm.common import ranked, repeated

    df = spark.createDataFrame([("a", 1), ("b", 5000), ("c", 1024)], "k string, n long")
    got = Counter((r.k, r.i) for r in repeated(df, "n", "i").collect())
    assert set(got.values()) == {1} and len(got) == 6025 and max(i for k, i in got if k == "b") == 5000
    some = spark.range(500).selectExpr("pmod(hash(id), 1000) AS v")
    rows = sorted((r["rank"], r.v) for r in ranked(some, F.col("v"), name="rank").collect())
    assert [r for r, _ in rows] == list(range(1, 501)) and [v for _, v in rows] == sorted(v for _, v in rows)


def test_mix_queue(docs):
    """Word for word against the queue of finish times, gone through entry by entry."""
    rows = mixing.mix(docs).collect()
    target = {r.source: r.target for r in rows}
    h = {(r.doc_id, r.text_key): (r.h0, r.h1) for r in docs.select("doc_id", F.xxhash64("text").alias("text_key")).select("doc_id", "text_key", *(F.xxhash64(F.lit(17), "doc_id", F.lit(p), "text_key").alias(f"h{p}") for p in (0, 1))).collect()}
    entries = Counter((r.doc_id, r.text_key, r.source, r.size) for r in rows)
    queue, upto = [], Counter()
    for p in (0, 1):
        for (i, k, s, size), n in sorted(entries.items(), key=lambda e: h[e[0][0], e[0][1]][p]):
            upto[s] += size * n
            queue.append((upto[s] / target[s] if target[s] else 0.0, h[i, k][p], i, k, s, size, n))
    left, want = int(1.5 * sum(size * n for (_, _, _, size), n in entries.items())), Counter()
    for _, _, i, k, s, size, n in sorted(queue, key=lambda e: e[:2]):
        took = max(0, min(size * n, left))
        left -= took
        want[i, k, s] += took
    got = Counter()
    for r in rows:
        got[r.doc_id, r.text_key, r.source] += r.taken
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_links_in_pages(spark):
    """Take the components out and these verdicts change."""
    base = [(1, "http://shop.net/es/a", ""), (2, "http://x.org/p?a=1&amp", ""), (3, "http://x.org/d/e.html", '<link rel="canonical" href="../q?b=1&amp;c=2">'), (4, "https://x.org/q?b=1&c=2", '<link rel="canonical" href="http://shop.net/es/a">'), (5, "https://www.x.org/q?b=1&utm_id=3&c=2#z", ""), (6, "http://y.org/k?p=1", '<link rel="canonical" href="?p=2">'), (7, "http://y.org/k?p=2", '<meta http-equiv="refresh" content="0;url=//shop.net/es/a">')]
    rows = urls.judge(spark.createDataFrame([(*b, "v", "w") for b in base], "page_id long, url string, html string, _said string, way_ string")).collect()
    assert {r.page_id: r.verdict for r in rows} == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block"}
    assert all((r["_said"], r["way_"]) == ("v", "w") for r in rows)


def test_pipeline_brute_force(spark, small):
    """run() against plain Python, given which documents the classifier keeps and the model of personal data: near duplicates by comparing all
    pairs, redaction span by span, the mixture's queue entry by entry, and for packing the rules of a bin."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = {r.doc_id for r in cp.keep_good(spark, docs, small).collect()}
    texts = {r.doc_id: (r.text or "", r.source) for r in docs.collect() if r.doc_id in good}
    sets = {}
    for i, (t, _) in texts.items():
        w = t.lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    kept = {i for i in sets if top(i) == i}
    model = pii.fit(docs.where(F.col("doc_id").isin(list(kept))))

    def redacted(t):
        out, at = "", 0
        for kind, s, e, *_ in sorted(pii.spans(t, model), key=lambda x: (x[1], -x[2])):
            if s >= at:
                out += t[at:s] + f"<{kind.upper()}>"
            at = max(at, e)
        return out + t[at:]

    texts = {i: (redacted(texts[i][0]), texts[i][1]) for i in kept}
    frame = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string").withColumn("text_key", F.xxhash64("text"))
    h = {r.doc_id: (r.h0, r.h1) for r in frame.select("doc_id", *(F.xxhash64(F.lit(17), "doc_id", F.lit(p), "text_key").alias(f"h{p}") for p in (0, 1))).collect()}
    size = {i: len(t.split()) for i, (t, _) in texts.items()}
    total = Counter()
    for i, (_, s) in texts.items():
        total[s] += size[i]
    target, upto, queue = levels(total), Counter(), []
    for p in (0, 1):
        for i in sorted(size, key=lambda i: h[i][p]):
            s = texts[i][1]
            upto[s] += size[i]
            queue.append((upto[s] / target[s] if target[s] else 0.0, h[i][p], i))
    left, want = int(1.5 * sum(size.values())), Counter()
    for _, _, i in sorted(queue):
        took = min(size[i], left)
        left -= took
        want[i] += took
    rows, got, bins = cp.run(spark, small).collect(), Counter(), defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.n_words
        if r.bin:
            bins[r.bin].append(r)
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in want.items() if n}
    for inside in bins.values():
        assert sum(r.n_words for r in inside) == inside[0].bin_words <= 1024
        assert len({r.source for r in inside}) == len(inside) == len({r.cluster for r in inside})
