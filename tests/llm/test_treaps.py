"""Ranked search against a plain version that scores every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeq.llm import common, treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counts = [(i, Counter(split(t))) for i, t in docs]
    n, length = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in dict.fromkeys(items):
        asked.setdefault(i, Counter()).update(split(t))
    out = set()
    for item, times in asked.items():
        scored = []
        for doc, c in counts:
            m = 25 + 75 * c.total() * n // max(length, 1)
            score = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in times.items() if c[t])
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out |= {(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k], 1)}
    return out


DOCS = [(1, "The cat sat. THE CAT!"), (2, None), (3, ""), (4, "... --- \n"), (5, "élan Élan naïve x1y2"), (6, "the dog"), (7, "the dog"), (7, "dog dog cat"), (None, "cat only here"), (9, "a_b-c don't")]
ITEMS = [(1, "cat"), (1, "cat"), (1, "dog dog"), (2, "Élan é the"), (3, None), (4, "nothing"), (None, "x1y2 b"), (5, "don't the the")]


def frame(spark, rows, name):
    own = [F.lit("own").alias(c) for c in ("term", "weight", "times", "ids", "n", "rank", "score", "df", "docs")]
    return spark.createDataFrame(rows, f"{name} long, text string").select("*", *own)


def test_odd_inputs(spark):
    got = treaps.search(frame(spark, DOCS, "doc_id").repartition(3), frame(spark, ITEMS, "item_id")).collect()
    assert {tuple(r) for r in got} == plain(DOCS, ITEMS) and len(got) == len({(r.item_id, r["rank"]) for r in got})
    none = frame(spark, [], "doc_id")
    assert treaps.search(none, frame(spark, ITEMS, "item_id")).count() == 0
    assert treaps.search(frame(spark, DOCS, "doc_id"), frame(spark, [], "item_id")).count() == 0


@pytest.mark.parametrize("groups", [1, 3])
def test_against_plain(spark, small, monkeypatch, groups):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    docs += [(1000 + i, docs[3][1]) for i in range(80)]  # equal scores
    items += [(500, docs[3][1])]
    if groups > 1:
        monkeypatch.setattr(treaps, "QUERY_TERMS", 500)
    monkeypatch.setattr(treaps, "BLOCK", 20_000)
    got = treaps.search(frame(spark, docs, "doc_id").repartition(3), frame(spark, items, "item_id")).collect()
    assert {tuple(r) for r in got} == plain(docs, items)


def test_long_text_and_string_ids(spark):
    long = " ".join(f"w{i * 7919 % 30011}" for i in range(200_000))
    docs, items = [("b", long), ("a", "w1 w2"), ("é", "w2 w3")], [("q", "w3 w2")]
    got = treaps.search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string"), 2)
    assert {tuple(r) for r in got.collect()} == plain(docs, items, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 59), st.integers(1, 4), min_size=1), min_size=1, max_size=5), st.integers(1, 6), st.lists(st.integers(1, 3), min_size=5, max_size=5))
def test_treaps_find_the_best(postings, k, weights):
    """Simultaneous traversal of treaps of random postings against sums over all."""
    rows = [sorted(p.items()) for p in postings]
    class Row(dict):
        pass
    class Values:
        def __init__(self, x): self.x = x
        @property
        def values(self): return self
        def to_numpy(self, zero_copy_only=False): return np.array(self.x)
        def to_pylist(self): return list(self.x)
    flat = [x for r in rows for x in r]
    first = np.cumsum([0] + [len(r) for r in rows])
    f = treaps.Forest({"ids": Values(range(60)), "terms": Values(range(len(rows))), "first": Values(first), "docs": Values([d for d, _ in flat]), "tf": Values([t for _, t in flat]), "n": Values([7] * 60)}, 60, 420)
    term, weight = np.arange(len(rows)), np.array(weights[: len(rows)])
    total = Counter()
    for t, r in enumerate(rows):
        for i, (d, _) in enumerate(r):
            total[d] += int(f.impact[first[t] + i]) * int(weight[t])
        tree = [f.root(t)]
        while tree:  # heap order and search order
            v = tree.pop()
            for c, side in ((f.left[v], -1), (f.right[v], 1)):
                if c >= 0:
                    assert f.impact[c] <= f.impact[v] and (f.doc[c] - f.doc[v]) * side > 0
                    tree.append(c)
    assert f.search(term, weight, k, []) == sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_blocks_of_a_file_are_few(spark, monkeypatch):
    """A reader holds the rows of a file that are next to each other, thousands of them, so a file has few blocks."""
    monkeypatch.setattr(treaps, "BLOCK", 64)
    kept = []
    monkeypatch.setattr(treaps, "cut", lambda df, *a: kept.append(common.cut(df, *a)) or kept[-1])
    docs = spark.createDataFrame([(i, f"word{i} other words of a text {i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    found = treaps.search(docs, spark.createDataFrame([(1, "word7")], "item_id long, text string"), 3).collect()
    assert [r.doc_id for r in found] == [7]
    sizes = kept[0].groupBy("_metadata.file_path").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) <= treaps.PER_FILE
