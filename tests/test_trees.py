"""Interval labels of trees, also with cycles and heads outside, against plain Python."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from treeq.operators import trees

WORD = "array<struct<id:int,head:int,form:string,upos:string,deprel:string>>"


def sentences(spark, heads):
    return spark.createDataFrame([(k, [(i + 1, h, f"w{i + 1}", "X", "dep") for i, h in enumerate(hs)]) for k, hs in enumerate(heads)], f"k int, words {WORD}")


def up(heads, i):
    out, at = [], heads[i - 1]
    while 1 <= at <= len(heads) and at not in out:
        out.append(at)
        at = heads[at - 1]
    return out


def cases():
    rng = random.Random(3)
    out = [[0], [1], [2, 1], [9, 1], [0, 1, 2, 3], [2, 3, 1, 1, 4], [0, 0, 1, 2], [2, 0, 2, 6, 6, 2], [-1, 1], [3, 3, 0, 1, 2, 9, 6]]
    for _ in range(120):
        n = rng.randint(1, 13)
        out.append([rng.randint(-1, n + 1) for _ in range(n)])
    for _ in range(60):  # real trees
        n = rng.randint(1, 13)
        names = rng.sample(range(1, n + 1), n)
        at = {names[0]: 0} | {names[i]: names[rng.randrange(i)] for i in range(1, n)}
        out.append([at[i] for i in range(1, n + 1)])
    return out


def test_below_and_ancestors(spark):
    heads = cases()
    df = trees.with_ancestors(trees.with_labels(sentences(spark, heads)))
    pairs = F.transform("words", lambda a: F.filter(F.transform("words", lambda b: F.when(trees.below(F.col("labels"), b["id"], a["id"]), b["id"])), lambda x: x.isNotNull()))
    for r in df.select("k", "up", "labels", pairs.alias("under"), trees.problems().alias("bad")).collect():
        hs = heads[r.k]
        ups = [up(hs, i) for i in range(1, len(hs) + 1)]
        assert r.up == ups
        assert r.under == [[b for b in range(1, len(hs) + 1) if a in ups[b - 1]] for a in range(1, len(hs) + 1)]
        assert ("cycle" in r.bad) == any(i + 1 in u for i, u in enumerate(ups))
        for i, m in enumerate(r.labels):
            loop = [a for a in [i + 1, *ups[i]] if a in ups[a - 1]]
            assert m.depth == (None if loop else len(ups[i]) + 1)
            assert m.cycle == (min(ups[i]) if i + 1 in ups[i] else None)
            assert m.top == (min(ups[loop[0] - 1]) if loop else [i + 1, *ups[i]][-1])


def test_projective_and_subtrees(spark):
    heads = cases()
    df = sentences(spark, heads).select("k", trees.is_projective().alias("p"), F.transform(trees.subtree(2), lambda w: w["form"]).alias("forms"))
    for r in df.collect():
        hs = heads[r.k]
        inside = [(x, h) for i, h in enumerate(hs, 1) if h > 0 and abs(i - h) > 2 for x in range(min(i, h) + 1, max(i, h))]
        assert r.p == all(x <= len(hs) and h in up(hs, x) for x, h in inside)
        assert r.forms == [f"w{i}" for i in range(1, len(hs) + 1) if i == 2 or 2 in up(hs, i)]


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_long_sentences(spark, shape):
    """5,000 words: labels, dominance and projectivity grow with n log n."""
    n, rng = 5000, random.Random(1)
    heads = {"chain": list(range(n)), "star": [0] + [1] * (n - 1), "random": [0] + [rng.randint(1, i) for i in range(1, n)]}[shape]
    df = sentences(spark, [heads]).cache()
    df.count()
    trees.with_labels(df).count()
    began = time.time()
    row = df.select(F.size(trees.dominated(1)).alias("n"), trees.is_projective().alias("p")).first()
    took = time.time() - began
    df.unpersist()
    assert row.n == n - 1 and row.p == (shape != "random")
    assert took < 10  # about a second on a free machine; the square would take minutes


def test_nested_json(spark):
    """The text parsed back is the tree built by recursion; cycles are opened at their smallest word."""
    from test_patterns import TOKEN

    from treeq.sources.export import nested_json

    heads = cases()
    token = lambda i, h: ("WORD", i, -1, f'w"{i}}}', "l", "X", "_", {"A": "}"} if i % 2 else {}, h, "dep", [(h, 2, "e")] if i == 1 else [], [("k", None)] if i == 2 else [])
    df = spark.createDataFrame([(k, [token(i, h) for i, h in enumerate(hs, 1)]) for k, hs in enumerate(heads)], f"k int, words array<{TOKEN}>")

    def tree(hs, i, top):
        n = len(hs)
        out = {"id": i, "form": f'w"{i}}}', "lemma": "l", "upos": "X", "xpos": "_", "deprel": "dep"}
        out |= {"feats": {"A": "}"}} if i % 2 else {}
        out |= {"deps": [{"id": f"{hs[0]}.2", "deprel": "e"}]} if i == 1 else {}
        out |= {"misc": [{"name": "k"}]} if i == 2 else {}
        out |= {"highlight": True} if i == 3 else {}
        wrong = "head outside the sentence" if hs[i - 1] > n else "cycle" if i in up(hs, i) else None
        out |= {"error": wrong} if wrong else {}
        return out | {"children": [tree(hs, c, top) for c in range(1, n + 1) if hs[c - 1] == i and c not in top]}

    for r in df.select("k", nested_json(F.array(F.lit(3)), multiword=False).alias("json")).collect():
        hs = heads[r.k]
        top = [i for i in range(1, len(hs) + 1) if not 1 <= hs[i - 1] <= len(hs) or (i in up(hs, i) and i == min(up(hs, i)))]
        assert json.loads(r.json) == [tree(hs, i, top) for i in top]
