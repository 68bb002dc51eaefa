"""Removal of copied passages against plain Python, and factors against the definition."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from treeq.llm import relative

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, least=13):
    first, out = {}, []
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - least + 1):
            if i is not None:
                key = tuple(w[p : p + least])
                first[key] = min(i, first.get(key, i))
    for i, w in split:
        gone = {q for p in range(len(w) - least + 1) if i is not None and first[tuple(w[p : p + least])] < i for q in range(p, p + least)}
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return Counter(out)


def frame(spark, rows):
    own = [F.lit("own").alias(c) for c in ("key", "block", "start", "n", "ids", "row", "pos", "prints", "runs", "kept", "ref_id", "begin")]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *own)


def test_random(spark, monkeypatch):
    rng = random.Random(5)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(8, 40))) for _ in range(25)]
    rows = [(rng.randint(1, 150), rng.choice([" ", "\n", "  "]).join(rng.choice([*passages, f"own{i}", "x x x x x x x x x x x x x x x x"]) for _ in range(rng.randint(0, 7)))) for i in range(220)]
    rows += [(i, t.split("own")[0]) for i, t in rows[:30]]
    for batch, hot in ((1 << 20, 4096), (3000, 4)):  # all in one batch or not, none or some minimisers frequent
        monkeypatch.setattr(relative, "BATCH", batch)
        monkeypatch.setattr(relative, "HOT", hot)
        assert Counter(map(tuple, relative.remove_copied(frame(spark, rows).repartition(3)).collect())) == plain(rows)


def test_odd_inputs(spark):
    text = " ".join(f"w{i}" for i in range(30))
    long = " ".join(f"w{i * 7919 % 30011}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, text), (4, text), (5, text + " end"), (None, text), (None, text), (6, "W0 " + text), (7, long), (8, "start " + long), (9, " ".join(["x"] * 5000)), (10, " ".join(["x"] * 40)), (11, "w0   w1 \x1f " + text)]
    got = relative.remove_copied(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == plain(rows)
    assert relative.remove_copied(frame(spark, [])).count() == 0
    ids = spark.createDataFrame([("b", text), ("a", text), ("c", text + " z")], "doc_id string, text string")
    assert {(r.doc_id, r.n_removed) for r in relative.remove_copied(ids).collect()} == {("a", 0), ("b", 30), ("c", 30)}


def test_factors_are_copies(spark, monkeypatch):
    """A factor goes on in one earlier document; with one document a batch every factor has a reference."""
    monkeypatch.setattr(relative, "BATCH", 1)
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = {1: a, 2: b, 3: b[20:150] + " " + a[30:200], 5: a + " " + b}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").withColumn("key", F.xxhash64("text"))
    found = relative.factors(docs).collect()
    assert {r.doc_id for r in found} == {3, 5} and all(r.ref_id < r.doc_id for r in found)
    for r in found:
        copied = rows[r.doc_id].split()[r.start : r.start + r.n + 12]
        ref = rows[r.ref_id].split()
        assert any(ref[p : p + len(copied)] == copied for p in range(len(ref)))
    covered = Counter((r.doc_id, r.start + k) for r in found for k in range(r.n))
    assert len(covered) == sum(covered.values())


def test_hot_minimiser_is_found(spark):
    """A seed that many different windows have is dealt by window."""
    rows = [(i, f"a{i} b{i} c{i} d{i} common line that all of the many documents here do have x{i} y{i} z{i} u{i} v{i} r{i} s{i} t{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.xxhash64("text"))
    assert len(relative._frequent(docs, 13, 64)) >= 1
    assert Counter(map(tuple, relative.remove_copied(docs).collect())) == plain(rows)
