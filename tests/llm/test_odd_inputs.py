"""Every operator on nulls, empty and very long texts, ties, repeated rows and columns whose names clash with its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeq.llm import ann, covertree, langid, mixing, neardup, packing, pii, quality, suffix, urls

CLASH = "node part row n score spans size taken target class_id kept bin piece pos h hit at grp lang_pred predicted alias verdict rule key held copies cell dim k rank query".split()
LONG = " ".join(f"w{i * 7919 % 30011}" for i in range(200_000))
ROWS = [(1, LONG, "en", "a"), (2, LONG + " more", "en", "a"), (3, None, None, None), (4, "", "de", "b"), (5, "short text", "en", None), (5, "short text", "en", None), (None, "no id here", "de", "b"), (7, " \t\n ", None, "b"), (8, "short text", "en", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return rows.select("*", *(F.lit("own").alias(c) for c in CLASH))


def test_packing(docs):
    rows = packing.pack(docs).collect()
    words = sum(r.n_words for r in rows)
    assert words == sum(len((t or "").split()) for _, t, *_ in ROWS) and max(r.n_words for r in rows) == 1024


def test_near_duplicates(docs):
    rows = {(r.doc_id, r.n_links, r.class_id) for r in neardup.near_duplicates(docs).collect()}
    assert rows == {(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 2, 5), (None, 0, None), (7, 0, 7), (8, 2, 5)}


def test_passages(docs):
    rows = sorted(map(tuple, suffix.repeated_passages(docs).collect()))
    assert rows == [(1, 0, 200_000), (2, 0, 200_000)]


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    total = sum(len((t or "").split()) for _, t, *_ in ROWS)
    assert len(rows) == len(ROWS) and sum(r.taken for r in rows) == int(1.5 * total) and all(0 <= r.taken <= 2 * r.size for r in rows)


def test_classifiers(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.node == "own" for r in rows)
    rows = langid.langid(docs).collect()
    assert len(rows) == len(ROWS) and {r.lang_pred for r in rows if r.doc_id in (3, 4, 7)} == {"und"} and all(r.node == "own" for r in rows)


def test_personal_data(docs):
    more = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.concat("text", F.lit(" a@b.org 10.0.0.1"))).otherwise(F.col("text")))
    rows = pii.detect(more).collect()
    assert sorted(len(r.spans) for r in rows) == [0] * 8 + [2] and all(r.kept == "own" for r in rows)
    assert [r.text[-12:] for r in pii.redact(more).where("doc_id = 1").collect()] == ["<EMAIL> <IP>"]


def test_urls(spark):
    html = "<p>" + "x " * 500_000 + '<link rel="canonical" href="http://a.net/es/1">'
    rows = spark.createDataFrame([(1, "http://q.org/a", html), (2, "http://q.org/a/" + "b" * 100_000, None), (3, None, html), (1, "http://q.org/a", html), (4, "http://a.net/es/1", "")], "page_id long, url string, html string")
    rows = urls.judge(rows.select("*", *(F.lit("own").alias(c) for c in CLASH if c not in ("alias", "verdict", "rule")))).collect()
    assert sorted((r.page_id, r.verdict) for r in rows) == [(1, "block"), (1, "block"), (2, "allow"), (3, "allow"), (4, "block")] and all(r.node == "own" for r in rows)


def test_links_that_are_no_markup(spark):
    link = '<link rel="alternate canonical" href="http://a.net/es/1">'
    hidden = [f"<!-- {link} -->", f"<script>{link}</script>", f"<textarea>{link}", f"<STYLE x>{link}</style >", link.replace("alternate canonical", "canonical-ish")]
    shown = [link, f"<!-- a -->{link}<!-- b", link.replace('"alternate canonical"', "canonical"), link.replace('"alternate canonical"', "'canonical next'")]
    rows = [(i, f"http://q{i}.org/a", x) for i, x in enumerate(hidden + shown)] + [(len(hidden + shown), "http://a.net/es/1", None)]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id for r in found if r.verdict == "block"} == set(range(len(hidden), len(rows)))


def test_passages_repeated_rows(spark):
    """An id that has most rows is one document, and its rows are one key each; an empty table gives none."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.range(20_000).selectExpr("if(id < 19998, 7, id) as doc_id", f"if(id = 19999, 'other', '{text}') as text")
    assert sorted(map(tuple, suffix.repeated_passages(rows).collect())) == [(7, 0, 60), (19998, 0, 60)]
    assert suffix.repeated_passages(rows.limit(0)).count() == 0


def test_vectors(spark):
    x = np.random.default_rng(1).normal(size=(40, 8)).round(3).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(0, x[0]), (50, x[1]), (51, None), (None, x[2]), (52, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit("own").alias(c) for c in CLASH))
    got = covertree.near_vectors(df).collect()
    assert len(got) == len(rows) and {(r.component_id, r.kept) for r in got if r.vec_id == 50} == {(1, False)}
    near = ann.nearest(df, F.col("vec_id") % 10 == 0).collect()
    first = {r.query_id: r.vec_id for r in near if r["rank"] == 1}
    assert set(first) == {0, 10, 20, 30, 50} and first[50] == 1
    assert all(r.vec_id != r.query_id for r in near)
