"""Token alignment against a plain version that tokenises whole texts and compares all pairs of tokens."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeq.llm import align
from treeq.llm.queries import op13_token_alignment


@pytest.fixture(scope="module")
def both():
    with open(align.BYTE_LEVEL, encoding="utf-8") as f, open(align.PIECES, "rb") as g:
        return align.Tokenizers(f.read(), g.read())


def spans(ids, names):
    ends = np.cumsum([0] + [len(names[i]) for i in ids]).tolist()
    return list(zip(ids, ends, ends[1:]))


def plain(both, rows):
    """Whole texts tokenised at once, all pairs of their tokens compared."""
    each, counts = [], Counter()
    for i, text in rows:
        a = spans(both.a.encode(" " + text, add_special_tokens=False).ids, both.a_bytes) if text else []
        b = spans(both.b.encode(text), both.b_bytes) if text else []
        whole = (" " + (text or "")).encode()
        if any(b"".join(names[i] for i, *_ in x) != whole for x, names in ((a, both.a_bytes), (b, both.b_bytes))):
            a = b = []
        links = [(x, y) for x, lo, hi in a for y, at, to in b if lo < to and at < hi]
        counts.update(links)
        groups, lo = [], 0
        for hi in sorted({e for *_, e in a} & {e for *_, e in b}):
            groups.append("|".join(",".join(str(x) for x, _, e in side if lo < e <= hi) for side in (a, b)))
            lo = hi
        each.append((i, a, b, groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return Counter(
        (i, len(a), len(b), len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), ";".join(g)) for i, a, b, g, x in each
    )


ODD = [
    (1, "Hello  world <s> naïve ﬁ"), (2, None), (3, ""), (4, " "), (5, "a ▁b"), (6, "x  y 　 z  \n\n q 日本語 テキスト   e  f   g"),
    (7, "<|endoftext|> </s> a\x00b"), (7, "the the the"), (None, "the cat"), (9, "  lead and trail  "), (10, "👩‍👩‍👧 emoji é è é ok"),
    (11, "don't we'll 12,345.67 \t tab\r\nnew"), (12, "the the the"), (12, "the the the"), (13, "a" * 300 + " \u0085 b"),
]


def test_against_plain(spark, both, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = ODD + [(100 + r.doc_id, r.text[:1200]) for r in docs.where("doc_id < 60").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.select("*", *(F.lit("own").alias(c) for c in ("block", "pieces", "docs", "n", "at", "pair", "best", "count", "groups")))
    assert Counter(map(tuple, align.align(df).collect())) == plain(both, rows)


def test_rare_pairs_are_joined_too(spark, both, monkeypatch):
    monkeypatch.setattr(align, "HOT", 3)
    rows = [(1, "the cat sat on the mat"), (2, "the the the the unusually rare wordings"), (3, "cat")]
    assert Counter(map(tuple, align.align(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == plain(both, rows)


def test_cuts_change_no_token(both):
    """Pieces apart have the tokens of the text as a whole."""
    for _, text in ODD:
        if not text:
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends = align.piece_edges(data, np.array([0, len(data)]))
        pieces = [bytes(data[s:e]).decode() for s, e in zip(starts, ends)]
        assert " ".join(pieces) == text
        apart = [both.a.encode(" " + p, add_special_tokens=False).ids for p in pieces]
        assert sum(apart, []) == both.a.encode(" " + text, add_special_tokens=False).ids
        assert sum((both.b.encode(p) for p in pieces), []) == both.b.encode(text)


def test_new_pieces_are_tokenised_together(both):
    """A tokenizer is called with many pieces as one text; pieces that can't be read so have the tokens they have alone."""
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, 0

        def __getattr__(self, name):
            def call(texts, **how):
                self.texts += len(texts)
                return getattr(self.tokenizer, name)(texts, **how)

            return call

    a, b = both.a, both.b
    plain_words = [f"w{i * 7919 % 30011}".encode() for i in range(2000)]
    odd = [t.encode() for t in ("ﬁ", " x", "x ", "é", "日本語", "\u00a0y", "a  b", "…")]
    try:
        both.forget()
        both.a, both.b = Counted(a), Counted(b)
        both.number(plain_words)
        assert both.a.texts < 100 and both.b.texts < 100
        number = both.number(odd + plain_words)
    finally:
        both.a, both.b = a, b
    pieces = odd + plain_words
    assert len(both.good) == len(pieces) and len(np.unique(number)) == len(pieces)
    text, links = ([x for part in parts for x in part.to_pylist()] for parts in (both.groups, both.links))
    one = lambda p: plain(both, [(0, p.decode())]).most_common(1)[0][0]
    for p, i in list(zip(pieces, number))[:60]:
        _, n_a, n_b, n_groups, n_links, *_, groups = one(p)
        assert (*both.sizes[:, i], len(links[i]), text[i]) == (n_a, n_b, n_groups, n_links, groups)
        assert both.good[i] == (n_a > 0)


def test_empty_and_long(spark, both):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(none).count() == 0
    long = " ".join(f"w{i * 7919 % 30011}" for i in range(200_000)) + "x" * 100_000
    row = align.align(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    ids = both.a.encode(" " + long, add_special_tokens=False).ids
    assert row.n_a == len(ids) and row.n_links == row.n_a + row.n_b - row.n_groups


def test_query(spark, small):
    df = op13_token_alignment(spark, small)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(len(r.groups_sha256) == (64 if r.n_a else 0) for r in rows)
