"""Quality, language, personal data: held-out accuracy, exactness of the parts, and odd inputs."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeq.llm import langid, pii, quality, queries
from treeq.llm.common import gram_hashes, span_hashes, text_steps, words

ODD = [(1, None, "en", "a", 7), (2, "", None, None, None), (3, "…", "en", "a", 1), (None, "mail ann@x.org or +1 (275) 555-2469", "en", None, 2), (4, "word " * 30000, "de", "b", 3), (5, "hello", "en", "a", 1), (5, "hello", "en", "a", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_words_and_hashes():
    texts = pa.array(["Ab  c", None, "", " x\ty ", "c Ab"])
    ((lo, hi, data, offs),) = text_steps(texts)
    s, e, d = words(data, offs)
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True)] == ["Ab", "c", "x", "y", "c", "Ab"] and d.tolist() == [0, 0, 3, 3, 4, 4]
    h = span_hashes(data, s, e)
    assert h[0] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 4
    g = gram_hashes(np.concatenate([h[:2], h[:2]]), 2)
    assert g[0] == g[2] != g[1]
    assert [x[:2] for x in text_steps(pa.array(["aaaa"] * 5), limit=8)] == [(0, 2), (2, 4), (4, 5)]


def test_quality(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    got = queries.op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 80 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_quality_gradient():
    net = quality.Net(1)
    texts = [b"some text here that is long enough " * 9, b"!!AB!! " * 40]
    data, offs, y, w = np.frombuffer(b"".join(texts), np.uint8), np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])]), np.array([1.0, 0.0]), np.ones(2)
    for name in ("near", "hid", "emb"):
        loss = lambda n: -(y * np.log(n.forward(data, offs)) + (1 - y) * np.log(1 - n.forward(data, offs))).mean()
        before, base = net.w[name].copy(), loss(net)
        net.step(data, offs, y, w, 1e-3)
        assert loss(net) < base
        net.w[name][:] = before


def naive_score(net, raw):
    """The forward pass byte by byte, as the module's text describes it."""
    w, block, tap = {k: v.astype(float) for k, v in net.w.items()}, quality.BLOCK, quality.TAP
    n = max(1, -(-len(raw) // block))
    data = [0] * block + list(raw) + [0] * (n * block - len(raw)) + [0] * block
    blocks = []
    for b in range(1, n + 1):
        filters = np.zeros(quality.FILTERS)
        for t in range(b * block, (b + 1) * block, tap):
            z = w["fb"].copy()
            for name, at in (("near", t), ("next", t + tap)):
                z += np.concatenate([w["emb"][data[i]] for i in range(at, at + tap)]) @ w[name]
            filters += np.maximum(z, 0) / (block // tap)
        share = [np.mean([i >= lag and data[i] == data[i - lag] for i in range(b * block, (b + 1) * block)]) for lag in quality.LAGS]
        blocks.append(np.concatenate([filters, [max(share), np.mean(share)]]))
    units = []
    for c in range(max(1, -(-(n - quality.CHUNK) // quality.STRIDE) + 1)):
        units.append(np.tanh(np.mean(blocks[c * quality.STRIDE : c * quality.STRIDE + quality.CHUNK], 0) @ w["hid"] + w["hb"]))
    return 1 / (1 + np.exp(-(np.max(units, 0) @ w["out"] + w["ob"][0])))


def test_quality_forward():
    net, rng = quality.Net(3), np.random.default_rng(2)
    net.w["fb"][:] = rng.normal(size=quality.FILTERS) * 0.1
    raw = [bytes(rng.integers(97, 103, n).tolist()) for n in (0, 1, 63, 64, 65, 300, 1000, 1700)]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    want = [naive_score(net, x) for x in raw]
    assert np.allclose(net.forward(data, offs), want, atol=1e-5)
    for size in (2, 4, 16):  # slices of a text
        assert np.allclose([net.long(np.frombuffer(x, np.uint8), size) for x in raw], want, atol=1e-5)


def test_quality_keeps_columns(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality(odd, labels, score_as="p", predicted_as="good").collect()
    assert sorted(str(r.score) for r in rows) == sorted(str(x[4]) for x in ODD) and all(0 <= r.p <= 1 for r in rows)


def test_excerpts(spark):
    text = "".join(chr(97 + i // 100 % 26) for i in range(40_000))
    docs = spark.createDataFrame([(1, text, "en"), (2, "short", "de"), (3, None, "de")], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    for rows in (quality.labelled(docs, labels), langid.labelled(docs)):
        for r in rows.collect():
            assert len(r.text) <= 2 * quality.FIT_CHARS and (r.text == "short" if r.doc_id == 2 else r.text.startswith(text[:99]) and r.text.endswith(text[-99:]))


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert quality.quality(odd.limit(0), labels).count() == 0


def test_forward_backward():
    f, rng = langid.Field(["a", "b", "c"]), np.random.default_rng(0)
    f.move, f.first = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores, begins = rng.normal(size=(400, 3)), rng.random(400) < 0.02
    begins[0] = True
    got, e, t = f.posteriors(scores, begins), np.exp(scores), np.exp(f.move)
    edges = [*np.flatnonzero(begins), 400]
    for a, b in zip(edges, edges[1:], strict=False):
        fw, bw = [np.exp(f.first) * e[a]], [np.ones(3)]
        for i in range(a + 1, b):
            x = (fw[-1] @ t) * e[i]
            fw.append(x / x.sum())
        for i in range(b - 1, a, -1):
            x = t @ (e[i] * bw[-1])
            bw.append(x / x.sum())
        want = np.array(fw) * np.array(bw[::-1])
        assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


def test_long_text_in_stretches():
    f = langid.fit(["the cat and the dog with this"] * 40 + ["der hund und die katze nicht"] * 40, ["en"] * 40 + ["de"] * 40)
    rng = np.random.default_rng(1)
    for text in (" ".join(rng.choice("the cat der hund und 12 -- über nicht".split(), 700)), "12 " * 300 + "the dog" + " 7" * 400, "x" * 2000, "", "1 2"):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _, want = langid.label_words(f, data, np.array([0, len(data)]))
        if text != "x" * 2000:
            parts = list(langid.label_long(f, data, 128))
            assert np.allclose(np.concatenate([np.zeros((0, 2)), *(x[2] for x in parts)]), want, atol=1e-5)
            assert sum((x[0].tolist() for x in parts), []) == starts.tolist() and sum((x[1].tolist() for x in parts), []) == ends.tolist()
        else:
            assert sum(len(x[0]) for x in langid.label_long(f, data, 128)) == 16  # a word of more than a stretch is cut


def test_long_text_means(monkeypatch):
    f = langid.fit(["the cat and the dog with this"] * 40 + ["der hund und die katze nicht"] * 40, ["en"] * 40 + ["de"] * 40)
    data = np.frombuffer(("the dog und der hund " * 90).encode(), np.uint8)
    whole = langid._means(f, data, np.array([0, len(data)]))
    monkeypatch.setattr(langid, "SLICE", 100)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole, langid._means(f, data, np.array([0, len(data)])), strict=True))


def test_language(spark, small):
    d = small.replace("sf0.001", "sf0.01")
    got = queries.op9_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def test_code_switching():
    f = langid.fit(["the cat and the dog with this"] * 40 + ["der hund und die katze nicht"] * 40, ["en"] * 40 + ["de"] * 40)
    ((_, _, data, offs),) = text_steps(pa.array(["the dog and und die katze"]), lower=True)
    p = langid.label_words(f, data, offs)[3]
    assert [f.langs[i] for i in p.argmax(1)] == ["en"] * 3 + ["de"] * 3


def test_language_odd(spark, odd):
    rows = langid.langid(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows if r.doc_id in (1, 2, 3)}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))
    assert langid.langid(odd.limit(0)).count() == 0


def test_fitted_rows_are_bounded(spark):
    docs = spark.range(900).selectExpr("if(id < 300, 7, id) AS doc_id", "concat('text ', id) AS text", "if(id % 2 = 0, 'en', 'de') AS lang")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")
    for rows, limit in ((quality.labelled(docs, labels, 1000), 1000), (quality.labelled(docs, labels, 50), 50), (langid.labelled(docs, 1000), 1000), (langid.labelled(docs, 50), 50)):
        got = rows.collect()
        assert 0 < len(got) == len({r.doc_id for r in got}) <= limit
        assert sorted(map(str, got)) == sorted(map(str, rows.collect()))
    texts = {r.doc_id: (r.text, r.lang) for r in langid.labelled(docs, 1000).collect()}
    assert all(lang == ("en" if int(t.split()[1]) % 2 == 0 else "de") for t, lang in texts.values())


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_patterns(spark, small):
    rng = np.random.default_rng(4)
    for _ in range(4000):
        text = "".join(rng.choice(list("ab@@..1234567890-- +()%é"), rng.integers(0, 40)))
        assert pii.base_spans(text) == brute(text), text
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op5_pii(spark, small).collect():
        want = brute(docs[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in PATTERNS]
        assert not want or set(line.split(",")) <= set(r.spans.split(","))


@pytest.fixture(scope="module")
def texts(spark, small):
    return spark.read.parquet(f"{small.replace('sf0.001', 'sf0.1')}/documents.parquet").select("text")


@pytest.fixture(scope="module")
def model(texts):
    return pii.fit(texts)


def test_model_is_calibrated(texts, model):
    """Thresholds come from held-out documents, without a floor; the spans added to documents are right."""
    assert all(0 < c <= 1 for c in model.cut) and len(set(model.cut)) == len(pii.KINDS)
    base, added = 0, []
    for (t,) in texts.where("text is not null").collect():
        for k, s, e, _, is_base in pii.spans(t, model):
            base += is_base
            if not is_base:
                added.append((k, t[s:e]))
    assert base > 600 and added
    right = [pii.luhn(re.sub("[^0-9]", "", x)) if k == "card" else bool(re.fullmatch(r"(\+\d )?\(\d{3}\) 555-\d{4}", x)) for k, x in added]
    assert np.mean(right) >= 0.9, added


def test_selection(texts, model):
    """Against trying all candidates one by one."""
    for text in ("a 212-555-1234 / (212) 555-9876, 4845 1681 1440 7329 x.y (at) mail (dot) com +1 (826) 555-4081 190.137.223.204 or 2021-03-04", *[r.text for r in texts.where("text rlike '[0-9]{4}'").limit(60).collect()]):
        base, chosen = pii.base_spans(text), []
        free = [c for c in pii.candidates(text) if not any(c[1] < e and c[2] > s for _, s, e in base)]
        scored = [(float(model.score(text, [c])[0]), c) for c in free]
        for p, c in sorted(scored, key=lambda x: (-x[0], x[1][1], -x[1][2], x[1][0])):
            if p >= model.cut[pii.KINDS.index(c[0])] and not any(c[1] < e and c[2] > s for _, s, e in chosen):
                chosen.append(c)
        assert sorted((k, s, e) for k, s, e, *_ in pii.spans(text, model)) == sorted([*base, *chosen])


def test_no_examples(spark):
    model = pii.fit(spark.createDataFrame([("call 212-555-1234",), (None,)], "text string"))
    assert pii.spans("call 212-555-1234, a@b.org", model) == [("email", 19, 26, 1.0, True)]


def test_pages_of_digits(model):
    import time

    began = time.time()
    for text in ("1" * 1_000_000, "1." * 200_000, "+1" * 200_000, "a@b." * 50_000, "4111111111111111 " * 3000):
        pii.spans(text, model)
    assert time.time() - began < 30


def test_long_chains(model):
    """Time grows with the text: a chain of labels is proposed up to the length of a domain name, and a number by its digits, in any groups."""
    import time

    began = time.time()
    for text in ("x @ " + "ab." * 400_000, "x @ " + "com " * 400_000, "y" * 1_000_000 + " (at) a.b.c.d.com", "x (at) b dot c " * 5000):
        pii.spans(text, model)
    assert time.time() - began < 20
    labels = ["ab"] * 84 + ["com"]  # 84 * 3 + 3 characters and one more are too long for a name
    ends = [e for _, _, e in pii.candidates("x @ " + ".".join(labels))]
    assert ends == [4 + 3 * k - 1 for k in range(2, 85)]
    card = "4.1.1.1.1.1.1.1.1.1.1.1.1.1.1.1"
    assert ("card", 0, len(card)) in pii.candidates(card)


def test_long_parts():
    local, host = "x" * 90, ".".join("abcdefgh")
    assert ("email", 0, len(local) + 5 + len(host)) in pii.candidates(f"{local} (at){host}".replace(" (at)", " (at)"))


def test_chosen_spans(model):
    found = lambda t: [(k, t[s:e], b) for k, s, e, _, b in pii.spans(t, model)]
    assert found("write to ann.lee (at) mail (dot) com now") == [("email", "ann.lee (at) mail (dot) com", False)]
    assert found("call (212) 555-1234 today")[0][:2] == ("phone", "(212) 555-1234")
    assert found("we met at home. on 2021-03-04 at page 12") == []


def test_numbers_side_by_side(model):
    text = "a 212-555-1234 /(212) 555-9876 [12] 2021-03-04"
    groups = [m.span() for m in re.finditer("[0-9]+", text)]
    want = {"ip": set(), "card": set(), "phone": set()}
    for i in range(len(groups)):
        for j in range(i, len(groups)):
            n, start = sum(e - s for s, e in groups[i : j + 1]), groups[i][0] - (text[groups[i][0] - 1] in "([+")
            for kind, lo, hi in (("ip", 4, 12), ("card", 15, 19), ("phone", 7, 15)):
                if lo <= n <= hi and (kind != "ip" or j - i == 3):
                    want[kind].add((kind, start, groups[j][1]))
    assert set(pii.candidates(text)) == set().union(*want.values()) and len(pii.candidates(text)) == sum(map(len, want.values()))

    found = lambda t: [(k, t[s:e]) for k, s, e, *_ in pii.spans(t, model)]
    two = [("phone", "212-555-1234"), ("phone", "212-555-9876")]
    assert found("212-555-1234 212-555-9876") == found("call 212-555-1234 / 212-555-9876 now") == two
    many = [f"212-555-{i:04d}" for i in range(1000, 1040)]
    for gap in (" ", " / "):
        assert found("call " + gap.join(many)) == [("phone", x) for x in many]
    assert found("call +1 (275) 555-2469 / 212-555-9876") == [("phone", "+1 (275) 555-2469"), two[1]]
    assert two[1] in found("order 12345678 212-555-9876") and two[1] in found("on 2021-03-05 212-555-9876 rang")
    assert found("on 2021-03-04 2021-03-05 2021-03-06") == []


def test_pii_odd(spark, odd):
    rows = pii.detect(odd).collect()
    assert len(rows) == len(ODD) and [len(r.spans) for r in rows if r.doc_id is None] == [2]
    out = pii.redact(odd.withColumn("n_chars", F.lit(0).cast("long"))).where("doc_id is null").first()
    assert out.text == "mail <EMAIL> or <PHONE>" and out.n_chars == len(out.text)
    assert pii.redact(odd.limit(0)).count() == 0
