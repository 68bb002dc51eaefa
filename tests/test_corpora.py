"""Corpora written in order, rules in sequence, words that a search hit consists of."""

import glob

import pytest
from pyspark.sql import functions as F

from treeq.functions import conditions as c
from treeq.functions import text as tx
from treeq.functions import values as v
from treeq.operators import edit, search
from treeq.sources import conllu


def corpus(spark, sizes):
    blocks = [(f"# sent_id = {s}-{i}\n# text = t\n# note {i}\n1\tw{i}\t_\tX\t_\t_\t0\troot\t_\t_\n", s, i) for s, n in sizes.items() for i in range(n)]
    return conllu.parse(spark.createDataFrame(blocks, "value string, source string, sent_no long"))


def test_ordered_corpora(spark, tmp_path):
    """Read, shuffle, write, read gives the same sources and order; a large source is several files, which follow each other by name."""
    sizes = {"big/file one.conllu": 900, "b=2": 40, "c": 1}
    sents = corpus(spark, sizes).orderBy(F.xxhash64("sent_id"))
    conllu.write_corpus(sents, str(tmp_path / "out"), per_file=200)
    back = conllu.read_corpus(spark, str(tmp_path / "out"), strict=True).select("source", "sent_no", "sent_id", "comments").collect()
    assert {(r.source, r.sent_no, r.sent_id) for r in back} == {(s, i, f"{s}-{i}") for s, n in sizes.items() for i in range(n)}
    assert all(r.comments == [f"note {r.sent_no}"] for r in back)
    folders = {f: sorted(glob.glob(f"{f}/part-*")) for f in glob.glob(str(tmp_path / "out" / "source=*"))}
    assert len(folders) == 3 and max(map(len, folders.values())) >= 3
    for files in folders.values():
        ids = [int(line.split("-")[-1]) for f in files for line in open(f) if line.startswith("# sent_id")]
        assert ids == list(range(len(ids)))


def test_empty_corpus(spark, tmp_path):
    conllu.write_corpus(corpus(spark, {"a": 1}).limit(0), str(tmp_path / "out"))
    assert not glob.glob(str(tmp_path / "out" / "source=*"))


@pytest.fixture(scope="module")
def sent(spark):
    # 1 -> 2 -> {3, 4}, 4 -> 5, 2 -> 6
    lines = ["A X 0 root", "B V 1 a", "C N 2 b", "D N 2 b", "E Z 4 c", "F N 2 d"]
    rows = [f"{i}\t{w}\t{w.lower()}\t{u}\t_\t_\t{h}\t{r}\t_\t_" for i, (w, u, h, r) in enumerate(map(str.split, lines), 1)]
    return conllu.parse(spark.createDataFrame([("\n".join(rows), 1)], "value string, k int"))


def field(df, name):
    return [w[name] for w in df.first().words]


def test_rules_in_sequence(sent):
    rule = [edit.Rule(c.prec(c.upos("V")), {"Upos": "V"})]
    assert field(edit.apply_rules(sent, rule), "upos") == ["X", "V", "V", "N", "Z", "N"]
    out = edit.apply_rules(sent, rule, sequential=True)
    assert field(out, "upos") == ["X", "V", "V", "V", "V", "V"] and out.first().changes == [4]
    # values see earlier words too, and a new head is checked against heads as they are by then
    copy = [edit.Rule(c.head(c.form(".*")), {"Lemma": v.concat(v.head("Lemma"), v.this("Form"))})]
    assert field(edit.apply_rules(sent, copy, sequential=True), "lemma") == ["a", "aB", "aBC", "aBD", "aBDE", "aBF"]
    turn = [edit.Rule(c.form("D|E"), {"HeadId": "+1"})]
    assert field(edit.apply_rules(sent, turn, sequential=True), "head") == [0, 1, 2, 2, 6, 2]
    swap = [edit.Rule(c.form("D"), {"HeadId": "6"}), edit.Rule(c.form("F"), {"HeadId": "4"})]
    assert field(edit.apply_rules(sent, swap, sequential=True), "head") == [0, 1, 2, 6, 4, 2]


def test_words_of_hits(sent):
    E = search.Example
    any_ = c.Cond(lambda t: F.lit(True))
    found = {r.id: r.ids for r in search.hits(sent, search.example_words(E(c.upos("V|X"), [E(c.upos("N")), E(any_, [E(any_)])])), "k").collect()}
    assert found == {2: [2, 3, 4, 5, 6]}
    found = {r.id: r.ids for r in search.hits(sent, search.path_words("b", ("=", "b"), ("<", "c")), "k").collect()}
    assert found == {3: [3, 4, 5]}
    found = {r.id: r.ids for r in search.hits(sent, search.path_words("c", (">", "b"), (">", "a"), ("<", "d")), "k").collect()}
    assert found == {5: [2, 4, 5, 6]}


def test_places_in_the_surface_text(spark):
    lines = ["1\tno\t_\tX\t_\t_\t0\troot\t_\tSpaceAfter=No", "2-3\tdel\t_\t_\t_\t_\t_\t_\t_\t_", "2\tde\t_\tX\t_\t_\t1\ta\t_\tSpaceAfter=No", "3\tel\t_\tX\t_\t_\t1\ta\t_\t_", "4\tano\t_\tX\t_\t_\t1\ta\t_\tSpacesAfter=\\s\\s", "5\tno\t_\tX\t_\t_\t1\ta\t_\t_"]
    df = conllu.parse(spark.createDataFrame([("\n".join(lines), 1)], "value string, k int"))
    r = df.select(tx.surface().alias("text"), tx.offsets().alias("at")).first()
    assert r.text == "nodel ano  no"
    assert [tuple(x) for x in r.at] == [(1, 0, 2), (2, 2, 5), (3, 2, 5), (4, 6, 9), (5, 11, 13)]
    assert [(x.at, x.ids) for x in search.surface_hits(df, "no", "k").collect()] == [(0, [1]), (7, [4]), (11, [5])]
    assert [(x.at, x.ids) for x in search.surface_hits(df, "od", "k").collect()] == [(1, [1, 2, 3])]
    assert search.surface_hits(df, "de el", "k").count() == 0


def test_last_comment_counts(spark, sent):
    edits = spark.createDataFrame([(1, "zzz", 1), (1, "first\nsecond", 2), (1, None, 3)], "k int, comment string, at int")
    assert edit.set_comments(sent, edits, "k", "at").first().comments == ["first", "second"]
    assert edit.set_comments(sent, edits, "k").first().comments == ["zzz"]


def test_corpora_of_several_files_with_heads(spark, small, monkeypatch):
    """A corpus of several files keeps its order, and each file has the line of columns."""
    from treeq import queries_files

    monkeypatch.setattr(queries_files, "PART", 200, raising=False)
    path = queries_files._write(spark, small, "# global.columns = ID FORM\n", ("ID", "FORM"))
    files = spark.read.text(path, wholetext=True).collect()
    assert len(files) > 8 and all(f.value.startswith("# global.columns = ID FORM\n") for f in files)
    rows = conllu.parse(queries_files._text(spark, path), conllu.plus_columns(spark, path)).selectExpr("file", "sent_no", "cast(sent_id as long) AS sent", "words[0].form AS form").orderBy("file", "sent").collect()
    want = [sum(r.file == x.file for x in rows[:i]) for i, r in enumerate(rows)]
    assert [r.sent_no for r in rows] == want and all(r.sent % 8 == r.file and r.form != "_" for r in rows)


def test_lines_of_sentences_are_made_once(spark, small, tmp_path):
    from treeq import queries

    sents = queries.blocks(spark, small, sentences=True)
    made = spark.sparkContext.accumulator(0)

    def seen(rows):
        for batch in rows:
            made.add(len(batch))
            yield batch

    narrow = sents.select("sent").mapInPandas(seen, "sent long")
    n = narrow.count()
    sents = narrow.join(sents, "sent")
    made.value = 0
    conllu.write_corpus(sents.withColumn("source", F.lit("a")), str(tmp_path / "out"), position="sent", per_file=500)
    assert made.value == n
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
