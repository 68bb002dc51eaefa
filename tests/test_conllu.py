"""Reading, writing and converting CoNLL-U on a small corpus of our own."""

from pyspark.sql import functions as F

from treeq.functions import conditions as c
from treeq.functions.text import surface
from treeq.operators import corpus, edit, grew, trees
from treeq.sources import conllu, sdparse
from treeq.streaming import corpus as stream

CORPUS = """# newdoc id = d1
# sent_id = s1
# text = Du pain rassis.
# text_en = Stale bread.
# a free comment
1-2\tDu\t_\t_\t_\t_\t_\t_\t_\t_
1\tDe\tde\tADP\tP\t_\t3\tcase\t3:case\t_
2\tle\tle\tDET\tD\tGender=Masc|Definite=Def\t3\tdet\t3:det\t_
3\tpain\tpain\tNOUN\tN\tGender=Masc|gender=Fem\t0\troot\t0:root\tGloss=bread|Flag
3.1\tx\tx\tVERB\tV\t_\t_\t_\t3:dep\t_
4\trassis\trassis\tADJ\tA\tGender=Masc\t3\tamod\t3:amod|3.1:obl:de\tSpaceAfter=No
5\t.\t.\tPUNCT\tP\t_\t3\tpunct\t3:punct\t_

# newdoc
# sent_id = s2
# text = A b C d
1\tA\ta\tX\tx\t_\t3\ta\t_\t_
2\tb\tb\tX\tx\t_\t4\tb\t_\t_
3\tC\tc\tX\tx\t_\t0\troot\t_\t_
4\td\td\tX\tx\t_\t3\td\t_\tSpacesAfter=\\s\\t

# sent_id = s3
1\t12#345\tn\tNUM\t_\t_\t1\troot\t_\t_
2\tshort\trow
"""


def test_read(spark):
    rows = {r.sent_id: r for r in conllu.parse(conllu.from_strings(spark, [CORPUS.replace("\n", "\r\n")])).withColumn("surface", surface()).collect()}
    a = rows["s1"]
    assert (a.newdoc, a.newpar, a.translations, a.comments) == ("d1", None, {"en": "Stale bread."}, ["a free comment"])
    assert [w.form for w in a.words] == ["De", "le", "pain", "rassis", "."] and a.surface == "Du pain rassis."
    assert a.words[2].feats == {"gender": "Fem"}  # the later of two names wins, whatever their case
    assert [(m.key, m.val) for m in a.words[2].misc] == [("Gloss", "bread"), ("Flag", None)]
    assert [(e.id, e.subid) for e in a.empties] == [(3, 1)] and [(m.id, m.subid) for m in a.mwts] == [(1, 2)]
    assert [(d.headid, d.headsubid, d.deprel) for d in a.words[3].deps] == [(3, -1, "amod"), (3, 1, "obl:de")]
    assert rows["s2"].newdoc == "" and rows["s2"].errors == [] and rows["s2"].words[3].misc[0].val == r"\s\t"
    assert rows["s3"].words[0].form == "12#345" and len(rows["s3"].errors) == 2


def test_round_trip(spark, tmp_path):
    sents = conllu.parse(conllu.from_strings(spark, [CORPUS])).where("size(errors) = 0")
    conllu.write_conllu(sents, str(tmp_path / "out"))
    again = conllu.read_conllu(spark, str(tmp_path / "out"))
    plain = lambda df: sorted(r.value for r in df.select(conllu.block().alias("value")).collect())
    assert plain(again) == plain(sents) and len(plain(again)) == 2


def test_plus_columns(spark, tmp_path):
    (tmp_path / "a.conllup").write_text("# global.columns = ID FORM UPOS SEM:NE\n# sent_id = p\n1\tAnn\tPROPN\tPER|B\n2\truns\tVERB\t_\n\n")
    r = conllu.read_conllu_plus(spark, str(tmp_path / "a.conllup")).first()
    assert [w.extra["SEM:NE"] for w in r.words] == [["PER", "B"], []] and r.words[0].upos == "PROPN"
    out = conllu.convert_columns(spark.createDataFrame([("# c\n1\tAnn\tPROPN",)], "value string"), ("ID", "FORM", "UPOS"), ("FORM", "XPOS", "ID")).first().value
    assert out == "# c\nAnn\t_\t1"


def test_trees_and_patterns(spark):
    sents = conllu.parse(conllu.from_strings(spark, [CORPUS])).where("sent_id in ('s1', 's2')")
    assert [r.sent_id for r in sents.where(trees.is_projective()).collect()] == ["s1", "s2"]  # arcs of length two don't count
    found = c.tokens_where(sents, c.head(c.upos("NOUN")) & ~c.next_(c.upos("NOUN")), "sent_id").select("form").collect()
    assert {r.form for r in found} == {"De", "rassis", "."}
    p = grew.Pattern({"N": c.upos("NOUN")}, [("N", "A", ["amod"]), ("N", "D", ["det"])], order=[("D", "N", True)])
    assert [list(r.ids) for r in grew.match(sents, p, "sent_id").collect()] == [[2, 3, 4]]


def test_sdparse_reads_each_line_once(spark):
    df = sdparse.parse(spark.createDataFrame([("a b\nr(b-2, a-1)",)], "value string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value") == 1 and plan.count("[^\\s(]+") <= 2


def test_sdparse(spark):
    r = sdparse.parse(spark.createDataFrame([("the/DET dog barks\ndet(dog-2, the-1)\nnsubj(barks, dog)",), ("a b\nr(z-9, a-1)",)], "value string")).collect()
    assert [(w.form, w.upos, w.head, w.deprel) for w in r[0].words] == [("the", "DET", 2, "det"), ("dog", "_", 3, "nsubj"), ("barks", "_", 0, "root")]
    assert r[0].errors == [] and r[1].errors == ["unknown word"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.conllu").write_text(CORPUS)
    sents = stream.read_stream(spark, str(tmp_path / "in"))
    q = stream.running_counts(sents).writeStream.format("memory").outputMode("complete").queryName("tags").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.upos: r.n for r in spark.sql("select * from tags").collect()}["X"] == 4


def test_stream_windows(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{small}/events*.parquet")
    q = stream.windowed_counts(events, "ts", "event_type").writeStream.format("memory").outputMode("update").queryName("win").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    whole = spark.read.parquet(f"{small}/events.parquet").groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert spark.sql("select sum(n) from win").first()[0] == whole.agg(F.sum("count")).first()[0]


def test_line_ends_and_numbers(spark, tmp_path):
    two = "# sent_id = a\n1\tA\ta\tX\t_\t_\t0\troot\t_\t_\n2\tB\tb\tX\t_\t_\t1\tdep\t_\t_\n\n# only a comment\n\n  \n# sent_id = b\n1\tC\tc\tX\t_\t_\t0\troot\t_\t_\n\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/lf.conllu").write_bytes((two * 3).encode())
    (tmp_path / "in/crlf.conllu").write_bytes((two * 2).replace("\n", "\r\n").encode())
    for crlf in (False, True):  # right either way
        path = str(tmp_path / "in" / ("crlf.conllu" if crlf else "*.conllu"))
        rows = conllu.read_conllu(spark, path, numbered=True, crlf=crlf).collect()
        got = {}
        for r in rows:
            assert r.errors == [] and len(r.words) == (2 if r.sent_id == "a" else 1) and "\r" not in r.words[-1].deprel
            got.setdefault(r.source.rsplit("/", 1)[1], []).append((r.sent_no, r.sent_id))
        assert sorted(got.pop("crlf.conllu")) == [(i, "ab"[i % 2]) for i in range(4)]
        assert not got or sorted(got.pop("lf.conllu")) == [(i, "ab"[i % 2]) for i in range(6)]


def test_numbers_over_splits(spark, tmp_path):
    """Files that are read in many parts, by partitions that hold several parts."""
    for f in range(3):
        (tmp_path / f"{f}.conllu").write_text("".join(f"# sent_id = {f}-{i}\n1\t{'x' * (i % 50)}w\t_\t_\t_\t_\t0\troot\t_\t_\n\n" for i in range(300 + 100 * f)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = conllu.read_conllu(spark, str(tmp_path), numbered=True).select("sent_no", "sent_id").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 1200 and all(r.sent_id.split("-")[1] == str(r.sent_no) for r in rows)


def test_twice_and_relaxed(spark):
    text = "# text_en = one\n# text_en = two\n# text = a\n# text = b\n1\tA\t\tX\tNON-VU\t_\t1\troot\t_\t_\n2\tB\tb\tX\ty\t_\t1\tdep\t1:dep|3:x\t_\n3\tC\tc\tX\ty\t_\t2\tdep\t_\t_\n"
    r = conllu.parse(conllu.from_strings(spark, [text])).first()
    assert r.translations == {"en": "two"} and r.text == "b" and len(r.errors) == 3 and len(r.words) == 3
    r = conllu.parse(conllu.from_strings(spark, [text]), relaxed=True).first()
    assert len(r.errors) == 2 and (r.words[0].lemma, r.words[0].head) == ("_", 0)
    r = conllu.parse(conllu.from_strings(spark, [text]), relaxed=True, drop_xpos="NON-VU").first()  # the others are numbered anew
    assert [(w.id, w.form, w.head, [(d.headid, d.deprel) for d in w.deps]) for w in r.words] == [(1, "B", 0, [(2, "x")]), (2, "C", 1, [])]


MIXED = """# sent_id = m
# text = ab c d
1-2\tab\t_\t_\t_\t_\t_\t_\t_\t_
1\ta\ta\tX\t_\t_\t2\tdep\t2:dep|3.1:x\t_
2\tb\tb\tX\t_\t_\t0\troot\t0:root\t_
3\tc\tc\tX\t_\t_\t2\tdep\t2:dep|1:y\t_
3.1\te\te\tX\t_\t_\t_\t_\t1:z\t_
3.2\tf\tf\tX\t_\t_\t_\t_\t3.1:q\t_
4\td\td\tX\t_\t_\t3\tdep\t3.2:w\t_
"""


def shape(df):
    r = df.first()
    edges = lambda t: [f"{d.headid}.{d.headsubid}:{d.deprel}" if d.headsubid >= 0 else f"{d.headid}:{d.deprel}" for d in t.deps]
    return [(w.id, w.form, w.head, edges(w)) for w in r.words], [(m.id, m.subid, m.form) for m in r.mwts], [(e.id, e.subid, e.form, edges(e)) for e in r.empties]


def test_everything_follows_the_words(spark):
    sents = conllu.parse(conllu.from_strings(spark, [MIXED]))
    words, mwts, empties = shape(edit.insert_word(sents, 0, "new"))
    assert words == [(1, "new", 2, []), (2, "a", 3, ["3:dep", "4.1:x"]), (3, "b", 0, ["0:root"]), (4, "c", 3, ["3:dep", "2:y"]), (5, "d", 4, ["4.2:w"])]
    assert mwts == [(2, 3, "ab")] and empties == [(4, 1, "e", ["2:z"]), (4, 2, "f", ["4.1:q"])]
    words, mwts, empties = shape(edit.delete_word(sents, 1))
    assert words == [(1, "b", 0, ["0:root"]), (2, "c", 1, ["1:dep"]), (3, "d", 2, ["2.2:w"])] and mwts == [] and empties == [(2, 1, "e", []), (2, 2, "f", ["2.1:q"])]
    words, mwts, empties = shape(edit.delete_word(sents, 3))  # empty words stay behind what is left
    assert words[-1] == (3, "d", 2, ["2.2:w"]) and mwts == [(1, 2, "ab")] and [e[:2] for e in empties] == [(2, 1), (2, 2)]
    words, mwts, _ = shape(edit.insert_word(sents, 1, "mid"))
    assert [w[1] for w in words] == ["a", "mid", "b", "c", "d"] and mwts == [(1, 3, "ab")]
    words, mwts, empties = shape(edit.join_words(sents, 3))
    assert words[-1] == (3, "cd", 2, ["2:dep", "1:y"]) and [e[:2] for e in empties] == [(3, 1), (3, 2)] and mwts == [(1, 2, "ab")]
    words, mwts, empties = shape(edit.split_word(conllu.parse(conllu.from_strings(spark, [MIXED.replace("\tb\tb\t", "\tbb\tbb\t")])), 2, 1))
    assert [w[:3] for w in words] == [(1, "a", 2), (2, "b", 0), (3, "b", 2), (4, "c", 2), (5, "d", 4)] and mwts == [(1, 3, "ab")] and [e[:2] for e in empties] == [(4, 1), (4, 2)]
    words, mwts, _ = shape(edit.split_to_mwt(sents, 3, ["x", "y"]))
    assert [w[:3] for w in words] == [(1, "a", 2), (2, "b", 0), (3, "x", 2), (4, "y", 3), (5, "d", 3)] and mwts == [(1, 2, "ab"), (3, 4, "c")]
    assert shape(edit.split_to_mwt(sents, 2, ["x", "y"])) == shape(sents)  # a multiword token covers it


def test_split_and_join_sentences(spark):
    sents = conllu.parse(conllu.from_strings(spark, [MIXED]))
    first, second = (edit.split_sentence(sents, 2).where(f"part = {p}") for p in (1, 2))
    assert shape(first) == ([(1, "a", 2, ["2:dep"]), (2, "b", 0, ["0:root"])], [(1, 2, "ab")], []) and first.first().text == "ab"
    assert shape(second) == ([(1, "c", 0, []), (2, "d", 1, ["1.2:w"])], [], [(1, 1, "e", []), (1, 2, "f", ["1.1:q"])])
    assert (second.first().text, second.first().sent_id) == ("c d", "m-bis")
    both = conllu.parse(conllu.from_strings(spark, [MIXED + "\n" + MIXED.replace("1-2\tab", "0.1\tz\tz\tX\t_\t_\t_\t_\t2:k\t_\n1-2\tab").replace("3.1:x", "0.1:x")]))
    words, mwts, empties = shape(corpus.merged(both, "source", "sent_no"))
    assert words[4] == (5, "a", 6, ["6:dep", "4.1:x"]) and words[7] == (8, "d", 7, ["7.2:w"]) and mwts == [(1, 2, "ab"), (5, 6, "ab")]
    assert [e[:3] for e in empties] == [(3, 1, "e"), (3, 2, "f"), (4, 1, "z"), (7, 1, "e"), (7, 2, "f")] and empties[3][3] == ["5:z"]
    rows = corpus.merged_tokens(both, "source", "sent_no").where("kind = 'WORD'").orderBy("id").collect()
    assert [(r.id, r.form, r["head"]) for r in rows] == [w[:3] for w in words]


def test_edits_of_one_word_and_version(spark):
    sents = spark.createDataFrame([(1, [(1, "a"), (2, "b")]), (2, None)], "k int, words array<struct<id:int,form:string>>")
    edits = spark.createDataFrame([(1, 1, "x", 1), (1, 1, "y", 2), (1, 2, None, 1), (9, 1, "z", 1)], "k int, id int, value string, at int")
    assert [[w.form for w in r.words or []] for r in edit.edit_fields(sents, edits, "k", "form", order="at").orderBy("k").collect()] == [["y", "b"], []]
    now = spark.createDataFrame([(1, 3, "v"), (2, 1, "v")], "k int, version int, value string")
    asked = spark.createDataFrame([(1, 3, "b"), (1, 3, "a"), (1, 2, "old"), (2, 0, "old")], now.schema)
    assert sorted(map(tuple, edit.merge_if_current(now, asked, "k", "version", "value").collect())) == [(1, 4, "a", 2), (2, 1, "v", 1)]


def test_running_sums(spark):
    rows = spark.range(1000).selectExpr("id", "id % 3 AS g", "id % 7 AS n")
    got = {r.id: r.s for r in corpus.running(rows, "g", "id", F.col("n"), "s", chunk=64).collect()}
    assert got == {i: sum(j % 7 for j in range(i % 3, i, 3)) for i in range(1000)}


def test_ids_heads_and_thousands(spark):
    line = "{}\t{}\t_\tX\t_\t_\t{}\tdep\t_\t_"
    texts = {"fine": [(1, "a", 2), (2, "b", 0)], "holes": [(3, "a", 4), (4, "b", 0)], "order": [(2, "a", 0), (1, "b", 2)], "head": [(1, "a", 3), (2, "1#000", 0)]}
    rows = [(k, "\n".join(line.format(*w) for w in ws)) for k, ws in texts.items()]
    blocks = spark.createDataFrame(rows, "k string, value string")
    got = {r.k: r for r in conllu.parse(blocks).collect()}
    ids, out = "word ids are not 1, 2, ... in order", "a head is outside the sentence"
    assert {k: r.errors for k, r in got.items()} == {"fine": [], "holes": [ids, out], "order": [ids], "head": [out]}
    assert got["head"].words[1].form == "1#000"
    assert {r.k: r.words[1].form for r in conllu.parse(blocks, thousands=True).collect()}["head"] == "1000"
