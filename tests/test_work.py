"""How much queries do: sentences are made once, and nothing is worked out again for each word."""

from pyspark.sql import functions as F
from test_trees import cases, sentences

from treeq.functions import text
from treeq.operators import corpus, similar, stats, trees
from treeq.queries import QUERIES
from treeq.sources import conllu, views


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merging_makes_sentences_once(spark, small):
    """Offsets come from the sizes of sentences, not from the sentences made a second time."""
    assert plan(QUERIES["merge_all"](spark, small)).count("sort_array(") == 1


def test_merging_numbers_by_the_sentences_themselves(spark, small):
    """Offsets are sums over the words of the sentences that are merged, not over another table's counts; tables are read once and tokens keep all they have."""
    text = plan(QUERIES["merge_all"](spark, small))
    assert text.count("Relation [") == 2 and text.count("Join ") == 1
    assert "size(words#" in text and "sum(_w" in text
    tokens = corpus.merged_tokens(views.orders(spark, small, per=100), "grp", "sent", bounded=True)
    assert set(views.orders(spark, small).schema["words"].dataType.elementType.names) < set(tokens.columns)


def test_both_ways_of_merging(spark, small):
    """Groups that a task orders and groups of any size are numbered alike."""
    sents = views.orders(spark, small, per=100).where("grp % 2 = 0")
    made = [corpus.merged_tokens(sents, "grp", "sent", bounded=b).select("grp", "sent", "kind", "id", "subid", "form", "head", "deps", "misc") for b in (True, False)]
    a, b = (sorted(df.collect(), key=str) for df in made)
    assert a == b and max(r.id for r in a) > 100


def test_words_are_compared_where_sentences_lie(spark, small):
    """Both versions of the orders are dealt by their key in one exchange, and joined without another; sentences of different lengths have no differing words."""
    df = QUERIES["diff_tokens"](spark, small)
    assert df.count() > 0
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning(size(" not in text and "ReusedExchange" in text
    word = "array<struct<id:int,form:string,lemma:string,upos:string,xpos:string,feats:map<string,string>,head:int,deprel:string>>"
    w = lambda i, form="a": (i, form, "l", "U", "X", {}, 0, "root")
    rows = lambda *r: spark.createDataFrame(r, f"k int, words {word}")
    gold, system = rows((1, [w(1), w(2)]), (2, [w(1), w(2)]), (3, [w(1)])), rows((1, [w(1), w(2, "b")]), (2, [w(1, "b")]), (3, [w(1)]))
    assert [tuple(r) for r in stats.different_words(gold, system, "k").collect()] == [(1, 2)]


def test_conditions_of_rules_are_tested_once_a_word(spark, small):
    """What a rule's condition says is a value by the time words ask for it."""
    text = plan(QUERIES["edit_rules"](spark, small))
    assert text.count("inline(array(struct(hit0_") == text.count("inline(array(struct(hit1_") == 1
    assert all("RLIKE" not in line for line in text.splitlines() if "named_struct(" in line)


def test_joined_words_are_made_once(spark, small):
    """Setting a field of one of two structs would make both for each of their fields."""
    assert plan(QUERIES["tok_join"](spark, small)).count("[0].lemma, words") == 1


def test_ancestors_without_labels(spark):
    """Heads are followed directly, without a walk around the tree; a cycle above many words doesn't make their lists long."""
    heads = [2, 1] + [1 + i % 2 for i in range(1500)]
    sents = spark.createDataFrame([([(i, h) for i, h in enumerate(heads, 1)],)], "words array<struct<id:int,head:int>>")
    df = trees.with_ancestors(sents)
    assert "entry" not in plan(df)
    up = df.first().up
    assert up == [[2, 1], [1, 2]] + [[h, 3 - h] for h in heads[2:]]


def test_labels_of_short_and_long_sentences(spark):
    """Both ways to make labels say the same, also with cycles and heads outside."""
    for r in sentences(spark, cases()).select("k", trees.labels().alias("a"), trees.labels(short=0).alias("b")).collect():
        assert r.a == r.b, r.k


def test_nested_json_sorts_without_a_lambda(spark, small):
    assert "array_sort(" not in plan(QUERIES["sink_tree_json"](spark, small))


def test_similar_texts_are_joined_in_one_order(spark):
    """Pairs of rows aren't made in both orders to drop half of them; copies, repeated keys and null keys give what they gave."""
    rows = [(1, "ab"), (2, "ab"), (3, "ac"), (1, "ac"), (3, "ac"), (None, "ab"), (5, None), (0, "zzzz")]
    df = similar.similar(spark.createDataFrame(rows, "id int, w string"), None, "id", "w", 1)
    near = {("ab", "ab"): 0, ("ac", "ac"): 0, ("ab", "ac"): 1, ("ac", "ab"): 1}
    want = sorted((i, j, near[a, b]) for i, a in rows for j, b in rows if i is not None and j is not None and i < j and (a, b) in near)
    assert sorted(map(tuple, df.collect())) == want
    assert "inline(array(struct(t1" not in plan(df)


def test_lines_are_taken_apart_once(spark, small):
    """Lines, notes and cells are copied no more than what is read from them, and a note is looked for once."""
    made = plan(QUERIES["scan_conllu"](spark, small))
    assert made.count("inline(array(struct(") == 2 and made.count(r"\Asent_id") == 1
    cells = spark.range(1).select(F.col("id").cast("string").alias("t"))
    assert not any(x in plan(cells.select(of("t"))) for of in (text.feats_of, text.misc_of) for x in ("substring_index", "instr("))


def test_odd_cells(spark):
    """Nulls, empty cells and parts, several signs in a part and names that are equal but for case."""
    feats = {None: None, "": {}, "_": {}, "A": {"A": ""}, "A=": {"A": ""}, "=x": {"": "x"}, "A=B=C||_": {"A": "B=C"}, "a=1|B=2|A=3": {"B": "2", "A": "3"}, "A=1\nB=2": {"A": "1", "B": "2"}}
    misc = {None: None, "": [], "_|": [], "A=B=C|A|A=|=x|_\nA=B=C": [("A", "B=C"), ("A", None), ("A", None), ("", "x"), ("A", "B=C")]}
    for made, cells in ((text.feats_of, feats), (text.misc_of, misc)):
        rows = spark.createDataFrame([(t,) for t in cells], "t string").select("t", made("t").alias("x")).collect()
        assert {r.t: [*map(tuple, r.x)] if isinstance(r.x, list) else r.x for r in rows} == cells


def test_odd_blocks(spark):
    """Blocks that are null, empty or comments only are left out, null and repeated keys stay, and one carriage return ends a line."""
    block = "# sent_id = a\r\n#sent_id=b = c\r\n \r\n1\tw\t_\t_\t_\tA=1|a=2\t0\troot\t_\tx\r\r\n"
    rows = [(1, None), (2, ""), (3, "# sent_id = x\n"), (4, block), (4, block), (None, block), (5, "# text = t\n1\tw")]
    out = conllu.parse(spark.createDataFrame(rows, "k int, value string")).collect()
    assert sorted(str(r.k) for r in out) == ["4", "4", "5", "None"]
    for r in out:
        if r.k == 5:
            assert (r.sent_id, r.text, r.errors) == (None, "t", ["line 2: wrong number of columns: 2"]) and [(w.id, w.form, w.lemma, w.feats) for w in r.words] == [(1, "w", "_", {})]
        else:
            assert (r.sent_id, r.text, r.errors) == ("b = c", None, ["sent_id is given twice"])
            assert [(w.feats, w.misc[0].key, len(w.misc)) for w in r.words] == [({"a": "2"}, "x\r", 1)]
