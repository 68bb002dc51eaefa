"""Conditions and patterns over tables of tokens against those over sentences in rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from treeq import queries
from treeq.functions import conditions as c
from treeq.operators import grew
from treeq.operators.tokens import Tokens, token_table
from treeq.sources import views

MORE = {
    "agree": c.same(c.feat_value("size"), c.of_head(c.feat_value("Size"))) | c.same(c.of_next(c.value("upos")), c.of_prec(c.value("upos"))),
    "compatible": c.compatible(c.feat_value("Disc"), c.of_child(c.feat_value("Disc"))),
    "compatible_head": ~c.compatible(c.value("xpos"), c.of_head(c.of_next(c.value("xpos")))),
    "nested": ~c.child(c.child(c.upos("R")) & ~c.next_(c.upos("A"))) & c.prec(c.head(c.xpos("O"))),
}
CONDITIONS = {n: x for n, x in queries.CONDITIONS.items() if n not in ("find_deprel", "deprel_path", "find_subtree")} | MORE
PATTERNS = {n: p for n, p in queries.PATTERNS.items() if not p.tests}


@pytest.fixture(scope="module")
def sents(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sents"))
    views.orders(spark, small).where("sent < 120").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bag(df, *columns):
    return Counter(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("name", list(CONDITIONS))
def test_conditions(sents, name):
    at = ("sent", "kind", "id", "subid")
    whole = c.tokens_where(sents, CONDITIONS[name], "sent", kinds=("words", "mwts", "empties"))
    assert bag(Tokens(token_table(sents, "sent"), "sent").where(CONDITIONS[name]), *at) == bag(whole, *at)


@pytest.mark.parametrize("name", list(PATTERNS))
def test_patterns(sents, name):
    p = PATTERNS[name]
    ids = [F.col(n)[x] for n in p.nodes for x in ("id", "subid")]
    assert bag(Tokens(token_table(sents, "sent"), "sent").match(p), "sent", *ids) == bag(grew.match(sents, p, "sent"), "sent", *ids)


def test_one_long_sentence(spark):
    """A sentence of 300,000 words takes part in as many tasks as there are partitions."""
    rows = spark.range(1, 300_001, 1, 4).selectExpr(
        "1 as sent", "'WORD' as kind", "cast(id as int) as id", "-1 as subid", "cast(id - 1 as int) as head", "if(id % 3 = 0, 'N', 'V') as upos", "'dep' as deprel"
    )
    found = Tokens(rows, "sent").where(c.head(c.upos("N")) & ~c.next_(c.upos("N")))
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 99_999 and max(r["count"] for r in tasks) < 60_000
    pattern = grew.Pattern({"A": c.upos("N")}, [("A", "B"), ("B", "C")])
    assert Tokens(rows, "sent").match(pattern).count() == 99_999
    with pytest.raises(ValueError):
        Tokens(rows, "sent").match(grew.Pattern({}, [("A", "B")], tests=[grew.tree()]))


@pytest.mark.parametrize("name", ["table_values", "table_pattern", "table_navigation"])
def test_a_table_of_tokens_is_made_once(spark, small, name):
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "collect_list" not in plan


def test_own_values_are_compared_in_the_row(spark):
    rows = spark.createDataFrame([("s", i, "WORD", -1, h, [v]) for i, h, v in [(1, 0, "a"), (2, 1, "b"), (3, 1, "a"), (4, 2, "_"), (5, 4, "_")]], "s string, id int, kind string, subid int, head int, v array<string>")
    value = lambda t: t["v"]
    table, (a, b) = Tokens(rows, "s"), (value, value)
    found = lambda x, y: {r.id for r in table.where(c.same(x, y)).collect()}
    assert found(a, c.of_child(value)) == found(c.of_child(value), b) == {1}
    assert found(a, b) == {1, 2, 3}
    assert found(c.of_head(value), c.of_child(value)) == set()
    assert table.where(c.same(a, b))._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_nodes_are_exchanged_with_what_is_asked_of_them(spark, small):
    """A bound word is no struct while it is joined, so only its ids, head and label are read and exchanged; negative blocks don't make the bindings again."""
    plan = queries.QUERIES["table_pattern"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "misc" not in plan and "form" not in plan.replace("Format", "")
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 6 and sum("LeftAnti" in line for line in joins) == 2


BLOCKS = {
    "none of the nodes": [("X", "Y", ["dep1"]), grew.Is("X", c.upos("R"))], "no edge": [grew.Is("X", c.lemma("PROMO"))], "two nodes": [("A", "X"), ("X", "Y"), ("B", "Y", ["dep2"]), grew.Is("A", c.xpos("O"))],
    "a node and a condition": [grew.Is("B", c.upos("A")), ("B", c.xpos("F"))],
}


@pytest.mark.parametrize("name", list(BLOCKS))
def test_negative_blocks(sents, name):
    p = grew.Pattern({"A": c.upos("N|R")}, [("A", "B")], without=[BLOCKS[name]])
    ids = [F.col(n)[x] for n in p.nodes for x in ("id", "subid")]
    whole = bag(grew.match(sents, p, "sent"), "sent", *ids)
    assert bag(Tokens(token_table(sents, "sent"), "sent").match(p), "sent", *ids) == whole and whole
