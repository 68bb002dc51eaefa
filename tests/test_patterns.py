"""Counting, filtering and binding of patterns against plain Python over random sentences, also with cycles."""

import random
from collections import Counter
from itertools import permutations

import pytest

from treeq.functions import conditions as c
from treeq.operators import grew

TOKEN = "struct<kind:string,id:int,subid:int,form:string,lemma:string,upos:string,xpos:string,feats:map<string,string>,head:int,deprel:string,deps:array<struct<headid:int,headsubid:int,deprel:string>>,misc:array<struct<key:string,val:string>>>"
PATTERNS = {
    "edge": grew.Pattern({"A": c.upos("N")}, [("A", "B")]),
    "siblings": grew.Pattern({"A": c.upos(["N", "V"])}, [("A", "B"), ("A", "C"), ("A", "D", ["x"])]),
    "chain": grew.Pattern({"C": c.upos("N")}, [("A", "B"), ("B", "C"), ("C", "D")]),
    "deep": grew.Pattern({}, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "E", ["x"], True), ("C", "F")]),
    "ordered": grew.Pattern({"A": c.upos("N")}, [("A", "B")], order=[("A", "B", False)], without=[[("B", "X"), grew.Is("X", c.upos("V"))]]),
    "apart": grew.Pattern({"A": c.upos("N"), "B": c.upos("N")}),
    "agree": grew.Pattern({}, [("A", "B")], agree=[("A", c.value("upos"), "B", c.value("upos"), True)]),
}


def bindings(heads, tags, labels, name):
    """Every assignment of different nodes, tried one by one; 0 is the root."""
    p, words = PATTERNS[name], range(1, len(heads) + 1)
    head = lambda i: heads[i - 1] if i else -1
    conds = {"A": {"edge": "N", "siblings": "NV", "ordered": "N", "apart": "N"}.get(name), "B": {"apart": "N"}.get(name), "C": {"chain": "N"}.get(name)}
    out = 0
    for ids in permutations(range(len(heads) + 1), len(p.nodes)):
        at = dict(zip(p.nodes, ids))
        ok = all(not conds.get(n) or (i and tags[i - 1] in conds[n]) for n, i in at.items())
        for h, d, *rest in p.edges:
            ok = ok and at[d] > 0 and head(at[d]) == at[h]
            if ok and rest:
                ok = (labels[at[d] - 1] in rest[0]) != bool(rest[1:] and rest[1])
        if ok and name == "ordered":
            ok = at["A"] < at["B"] and not any(head(x) == at["B"] and tags[x - 1] == "V" for x in words)
        if ok and name == "agree":
            tag = lambda i: tags[i - 1] if i else "_"
            ok = tag(at["A"]) == tag(at["B"])
        out += ok
    return out


@pytest.mark.parametrize("name", list(PATTERNS))
def test_counts(spark, name):
    rng = random.Random(7)
    cases = []
    for _ in range(40):
        n = rng.randint(1, 6)
        heads = [rng.randint(0, n) for _ in range(n)]
        heads = [h if h != i + 1 else 0 for i, h in enumerate(heads)]
        cases.append((heads, [rng.choice("NV") for _ in range(n)], [rng.choice("xy") for _ in range(n)]))
    rows = [(k, [("WORD", i + 1, -1, "f", "l", t, "p", {}, h, r, [], []) for i, (h, t, r) in enumerate(zip(*case))]) for k, case in enumerate(cases)]
    df = spark.createDataFrame(rows, f"k int, words array<{TOKEN}>")
    want = {k: n for k, case in enumerate(cases) if (n := bindings(*case, name))}
    assert {r.k: r.n for r in grew.counted(df, PATTERNS[name], "k").collect()} == want
    assert {r.k for r in grew.matching(df, PATTERNS[name], "k").collect()} == set(want)
    assert Counter(r.k for r in grew.match(df, PATTERNS[name], "k").collect()) == want


def test_plans_are_narrow(spark):
    df = spark.createDataFrame([], f"k int, words array<{TOKEN}>")
    for out in (grew.counted(df, PATTERNS["deep"], "k"), grew.matching(df, PATTERNS["ordered"], "k")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "explode" not in plan.lower() and "Join" not in plan


def test_partitions():
    assert [len(list(grew._partitions(list(range(n))))) for n in range(6)] == [1, 1, 2, 5, 15, 52]
