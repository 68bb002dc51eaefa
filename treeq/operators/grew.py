"""Graph patterns over a sentence: nodes, edges, order, agreement, negative blocks, sentence-level tests.

    Pattern({"H": upos("N"), "D": upos("R")}, edges=[("H", "D")])

Nodes are bound one after another by exploding candidates that already satisfy their own condition and what ties them to
bound nodes. An edge whose dependent is bound costs nothing: its head is looked up. Different nodes bind different words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from math import factorial, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Cond, Getter
from ..functions.let import let, settled
from .trees import is_projective

ANY = Cond(lambda t: F.lit(True))


@dataclass
class Is:
    """In a negative block: the node satisfies the condition."""

    node: str
    cond: Cond


@dataclass
class Pattern:
    """nodes: name -> condition. edges: (head, dependent[, labels[, negated]]). order: (left, right, immediate).
    agree: (node, getter, node, getter, equal). without: blocks that must not hold as a whole, of edges, where a dependent may be a condition instead
    of a node, and of `Is` (what a node is); names that the pattern doesn't bind stand for any node. tests: predicates on the sentence row.

    Nodes are words, empty words and the root (id 0, without form, lemma, tags or features, a head only)."""

    nodes: dict[str, Cond]
    edges: list[tuple] = field(default_factory=list)
    order: list[tuple[str, str, bool]] = field(default_factory=list)
    agree: list[tuple[str, Getter, str, Getter, bool]] = field(default_factory=list)
    without: list[list[tuple]] = field(default_factory=list)
    tests: list[Callable[[], Column]] = field(default_factory=list)

    def __post_init__(self):
        named = {n for e in self.edges for n in e[:2]} | {n for o in self.order for n in o[:2]} | {n for a in self.agree for n in (a[0], a[2])}
        self.nodes = {n: self.nodes.get(n, ANY) for n in sorted(named | set(self.nodes))}


def nodes(sents: DataFrame) -> Column:
    """What a node may be: words, empty words if there are any, the root."""
    w = F.get("words", F.lit(0))
    root = w.withField("id", F.lit(0)).withField("head", F.lit(-1))
    for f, kind in [(f.name, f.dataType) for f in sents.schema["words"].dataType.elementType.fields]:
        if f not in ("id", "head", "kind", "subid"):
            empty = F.slice(w[f], 1, 0) if kind.typeName() == "array" else F.map_filter(w[f], lambda k, v: F.lit(False)) if kind.typeName() == "map" else F.lit("_").cast(kind)
            root = root.withField(f, empty)
    more = [F.col("empties")] if "empties" in sents.columns else []
    return F.concat("words", *more, F.filter(F.array(root), lambda r: F.size("words") > 0))


def _word(t: Column) -> Column:
    return t["id"] > 0


def _edge(head: Column, dep: Column, labels: Iterable[str] | None = None, negated: bool = False) -> Column:
    there = (dep["head"] == head["id"]) & (head["subid"] < 0) & (dep["subid"] < 0) & _word(dep)
    if labels is None:
        return there
    listed = dep["deprel"].isin(list(labels))
    return there & (~listed if negated else listed)


def _same(a: Column, b: Column) -> Column:
    return (a["id"] == b["id"]) & (a["subid"] == b["subid"])


def _dependent(head: Column, c: Cond, rest: list) -> Callable[[Column], Column]:
    return lambda w: _edge(head, w, *rest) & c(w)


def _absent(block: list, bound: dict[str, Column]) -> Column:
    free = []
    for x in block:
        for n in (x.node,) if isinstance(x, Is) else x[:2]:
            if isinstance(n, str) and n not in bound and n not in free:
                free.append(n)

    def holds(known: dict[str, Column], left: list[str]) -> Column:
        if left:
            return F.exists("nodes_", lambda w: holds({**known, left[0]: w}, left[1:]))
        every = F.lit(True)
        for x in block:
            if isinstance(x, Is):
                every = every & x.cond(known[x.node])
            elif isinstance(x[1], str):
                every = every & _edge(known[x[0]], known[x[1]], *x[2:])
            else:
                every = every & F.exists("words", _dependent(known[x[0]], x[1], list(x[2:])))
        return every

    return ~holds(bound, free)


def _candidates(pattern: Pattern) -> Column:
    """For each node the words that it may bind: those that satisfy its condition and have, for each of its edges, a candidate at the other end.

    Heads are reduced by their dependents from the bottom up, then dependents by their heads from the top down. Where edges form a tree that leaves only what
    is bound somewhere (but for nodes that would bind one word); otherwise it goes around twice."""
    # only words depend on something
    domain = {n: "words" if any(e[1] == n for e in pattern.edges) else "nodes_" for n in pattern.nodes}
    start = {n: F.filter(domain[n], c.__call__) if c is not ANY else F.col(domain[n]) for n, c in pattern.nodes.items()}
    depth = dict.fromkeys(pattern.nodes, 0)
    for _ in pattern.nodes:
        for h, d, *_rest in pattern.edges:
            depth[d] = max(depth[d], min(depth[h] + 1, len(depth)))
    up = [(h, d, rest, True) for h, d, *rest in sorted(pattern.edges, key=lambda e: -depth[e[1]])]
    sweep = up + [(h, d, rest, False) for h, d, rest, _ in reversed(up)]
    todo = sweep if _is_tree(pattern) else sweep * 2

    def step(sets: dict[str, Column], left: list) -> Column:
        if not left:
            return F.struct(*(sets[n].alias(n) for n in pattern.nodes))
        (h, d, rest, upwards), name = left[0], left[0][0] if left[0][3] else left[0][1]
        tied = lambda x: F.exists(sets[d], lambda y: _edge(x, y, *rest)) if upwards else F.exists(sets[h], lambda y: _edge(y, x, *rest))
        return let(F.filter(sets[name], tied), then=lambda kept: step({**sets, name: kept}, left[1:]))

    names = list(start)
    return let(*start.values(), then=lambda *sets: step(dict(zip(names, sets, strict=True)), todo))


def _reduced(sents: DataFrame, pattern: Pattern, *keys: str) -> DataFrame:
    """Keys, words, nodes_ and cands_ of the sentences that pass the pattern's tests and have candidates for every node."""
    rows = sents
    for test in pattern.tests:
        rows = rows.where(test())
    rows = settled(rows.select(*keys, "words", nodes(rows).alias("nodes_")), "nodes_")
    rows = settled(rows.withColumn("cands_", _candidates(pattern)), "cands_")
    for n in pattern.nodes:
        rows = rows.where(F.size(F.col("cands_")[n]) > 0)
    return rows


def _is_tree(pattern: Pattern) -> bool:
    """Whether edges tie all nodes together as a tree, so that nothing else has to be looked at to bind them."""
    above = {d: h for h, d, *_ in pattern.edges}
    roots = [n for n in pattern.nodes if n not in above]
    return len(above) == len(pattern.edges) == len(pattern.nodes) - 1 and len(roots) == 1 and all(_rooted(n, above) for n in above)


def _rooted(n: str, above: dict[str, str]) -> bool:
    seen = set()
    while n in above and n not in seen:
        seen.add(n)
        n = above[n]
    return n not in above


def _ties(pattern: Pattern, name: str, bound: dict[str, Column]) -> Column:
    """What a node that has just been bound must satisfy with those bound before it."""
    out = F.lit(True)
    for other in bound:
        if other != name:
            out = out & ~_same(bound[other], bound[name])
    for h, d, *rest in pattern.edges:
        if name in (h, d) and h in bound and d in bound:
            out = out & _edge(bound[h], bound[d], *rest)
    for a, b, immediate in pattern.order:
        if name in (a, b) and a in bound and b in bound:
            out = out & (bound[a]["id"] + 1 == bound[b]["id"] if immediate else bound[a]["id"] < bound[b]["id"])
    for a, ga, b, gb, equal in pattern.agree:
        if name in (a, b) and a in bound and b in bound:
            overlap = F.arrays_overlap(ga(bound[a]), gb(bound[b]))
            out = out & F.coalesce(overlap if equal else ~overlap, F.lit(False))
    return out


def _bind_order(pattern: Pattern) -> list[str]:
    """Nodes so that each, where it can be, is tied to one before it."""
    left, out = list(pattern.nodes), []
    while left:
        near = (n for n in left if any({e[0], e[1]} & set(out) and n in e[:2] for e in pattern.edges))
        name = next(near, None) or next((n for n in left if pattern.nodes[n] is not ANY), left[0])
        left.remove(name)
        out.append(name)
    return out


def matching(sents: DataFrame, pattern: Pattern, *keys: str) -> DataFrame:
    """Keys of the sentences that have a binding. Nothing is exploded or shuffled: nested tests over reduced candidates stop at the first binding."""
    order = _bind_order(pattern)

    def some(bound: dict[str, Column], left: list[str]) -> Column:
        if not left:
            out = F.lit(True)
            for block in pattern.without:
                out = out & _absent(block, bound)
            return out
        name = left[0]

        def test(w: Column) -> Column:
            now = {**bound, name: w}
            return F.when(_ties(pattern, name, now), some(now, left[1:])).otherwise(False)

        return F.exists(F.col("cands_")[name], test)

    return _reduced(sents, pattern, *keys).where(some({}, order)).select(*keys)


def counted(sents: DataFrame, pattern: Pattern, *keys: str) -> DataFrame:
    """(keys, n): the number of bindings in each sentence that has one. Nothing is exploded or shuffled.

    Where edges make the pattern a tree and nothing else ties its nodes, bindings are counted by products up the tree: the ways to bind a node are
    the product, over its children in the pattern, of the ways to bind these. Two children must not bind one word, so sums over every partition of the children into
    sets that share a word are added and taken away (Möbius inversion); other nodes can bind one word only if their heads do. Other patterns are counted binding by binding."""
    rows = _reduced(sents, pattern, *keys)
    plain = _is_tree(pattern) and not (pattern.order or pattern.agree or pattern.without)
    n = _product(pattern) if plain else _one_by_one(pattern)
    return rows.select(*keys, n.alias("n")).where("n > 0")


def _sum(of: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda s, x: s + value(x))


def _one_by_one(pattern: Pattern) -> Column:
    def count(bound: dict[str, Column], left: list[str]) -> Column:
        if not left:
            out = F.lit(True)
            for block in pattern.without:
                out = out & _absent(block, bound)
            return out.cast("long")
        name = left[0]

        def here(w: Column) -> Column:
            now = {**bound, name: w}
            return F.when(_ties(pattern, name, now), count(now, left[1:])).otherwise(F.lit(0).cast("long"))

        return _sum(F.col("cands_")[name], here)

    return count({}, _bind_order(pattern))


def _partitions(items: list) -> Iterator[list[list]]:
    if not items:
        yield []
        return
    for rest in _partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def _product(pattern: Pattern) -> Column:
    children: dict[str, list] = {n: [] for n in pattern.nodes}
    for h, d, *rest in pattern.edges:
        children[h].append((d, rest))
    root = next(n for n in pattern.nodes if not any(e[1] == n for e in pattern.edges))
    none = F.lit(0).cast("long")

    def ways(node: str, path: list[Column]) -> Column:
        x, kids = path[-1], children[node]
        if not kids:
            return F.lit(1).cast("long")

        def weight(child: str, rest: list, y: Column) -> Column:
            ok = _edge(x, y, *rest) & pattern.nodes[child](y)
            for p in path:  # a sentence may have a cycle
                ok = ok & ~_same(p, y)
            return F.when(ok, ways(child, [*path, y])).otherwise(none)

        def shared(block: list) -> Column:
            def together(y: Column) -> Column:
                out = weight(*block[0], y)
                for child, rest in block[1:]:
                    out = out * weight(child, rest, y)
                return out

            return _sum(F.col("cands_")[block[0][0]], together)

        total = none
        for parts in _partitions(kids):
            term = F.lit(prod((-1) ** (len(b) - 1) * factorial(len(b) - 1) for b in parts)).cast("long")
            for b in parts:
                term = term * shared(b)
            total = total + term
        return total

    return _sum(F.col("cands_")[root], lambda x: ways(root, [x]))


def match(sents: DataFrame, pattern: Pattern, *keys: str) -> DataFrame:
    """A row per binding: key columns, a struct column per node, and `ids`, the sorted ids of what they bind. Candidates are
    reduced along edges before anything is exploded, and sentences that have none left for some node go."""
    rows = _reduced(sents, pattern, *keys)
    left, bound = list(pattern.nodes), {}
    while left:
        up = next((e for e in pattern.edges if e[1] in bound and e[0] in left), None)  # head of a bound dependent
        down = next((n for n in left if pattern.nodes[n] is not ANY and any(e[1] == n for e in pattern.edges)), None)
        name = up[0] if up else next((e[1] for e in pattern.edges if e[0] in bound and e[1] in left), None) or down or left[0]
        left.remove(name)
        c = pattern.nodes[name]
        if up:
            at = bound[up[1]]["head"]
            rows = rows.withColumn(name, F.when(at > 0, F.get("words", at - 1)).when(at == 0, F.get("nodes_", F.size("nodes_") - 1))).where(F.col(name).isNotNull())
            bound[name] = F.col(name)
            rows = rows.where(c(bound[name])) if c is not ANY else rows
        else:
            tied = [e for e in pattern.edges if e[1] == name and e[0] in bound]
            keep = ANY  # candidates satisfy the node's condition
            for h, _, *rest in tied:
                keep = keep & Cond(_dependent(bound[h], ANY, rest))
            rows = rows.withColumn(name, F.explode(F.filter(F.col("cands_")[name], keep.__call__)))
            bound[name] = F.col(name)
        for other in bound:
            if other != name:
                rows = rows.where(~_same(bound[other], bound[name]))
        for h, d, *rest in pattern.edges:
            if name in (h, d) and h in bound and d in bound:
                rows = rows.where(_edge(bound[h], bound[d], *rest))
        for a, b, immediate in pattern.order:
            if name in (a, b) and a in bound and b in bound:
                rows = rows.where(bound[a]["id"] + 1 == bound[b]["id"] if immediate else bound[a]["id"] < bound[b]["id"])
        for a, ga, b, gb, equal in pattern.agree:
            if name in (a, b) and a in bound and b in bound:
                overlap = F.arrays_overlap(ga(bound[a]), gb(bound[b]))
                rows = rows.where(F.coalesce(overlap if equal else ~overlap, F.lit(False)))
    for block in pattern.without:
        rows = rows.where(_absent(block, bound))
    ids = F.array_sort(F.array(*(bound[n]["id"] for n in pattern.nodes)))
    return rows.select(*keys, *(bound[n].alias(n) for n in pattern.nodes), ids.alias("ids"))


def projective(yes: bool = True) -> Callable[[], Column]:
    return lambda: is_projective() if yes else ~is_projective()


def tree(yes: bool = True) -> Callable[[], Column]:
    """One root (is_tree), or more than one (is_not_tree)."""
    roots = lambda: F.size(F.filter("words", lambda w: w["head"] < 1))
    return lambda: roots() == 1 if yes else roots() > 1
