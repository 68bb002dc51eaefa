"""Conditions and patterns over a table of tokens, a row each, for sentences that don't fit into a row.

The same `Cond` and `Pattern` objects become joins: a word's head, dependents and neighbours are found by equal (sentence, id), so one sentence's
tokens spread over all tasks, and nothing of a sentence is gathered. Every navigation is a join with the words for which the inner
condition holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Cond, Getter, child, head, next_, prec
from .grew import ANY, Is, Pattern, _bind_order

#: What tells tokens of a sentence apart.
AT = ("kind", "id", "subid")
_AROUND = {"head": head, "child": child, "prec": prec, "next": next_}


def token_table(sents: DataFrame, *keys: str, kinds: tuple[str, ...] = ("words", "mwts", "empties")) -> DataFrame:
    """Key columns and the fields of every token."""
    arrays = [F.col(c) for c in kinds if c in sents.columns]
    return sents.select(*keys, F.inline(F.concat(*arrays) if len(arrays) > 1 else arrays[0]))


class Tokens:
    """A table of tokens with the columns `keys` of their sentence. A sentence's words have the ids 1, 2, ... without holes."""

    def __init__(self, rows: DataFrame, *keys: str):
        self.rows, self.keys = rows, list(keys)
        self.fields = [c for c in rows.columns if c not in keys]
        self.words = rows.where("kind = 'WORD'")

    def token(self) -> Column:
        return F.struct(*self.fields)

    def where(self, c: Cond) -> DataFrame:
        """The tokens that satisfy a condition, as `conditions.tokens_where` has them."""
        return self._holding(self.rows, c)

    def _holding(self, rows: DataFrame, c: Cond) -> DataFrame:
        marked, flag = self._flag(rows, c)
        return marked.where(flag).select(rows.columns)

    def _flag(self, rows: DataFrame, c: Cond) -> tuple[DataFrame, Column]:
        """The rows with more columns, and the condition over them; no row is added or lost."""
        name, *parts = c.parts or ("",)
        if not name:
            return rows, c(self.token())
        if name in ("and", "or"):
            rows, a = self._flag(rows, parts[0])
            rows, b = self._flag(rows, parts[1])
            return rows, (a & b) if name == "and" else (a | b)
        if name == "not":
            rows, a = self._flag(rows, parts[0])
            return rows, ~a
        if name in _AROUND:
            return self._marked(rows, self._seen_from(name, self._holding(self.words, parts[0])), name)
        a, b = parts
        rows, both = self._overlap(rows, a, b)
        if name == "same":
            return rows, both
        for g in (a, b):  # compatible: nothing to compare, or something undefined
            rows, there = self._flag(rows, self._any(g, lambda x: x.isNotNull()))
            rows, open_ = self._flag(rows, self._any(g, lambda x: F.array_contains(x, "_")))
            both = both | open_ | (F.lit(False) if self._from_children(g) else ~there)
        return rows, both

    def _seen_from(self, way: str, words: DataFrame) -> DataFrame:
        """(keys, near): the ids of the tokens, or for "head" the heads, that see one of these words that way."""
        near = {"head": F.col("id"), "child": F.col("head"), "prec": F.col("id") + 1, "next": F.col("id") - 1}[way]
        out = words.select(*self.keys, near.alias("near_"))
        return out.distinct() if way == "child" else out

    def _marked(self, rows: DataFrame, seen: DataFrame, way: str) -> tuple[DataFrame, Column]:
        at = f"seen{len(rows.columns)}_"
        own = F.col("head") if way == "head" else F.col("id")
        seen = seen.select(*(F.col(k).alias(f"{k}_{at}") for k in self.keys), F.col("near_").alias(at))
        on = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(seen[f"{k}_{at}"]) for k in self.keys), own == F.col(at))
        out = rows.join(seen, on, "left").drop(*(f"{k}_{at}" for k in self.keys))
        found = F.col(at).isNotNull()
        if way in ("head", "child"):
            found = found & (F.col("kind") == "WORD")
        return out, found & (F.col("head") > 0) if way == "head" else found

    def _any(self, g: Getter, test) -> Cond:
        """A condition on what a getter gets: on the token it gets it from."""
        way, *inner = getattr(g, "parts", ()) or ("",)
        return _AROUND[way](self._any(inner[0], test)) if way else Cond(lambda t: test(g(t)))

    def _from_children(self, g: Getter) -> bool:
        """Whether the values come as a list that may be empty but is never missing."""
        return (getattr(g, "parts", ()) or ("",))[0] == "child"

    def _values(self, rows: DataFrame, g: Getter, *more: Column) -> DataFrame:
        """(keys, kind, id, subid, head, more, v): a row for each value of each token."""
        own = [*(F.col(c) for c in (*self.keys, *AT, "head")), *more]
        way, *inner = getattr(g, "parts", ()) or ("",)
        if not way:
            return rows.select(*own, F.explode(g(self.token())).alias("v_"))
        values = self._values(self.words, inner[0])
        near = {"head": F.col("id"), "child": F.col("head"), "prec": F.col("id") + 1, "next": F.col("id") - 1}[way]
        values = values.select(*(F.col(k).alias(f"{k}_v") for k in self.keys), near.alias("near_"), "v_")
        at = F.col("head") if way == "head" else F.col("id")
        rows = rows.select(*own)
        on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_v")) for k in self.keys), at == F.col("near_"))
        return rows.join(values, on).select(*rows.columns, "v_")

    def _overlap(self, rows: DataFrame, a: Getter, b: Getter) -> tuple[DataFrame, Column]:
        """Whether some value of a, other than `_`, is one of b: a join on the value, however many a token has. A token's own values are looked at in its row."""
        at = f"same{len(rows.columns)}_"
        names = [*self.keys, *AT]
        plain = [g for g in (a, b) if not getattr(g, "parts", ())]
        known = lambda g: F.filter(g(self.token()), lambda x: x != "_")
        if len(plain) == 2:
            return rows, F.coalesce(F.arrays_overlap(known(a), known(b)), F.lit(False))
        named = [F.col(c).alias(f"{c}_{at}") for c in names]
        if plain:
            found = self._values(rows, b if plain[0] is a else a, known(plain[0]).alias("own_")).where(F.array_contains("own_", F.col("v_")))
            shared = found.select(*named).distinct()
        else:
            one, other = (self._values(rows, g).where("v_ <> '_'").select(*named, "v_").distinct() for g in (a, b))
            shared = one.intersect(other).drop("v_").distinct()
        shared = shared.withColumn(at, F.lit(True))
        on = reduce(lambda x, y: x & y, (rows[c].eqNullSafe(shared[f"{c}_{at}"]) for c in names))
        return rows.join(shared, on, "left").drop(*(f"{c}_{at}" for c in names)), F.col(at).isNotNull()

    # patterns

    def _domain(self, dependent: bool) -> DataFrame:
        """What a node may be: words, for those that depend on something; empty words and the root too for others."""
        if dependent:
            return self.words
        top = self.words.groupBy(*self.keys).agg(F.lit(1).alias("one_"))
        kinds = {f.name: f.dataType for f in self.rows.schema}

        def blank(c: str) -> Column:
            fixed = {"kind": F.lit("WORD"), "id": F.lit(0), "subid": F.lit(-1), "head": F.lit(-1)}
            empty = {"array": F.array(), "map": F.create_map()}
            return fixed.get(c, empty.get(kinds[c].typeName(), F.lit("_"))).cast(kinds[c]).alias(c)

        return self.rows.where("kind <> 'MWT'").unionByName(top.select(*self.keys, *(blank(c) for c in self.fields)))

    def _node(self, rows: DataFrame, name: str) -> DataFrame:
        """Keys, named apart, and the fields as columns of a node: as a struct, a node would be exchanged with all its fields, whatever is asked of it."""
        return rows.select(*(F.col(k).alias(f"{k}_n") for k in self.keys), *(F.col(f).alias(f"{name}@{f}") for f in self.fields))

    def _whole(self, name: str) -> Column:
        """A bound node as a struct."""
        return F.struct(*(F.col(f"{name}@{f}").alias(f) for f in self.fields))

    def _bind(self, rows: DataFrame | None, name: str, c: Cond, dependent: bool, ties: list[Column], bound: list[str]) -> DataFrame:
        """Rows with one more node; a word is bound once in a row. The node's condition is tested before the join."""
        node = self._domain(dependent)
        node = self._node(node if c is ANY else self._holding(node, c), name)
        if rows is None:
            return node.withColumnsRenamed({f"{k}_n": k for k in self.keys})
        on = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(node[f"{k}_n"]) for k in self.keys))
        for tie in ties:
            on = on & tie
        for other in bound:
            on = on & ~((F.col(f"{other}@id") == F.col(f"{name}@id")) & (F.col(f"{other}@subid") == F.col(f"{name}@subid")))
        return rows.join(node, on).drop(*(f"{k}_n" for k in self.keys))

    def match(self, pattern: Pattern) -> DataFrame:
        """A row per binding: key columns, a struct column per node, and `ids`, as `grew.match`; getters in `agree` look at the node alone, and tests
        of whole sentences aren't for tables of tokens."""
        if pattern.tests or any(getattr(g, "parts", ()) for a in pattern.agree for g in (a[1], a[3])):
            raise ValueError("tests of sentences and values of other tokens need sentences in rows")
        rows, bound = None, []
        for name in _bind_order(pattern):
            near = [*bound, name]
            ties = [_tie(h, d, *rest) for h, d, *rest in pattern.edges if name in (h, d) and h in near and d in near]
            for a, b, immediate in pattern.order:
                if name in (a, b) and a in near and b in near:
                    ties.append(F.col(f"{a}@id") + 1 == F.col(f"{b}@id") if immediate else F.col(f"{a}@id") < F.col(f"{b}@id"))
            rows = self._bind(rows, name, pattern.nodes[name], any(e[1] == name for e in pattern.edges), ties, bound)
            bound.append(name)
        for a, ga, b, gb, equal in pattern.agree:
            overlap = F.arrays_overlap(ga(self._whole(a)), gb(self._whole(b)))
            rows = rows.where(F.coalesce(overlap if equal else ~overlap, F.lit(False)))
        for block in pattern.without:
            rows = self._without(rows, block, bound)
        ids = F.array_sort(F.array(*(F.col(f"{n}@id") for n in pattern.nodes)))
        return rows.select(*self.keys, *(self._whole(n).alias(n) for n in pattern.nodes), ids.alias("ids"))

    def _without(self, rows: DataFrame, block: list, bound: list[str]) -> DataFrame:
        """Rows for which no binding of the block's own nodes satisfies all of it: an anti-join on those bound nodes that the block is about. Where that is one, the
        words are looked through for it, and not the rows, which would be made a second time."""
        conds: dict[str, Cond] = {}
        edges = []
        for k, x in enumerate(block):
            if isinstance(x, Is):
                conds[x.node] = conds[x.node] & x.cond if x.node in conds else x.cond
            elif isinstance(x[1], str):
                edges.append(tuple(x))
            else:  # a condition in place of a dependent
                conds[f"any{k}"] = x[1]
                edges.append((x[0], f"any{k}", *x[2:]))
        names = list(dict.fromkeys(n for e in edges for n in e[:2]))
        free = [n for n in dict.fromkeys([*names, *conds]) if n not in bound]
        about = [n for n in bound if n in names or n in conds]
        if len(about) == 1:
            own = self._domain(False)
            found = self._node(self._holding(own, conds[about[0]]) if about[0] in conds else own, about[0]).withColumnsRenamed({f"{k}_n": k for k in self.keys})
        else:
            found = rows.select(*self.keys, *(f"{n}@{f}" for n in about for f in self.fields)) if about else rows.select(*self.keys).distinct()
            for n in [n for n in conds if n in bound]:
                same = self._holding(self._domain(False), conds[n]).select(*(F.col(k).alias(f"{k}_n") for k in self.keys), F.col("id").alias("id_n"), F.col("subid").alias("subid_n"))
                on = [found[k].eqNullSafe(same[f"{k}_n"]) for k in self.keys] + [F.col(f"{n}@id") == F.col("id_n"), F.col(f"{n}@subid") == F.col("subid_n")]
                found = found.join(same, reduce(lambda a, b: a & b, on), "left_semi")
        for e in edges:
            if e[0] in bound and e[1] in bound:
                found = found.where(_tie(*e))
        known, left = list(bound), list(free)
        while left:
            name = next((n for n in left if any({e[0], e[1]} & set(known) and n in e[:2] for e in edges)), left[0])
            left.remove(name)
            named = lambda n: n if n in bound else f"{n}_free"  # noqa: E731  (own nodes of a block may bind any word)
            ties = [_tie(named(h), named(d), *rest) for h, d, *rest in edges if name in (h, d) and {h, d} <= {*known, name}]
            found = self._any_node(found, f"{name}_free", conds.get(name, ANY), any(e[1] == name for e in edges), ties)
            known.append(name)
        ids = [F.col(f"{n}@{c}").alias(f"{n}_{c}_") for n in about for c in ("id", "subid")]
        gone = found.select(*(F.col(k).alias(f"{k}_") for k in self.keys), *ids)
        on = [rows[k].eqNullSafe(gone[f"{k}_"]) for k in self.keys] + [F.col(f"{n}@{c}") == F.col(f"{n}_{c}_") for n in about for c in ("id", "subid")]
        return rows.join(gone, reduce(lambda a, b: a & b, on), "left_anti")

    def _any_node(self, rows: DataFrame, name: str, c: Cond, dependent: bool, ties: list[Column]) -> DataFrame:
        node = self._domain(dependent)
        node = self._node(node if c is ANY else self._holding(node, c), name)
        on = reduce(lambda a, b: a & b, ties, reduce(lambda a, b: a & b, (rows[k].eqNullSafe(node[f"{k}_n"]) for k in self.keys)))
        return rows.join(node, on).drop(*(f"{k}_n" for k in self.keys))


def _tie(h: str, d: str, labels=None, negated: bool = False) -> Column:
    there = (F.col(f"{d}@head") == F.col(f"{h}@id")) & (F.col(f"{h}@subid") < 0) & (F.col(f"{d}@subid") < 0) & (F.col(f"{d}@id") > 0)
    if labels is None:
        return there
    listed = F.col(f"{d}@deprel").isin(list(labels))
    return there & (~listed if negated else listed)
