"""Trees inside a sentence row: ancestors, spans, projectivity, checks, subtrees. Column expressions over `words`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let, settled, the_words


def _doubled(start: Column, rounds: Column, step) -> Column:
    """`step` applied to an array of structs as often as `rounds` says: pointers that go twice as far each time."""
    return F.aggregate(F.sequence(F.lit(1), rounds), start, lambda a, _: step(a))


def _rounds(n: Column) -> Column:
    """The number of doublings that lead over n steps, one at least."""
    return F.greatest(F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0)) + 1


#: Sentences of up to so many words get their labels from lists of heads, which in longer ones can be too large together.
SHORT = 32


def _heads(words: Column) -> Column:
    """For each word the ids of its heads, nearest first. A word's list is followed by that of its last word until all are whole, which takes log n steps; a list
    that comes back to a word of its own ends there."""
    head = lambda w: F.when(w["head"].between(1, F.size(words)), w["head"]).otherwise(0).cast("int")
    none = F.array().cast("array<int>")
    start = F.transform(words, lambda w: F.struct(head(w).alias("to"), F.lit(False).alias("loop"), F.when(head(w) > 0, F.array(head(w))).otherwise(none).alias("up")))

    def step(a: Column) -> Column:
        def longer(x: Column) -> Column:
            y = F.get(a, x["to"] - 1)
            back = F.struct(F.lit(0).alias("to"), F.lit(True).alias("loop"), F.array_union(x["up"], y["up"]).alias("up"))
            more = F.struct(y["to"].alias("to"), F.lit(False).alias("loop"), F.concat(x["up"], y["up"]).alias("up"))
            # both lists are of different words: if they meet anywhere, then at the last
            return F.when(y["loop"] | ((y["to"] > 0) & F.array_contains(x["up"], y["to"])), back).otherwise(more)

        return F.transform(a, lambda x: F.when(x["to"] > 0, longer(x)).otherwise(x))

    return F.transform(_doubled(start, _rounds(F.size(words)), step), lambda x: x["up"])


def _short_labels(words: Column) -> Column:
    """`labels` of a short sentence: paths from the roots, in order, are the walk's entries."""
    def paths(ups: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            wid, up = w["id"].cast("int"), F.get(ups, i)
            end = F.coalesce(F.element_at(up, -1), wid)  # a root, or a word on a cycle
            loop = F.get(ups, end - 1)

            def opened(end: Column, loop: Column) -> Column:
                looped = F.array_contains(loop, end)
                low = F.array_min(loop)
                cut = F.when(wid == low, F.slice(up, 1, 0)).otherwise(F.slice(up, F.lit(1), F.array_position(up, low).cast("int")))
                path = F.concat(F.reverse(F.when(looped, cut).otherwise(up)), F.array(wid))
                cycle = F.when(looped & F.array_contains(up, wid), low)
                return F.struct(path.alias("path"), wid.alias("id"), F.when(looped, low).otherwise(end).alias("top"), cycle.alias("cycle"), looped.alias("looped"))

            return F.when(F.size(up) == 0, F.struct(F.array(wid).alias("path"), wid.alias("id"), wid.alias("top"), F.lit(None).cast("int").alias("cycle"), F.lit(False).alias("looped"))).otherwise(let(end, loop, then=opened))

        return let(F.sort_array(F.transform(words, one)), then=walked)

    def walked(order: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            d, earlier = F.size(x["path"]), F.get(order, i - 1)["path"]
            entry = 2 * i - d + 1
            size = F.size(F.filter(order, lambda y: F.get(y["path"], d - 1) == x["id"]))
            prior = F.when((i > 0) & (F.size(earlier) >= d), F.get(earlier, d - 1))
            return F.struct(
                x["id"].alias("id"), entry.cast("int").alias("entry"), (entry + 2 * size - 1).cast("int").alias("exit"), F.when(~x["looped"], d).alias("depth"),
                x["top"].alias("top"), x["cycle"].alias("cycle"), prior.alias("prior"),
            )

        fields = ("entry", "exit", "depth", "top", "cycle", "prior")
        return F.transform(F.sort_array(F.transform(order, one)), lambda x: F.struct(*(x[f].alias(f) for f in fields)))

    return let(_heads(words), then=paths)


def labels(words: Column | None = None, short: int = SHORT) -> Column:
    """For each word: entry, exit (its places in a walk around the tree), depth (1 for a root; null at or below a cycle), top (the root or,
    for a cycle, the cycle's smallest word), cycle (top for words on a cycle, else null) and prior (the sibling before it, else null).

    One word is below another if its places are between the other's, see `below`. A head outside the sentence counts as none. The
    walk is a linked list of two places a word, ranked by pointer doubling, so a sentence of n words takes n log n steps. A cycle is opened at
    its smallest word, which the walk enters like a root.
    """
    def far(words: Column) -> Column:  # how far heads lead: a root's 0, or a word on a cycle; the least word on the way
        inside = lambda h: F.when(h.between(1, F.size(words)), h).otherwise(0)
        start = F.transform(words, lambda w: F.struct(inside(w["head"]).cast("int").alias("to"), w["id"].cast("int").alias("low"), w["id"].cast("int").alias("last")))

        def step(a: Column) -> Column:
            on = lambda x: F.get(a, x["to"] - 1)
            more = lambda x: F.struct(on(x)["to"].alias("to"), F.least(x["low"], on(x)["low"]).alias("low"), on(x)["last"].alias("last"))
            return F.transform(a, lambda x: F.when(x["to"] > 0, more(x)).otherwise(x))

        return _doubled(start, _rounds(F.size(words)), step)

    def opened(words: Column, ends: Column) -> Column:
        loops = F.array_distinct(F.filter(F.transform(ends, lambda e: e["to"]), lambda x: x > 0))

        def heads(loops: Column) -> Column:
            def one(w: Column, i: Column) -> Column:
                e = F.get(ends, i)
                on = F.array_contains(loops, w["id"].cast("int"))
                looped = e["to"] > 0
                # below a cycle the cycle's least word is that of the word on it
                top = F.when(looped, F.get(ends, e["to"] - 1)["low"]).otherwise(e["last"])
                cycle = F.when(on, e["low"])
                head = F.when(~w["head"].between(1, F.size(words)) | (on & (e["low"] == w["id"])), 0).otherwise(w["head"]).cast("int")
                return F.struct(w["id"].cast("int").alias("id"), head.alias("head"), top.cast("int").alias("top"), cycle.cast("int").alias("cycle"), looped.alias("looped"))

            return F.transform(words, one)

        return let(loops, then=heads)

    def toured(n: Column, nodes: Column) -> Column:
        order = F.sort_array(F.transform(nodes, lambda w: F.struct(w["head"].alias("head"), w["id"].alias("id"))))

        def linked(order: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(order, i)["head"] == F.get(order, j)["head"], F.lit(False))
            near = F.transform(order, lambda x, i: F.struct(
                x["id"].alias("id"), F.when(same(i, i + 1), F.get(order, i + 1)["id"]).alias("next"), F.when((i > 0) & same(i, i - 1), F.get(order, i - 1)["id"]).alias("prior")
            ))
            # the first word below each head from 0 to n: an entry of its own for every head, in front of those that have one
            every = F.transform(F.sequence(F.lit(0), n), lambda h: F.struct(h.cast("int").alias("head"), F.lit(1).alias("none"), F.lit(0).alias("id")))
            firsts = F.transform(F.filter(order, lambda x, i: (i == 0) | ~same(i, i - 1)), lambda x: F.struct(x["head"].alias("head"), F.lit(0).alias("none"), x["id"].alias("id")))
            return let(F.sort_array(near), F.sort_array(F.concat(every, firsts)), then=ranked)

        def ranked(near: Column, firsts: Column) -> Column:
            kept = F.filter(firsts, lambda x, i: (x["none"] == 0) | (i == 0) | (F.get(firsts, i - 1)["head"] != x["head"]))
            first = lambda kept, h: F.get(kept, h)["id"]
            into, out = lambda w: 2 * w - 2, lambda w: 2 * w - 1  # noqa: E731  (places of the walk's list)

            def walk(kept: Column) -> Column:
                def pair(w: Column, i: Column) -> Column:
                    down = F.when(first(kept, w["id"]) > 0, into(first(kept, w["id"]))).otherwise(out(w["id"]))
                    to = F.get(near, i)["next"]
                    up = F.when(to.isNotNull(), into(to)).when(w["head"] > 0, out(w["head"])).otherwise(-1)
                    step = lambda to, level: F.struct(to.cast("int").alias("to"), F.lit(1).alias("left"), F.lit(level).alias("level"))
                    return F.array(step(down, 1), step(up, -1))

                start = F.flatten(F.transform(nodes, pair))
                on = lambda a, x: F.get(a, x["to"])
                more = lambda a, x: F.struct(on(a, x)["to"].alias("to"), (x["left"] + on(a, x)["left"]).alias("left"), (x["level"] + on(a, x)["level"]).alias("level"))
                return _doubled(start, _rounds(2 * n), lambda a: F.transform(a, lambda x: F.when(x["to"] >= 0, more(a, x)).otherwise(x)))

            def done(walked: Column) -> Column:
                at = lambda i: F.get(walked, i)
                return F.transform(nodes, lambda w, i: F.struct(
                    (2 * n - at(2 * i)["left"]).alias("entry"), (2 * n - at(2 * i + 1)["left"]).alias("exit"),
                    # what is left of the walk goes down as often as it goes up, but for what is open here
                    F.when(~w["looped"], 1 - at(2 * i)["level"]).alias("depth"), w["top"].alias("top"), w["cycle"].alias("cycle"), F.get(near, i)["prior"].alias("prior"),
                ))

            return let(let(kept, then=walk), then=done)

        return let(order, then=linked)

    def build(words: Column) -> Column:
        nodes = lambda ends: let(opened(words, ends), then=lambda nodes: toured(F.size(words), nodes))
        return let(far(words), then=nodes)

    every = lambda words: F.when(F.size(words) <= short, _short_labels(words)).otherwise(build(words))
    return let(F.col("words") if words is None else words, then=every)


def below(marks: Column, low: Column, high: Column) -> Column:
    """Whether the word with id `low` is at some distance below the word with id `high`, from `labels`; words on a cycle are below each other and themselves."""
    a, b = F.get(marks, high - 1), F.get(marks, low - 1)
    return F.coalesce(((a["entry"] < b["entry"]) & (b["exit"] < a["exit"])) | (a["cycle"] == b["top"]), (a["entry"] < b["entry"]) & (b["exit"] < a["exit"]), F.lit(False))


def with_labels(sents: DataFrame, name: str = "labels") -> DataFrame:
    """sents with the `labels` of its words, computed once."""
    return settled(sents.withColumn(name, labels()), name)


def ancestors(token: Column) -> Column:
    """Ids of the token's heads, nearest first; a cycle or a head outside ends the list."""
    start = F.struct(token["head"].alias("at"), F.array().cast("array<int>").alias("up"))

    def step(acc: Column, _: Column) -> Column:
        on = (acc["at"] > 0) & F.get(the_words(), acc["at"] - 1).isNotNull() & ~F.array_contains(acc["up"], acc["at"])
        return F.struct(F.when(on, F.get(the_words(), acc["at"] - 1)["head"]).otherwise(F.lit(0)).alias("at"), F.when(on, F.concat(acc["up"], F.array(acc["at"]))).otherwise(acc["up"]).alias("up"))

    return F.aggregate(the_words(), start, step, lambda acc: acc["up"])


def with_ancestors(sents: DataFrame) -> DataFrame:
    """sents with `up`: for each word the ids of its heads, nearest first. Compute it once where several tests need it; to know whether
    a word is below another, `labels` is shorter."""
    return sents.withColumn("up", _heads(F.col("words")))


def dominated(word: int) -> Column:
    """The words below the word with this id."""
    return let(labels(), then=lambda marks: F.filter("words", lambda w: below(marks, w["id"], F.lit(word))))


def dominates(up: Column, above: Column, below: Column) -> Column:
    """Whether the word with id `above` is a head, at some distance, of the word with id `below`."""
    return F.coalesce(F.array_contains(F.get(up, below - 1), above), F.lit(False))


def _ranges(marks: Column) -> Column:
    """Least entry, greatest exit, least and greatest top of the words from each place on, over 1, 2, 4, ... of them: an array of arrays."""
    base = F.transform(marks, lambda m: F.struct(m["entry"].alias("entry"), m["exit"].alias("exit"), m["top"].alias("low"), m["top"].alias("high")))

    def next_(levels: Column, k: Column) -> Column:
        last = lambda a: F.transform(a, lambda x, i: let(F.get(a, i + F.pow(F.lit(2), k - 1).cast("int")), then=lambda y: _both(x, y)))
        return F.concat(levels, F.array(let(F.element_at(levels, -1), then=last)))

    return F.aggregate(F.sequence(F.lit(1), _rounds(F.size(marks))), F.array(base), next_)


def _both(x: Column, y: Column) -> Column:
    return F.struct(F.least(x["entry"], y["entry"]).alias("entry"), F.greatest(x["exit"], y["exit"]).alias("exit"), F.least(x["low"], y["low"]).alias("low"), F.greatest(x["high"], y["high"]).alias("high"))


def is_projective(marks: Column | None = None) -> Column:
    """Every word inside an arc of length over two is below the arc's head. `marks` are the words' `labels`, if they are known.

    Words inside an arc are all below its head if their least entry and greatest exit are between the head's, which a table of ranges tells in one step."""
    def every(marks: Column, ranges: Column) -> Column:
        def inside(w: Column) -> Column:
            lo, hi = F.least(w["id"], w["head"]) + 1, F.greatest(w["id"], w["head"]) - 1
            k = F.floor(F.log2((hi - lo + 1).cast("double"))).cast("int")
            level = lambda i: F.get(F.get(ranges, k), i)
            both = _both(level(lo - 1), level((hi - F.pow(F.lit(2), k)).cast("int")))
            h = F.get(marks, w["head"] - 1)
            ok = lambda b: ((h["entry"] < b["entry"]) & (b["exit"] < h["exit"])) | F.coalesce((h["cycle"] == b["low"]) & (h["cycle"] == b["high"]), F.lit(False))
            return F.coalesce(let(both, then=ok), F.lit(False))

        return F.forall("words", lambda w: (w["head"] < 1) | (F.abs(w["id"] - w["head"]) <= 2) | inside(w))

    long = F.exists("words", lambda w: (w["head"] > 0) & (F.abs(w["id"] - w["head"]) > 2))
    test = lambda marks: let(marks, _ranges(marks), then=every)
    return F.when(~long, True).otherwise(let(labels() if marks is None else marks, then=test))


def problems() -> Column:
    """What is wrong with the tree: heads beyond the sentence, no root, cycles."""
    beyond = F.exists("words", lambda w: w["head"] > F.size("words"))
    no_root = ~F.exists("words", lambda w: w["head"] < 1)

    cycle = F.exists(labels(), lambda m: m["cycle"].isNotNull())
    flags = F.array(F.when(beyond, "head beyond the sentence"), F.when(no_root, "no root"), F.when(cycle, "cycle"))
    return F.filter(flags, lambda x: x.isNotNull())


def subtree(root: Column | int) -> Column:
    """The words at or below the word with this id, renumbered from 1; the top has head 0 and label `_`."""
    root = F.lit(root) if isinstance(root, int) else root
    kept = let(labels(), then=lambda marks: F.filter("words", lambda w: (w["id"] == root) | below(marks, w["id"], root)))
    number = lambda kept, ids: F.transform(kept, lambda w, i: w.withField("id", (i + 1).cast("int")).withField("head", F.when(w["id"] == root, F.lit(0)).otherwise(F.array_position(ids, w["head"]).cast("int"))).withField("deprel", F.when(w["id"] == root, F.lit("_")).otherwise(w["deprel"])))
    return let(kept, then=lambda kept: let(kept, F.transform(kept, lambda w: w["id"]), then=number))


def is_span(first: int, last: int) -> Column:
    """Words first to last have exactly one head outside of them."""
    return F.size(F.filter("words", lambda w: w["id"].between(first, last) & ~w["head"].between(first, last))) == 1


def longest_arc() -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter("words", lambda w: w["head"] > 0), lambda w: F.abs(w["id"] - w["head"]))), F.lit(0))


def children_with(token: Column, label: str) -> Column:
    """The token's dependents whose label matches."""
    return F.filter("words", lambda w: (w["head"] == token["id"]) & w["deprel"].rlike(rf"\A(?:{label})\z"))


def arc_heights() -> Column:
    """For each word the height of its arc when short arcs are drawn first: one more than the arcs stacked inside it."""
    arcs = F.array_sort(F.transform(F.filter("words", lambda w: w["head"] > 0), lambda w: F.struct(F.abs(w["id"] - w["head"]).alias("len"), w["id"].alias("id"), F.least(w["id"], w["head"]).alias("lo"), F.greatest(w["id"], w["head"]).alias("hi"))))
    start = F.array().cast("array<struct<id:int,lo:int,hi:int,height:int>>")

    def step(acc: Column, a: Column) -> Column:
        inner = F.array_max(F.transform(F.filter(acc, lambda x: (x["lo"] < a["hi"]) & (x["hi"] > a["lo"])), lambda x: x["height"]))
        return F.concat(acc, F.array(F.struct(a["id"], a["lo"], a["hi"], (F.coalesce(inner, F.lit(0)) + 1).alias("height"))))

    return F.aggregate(arcs, start, step)


def subtree_lines(root: Column | int, columns: tuple[str, ...]) -> Column:
    """The subtree at a word as token lines with these columns, among them ID and HEAD: what a search by example starts from."""
    from ..sources.conllu import _line

    if not {"ID", "HEAD"} <= set(columns):
        raise ValueError("a query tree needs the columns ID and HEAD")
    return F.array_join(F.transform(subtree(root), lambda w: _line(w, columns)), "\n")
