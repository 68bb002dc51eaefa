"""Searches over sentences: ids, comments, surface text, sequences, label paths, query-by-example, positions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Cond, full
from ..functions.let import let, settled
from ..functions.text import offsets, surface


def by_id(sents: DataFrame, pattern: str, column: str = "sent_id") -> DataFrame:
    """The id contains a match of the regular expression."""
    return sents.where(F.col(column).cast("string").rlike(pattern))


def by_exact_id(sents: DataFrame, wanted: str, column: str = "sent_id") -> DataFrame:
    return sents.where(F.lower(F.col(column).cast("string")) == wanted.lower())


def by_comment(sents: DataFrame, part: str) -> DataFrame:
    return sents.where(F.exists("comments", lambda c: c.contains(part)))


def by_text_or_tag(sents: DataFrame, pattern: str) -> DataFrame:
    """The text contains a match, or a UPOS or XPOS matches as a whole."""
    return sents.where(F.col("text").rlike(pattern) | F.exists("words", lambda w: full(w["upos"], pattern) | full(w["xpos"], pattern)))


def surface_hits(sents: DataFrame, needle: str, *keys: str) -> DataFrame:
    """(keys, at, ids): every place (from 0) of a string in the sentence's surface text, and the words that it touches. Multiword tokens stand for their
    words, blanks are as MISC says; hits may overlap."""
    needle = needle.strip("\"'")
    if not needle:
        raise ValueError("nothing to look for")
    n = len(needle)
    places = lambda text: F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - n, F.lit(0))), lambda i: F.substring(text, i + 1, F.lit(n)) == needle)
    rows = sents.withColumn("text_", surface()).where(F.contains("text_", F.lit(needle)))
    rows = settled(rows.withColumn("places_", let(F.col("text_"), then=places)).withColumn("spans_", offsets()), "places_", "spans_")
    ids = F.transform(F.filter("spans_", lambda s: (s["start"] < F.col("at") + n) & (s["end"] > F.col("at"))), lambda s: s["id"])
    return rows.select(*keys, "spans_", F.explode("places_").alias("at")).select(*keys, "at", ids.alias("ids"))


def sequence_of(sents: DataFrame, conds: list[Cond], *keys: str) -> DataFrame:
    """key, start: every place where adjacent words satisfy the conditions one after another."""
    def here(w: Column) -> Column:
        out = F.lit(True)
        for k, c in enumerate(conds):
            at = F.get("words", w["id"] - 1 + k)
            out = out & at.isNotNull() & c(at)
        return out

    starts = F.transform(F.filter("words", here), lambda w: w["id"])
    return sents.select(*keys, F.explode(starts).alias("start"))


def deprel_path(start: str, *steps: tuple[str, str]) -> Cond:
    """A word with this label from which a path of labels leads on: ">" to its head, "<" to a dependent, "=" to a sibling."""
    def on(t: Column, left: tuple) -> Column:
        if not left:
            return F.lit(True)
        (way, label), rest = left[0], left[1:]
        if way == ">":
            h = F.get("words", t["head"] - 1)
            return F.coalesce((t["head"] > 0) & (h["deprel"] == label) & on(h, rest), F.lit(False))
        near = (lambda w: w["head"] == t["id"]) if way == "<" else (lambda w: (w["head"] == t["head"]) & (w["id"] != t["id"]) & (t["head"] > 0))
        return F.exists("words", lambda w: near(w) & (w["deprel"] == label) & on(w, rest))

    return Cond(lambda t: (t["deprel"] == start) & on(t, steps))


@dataclass
class Example:
    """A node of a query tree: a condition on the word, and children that dependents must match."""

    cond: Cond
    children: list[Example] = field(default_factory=list)


def example(tree: Example) -> Cond:
    """Words that a query tree matches from the top down; word order is ignored, children may share a word."""
    def test(t: Column, node: Example) -> Column:
        out = node.cond(t)
        for c in node.children:
            out = out & F.exists("words", below(t, c))
        return out

    def below(t: Column, c: Example):
        return lambda w: (w["head"] == t["id"]) & test(w, c)

    return Cond(lambda t: test(t, tree))


def any_example(trees: Iterable[Example]) -> Cond:
    """Words that one of several query trees matches."""
    out = Cond(lambda t: F.lit(False))
    for tree in trees:
        out = out | example(tree)
    return out


def example_words(tree: Example) -> Callable[[Column], Column]:
    """For a word the ids of all words that stand for some node of the query tree with it at the top, sorted; null if it doesn't match."""
    def seen(t: Column, node: Example) -> Column:
        return F.when(node.cond(t), _together(t, [_witnesses("words", lambda w: w["head"] == t["id"], below(c)) for c in node.children]))

    def below(c: Example) -> Callable[[Column], Column]:
        return lambda w: seen(w, c)

    return lambda t: F.array_sort(F.array_distinct(seen(t, tree)))


def path_words(start: str, *steps: tuple[str, str]) -> Callable[[Column], Column]:
    """For a word the ids of all words on some path of labels from it, as `deprel_path` goes, itself included, sorted; null if there is none."""
    def on(t: Column, left: tuple) -> Column:
        if not left:
            return F.array(t["id"])
        (way, label), rest = left[0], left[1:]
        near = {
            ">": lambda w: (w["id"] == t["head"]), "<": lambda w: w["head"] == t["id"],
            "=": lambda w: (w["head"] == t["head"]) & (w["id"] != t["id"]) & (t["head"] > 0),
        }[way]
        return _together(t, [_witnesses("words", lambda w: near(w) & (w["deprel"] == label), lambda w: on(w, rest))])

    return lambda t: F.array_sort(F.array_distinct(F.when(t["deprel"] == start, on(t, steps))))


def _witnesses(words: str, near: Callable[[Column], Column], seen: Callable[[Column], Column]) -> Column:
    """The ids that `seen` gives for the words nearby; null if it gives none."""
    found = F.filter(F.transform(F.filter(words, near), seen), lambda x: x.isNotNull())
    return let(found, then=lambda found: F.when(F.size(found) > 0, F.flatten(found)))


def _together(t: Column, parts: list[Column]) -> Column:
    """The word's id with those of all parts; null if a part is."""
    return F.concat(F.array(t["id"]), *parts) if parts else F.array(t["id"])


def hits(sents: DataFrame, words: Callable[[Column], Column], *keys: str) -> DataFrame:
    """(keys, id, ids): each word for which `example_words` or `path_words` finds something, with the ids to highlight."""
    found = F.transform("words", lambda w: F.struct(w["id"].alias("id"), words(w).alias("ids")))
    return sents.select(*keys, F.inline(F.filter(found, lambda x: x["ids"].isNotNull())))


def first_token(sents: DataFrame, c: Cond, *keys: str, kinds: tuple[str, ...] = ("words", "empties", "mwts")) -> DataFrame:
    """key and the first token that satisfies c: words first, then empty words, then multiword tokens."""
    found = F.filter(F.concat(*(F.col(k) for k in kinds)), lambda t: c(t))
    rows = sents.select(*keys, F.get(found, F.lit(0)).alias("t")).where("t is not null")
    return rows.select(*keys, "t.kind", "t.id", "t.form")


def after(hits: DataFrame, position: str, current: int, backwards: bool = False) -> DataFrame:
    """The next hit from a position, or the one before it; it doesn't wrap around. A top-1, not a sort."""
    col = F.col(position)
    return hits.where(col < current).orderBy(col.desc()).limit(1) if backwards else hits.where(col > current).orderBy(col).limit(1)


def nth(sents: DataFrame, position: str, n: int) -> DataFrame:
    return sents.where(F.col(position) == n)


def tokens_listed(sents: DataFrame, values: DataFrame, field: str, *keys: str) -> DataFrame:
    """Key columns and the fields of each word whose field is a `value` of a table: a join, so lists may be of any size."""
    words = sents.select(*keys, F.inline("words"))
    return words.join(values.select(F.col("value").alias(field)).distinct(), field, "left_semi").select(*keys, *(c for c in words.columns if c not in keys))
