"""Token conditions as composable objects, compiled to Column expressions over a sentence row.

    tokens_where(sents, upos("R") & head(upos("N")))

A condition is two-valued: a missing head, neighbour, feature or value makes it false, so `~head(c)` holds for roots.
Regular expressions match the whole value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .let import the_words

class Got:
    """A list of values of a token, null where there is nothing to take one from; `parts` as those of a condition."""

    def __init__(self, get: Callable[[Column], Column], parts: tuple = ()):
        self.get, self.parts = get, parts

    def __call__(self, token: Column) -> Column:
        return self.get(token)


#: A function of the token alone will do, too.
Getter = Got | Callable[[Column], Column]


class Cond:
    """A predicate on a token (a struct column) of the sentence row it is evaluated in.

    `parts` says how it is made of others, (name, ...): with them `operators.tokens` evaluates it over a table of tokens. Without parts it looks at
    the token alone."""

    def __init__(self, test: Callable[[Column], Column], parts: tuple = ()):
        self.test, self.parts = test, parts

    def __call__(self, token: Column) -> Column:
        return F.coalesce(self.test(token), F.lit(False))

    def __and__(self, other: Cond) -> Cond:
        return Cond(lambda t: self(t) & other(t), ("and", self, other))

    def __or__(self, other: Cond) -> Cond:
        return Cond(lambda t: self(t) | other(t), ("or", self, other))

    def __invert__(self) -> Cond:
        return Cond(lambda t: ~self(t), ("not", self))


def full(value: Column, pattern: str) -> Column:
    return value.rlike(rf"\A(?:{pattern})\z")


def _text(field: str) -> Callable[[str | Iterable[str]], Cond]:
    def build(pattern: str | Iterable[str]) -> Cond:
        if isinstance(pattern, str):
            return Cond(lambda t: full(t[field], pattern))
        listed = sorted(pattern)
        return Cond(lambda t: t[field].isin(listed))

    build.__doc__ = f"The {field} matches a regular expression, or is in a list."
    return build


upos, xpos, lemma, form, deprel = (_text(f) for f in ("upos", "xpos", "lemma", "form", "deprel"))


def feature(t: Column, name: str) -> Column:
    """A feature's value by case-insensitive name; null if there is none."""
    return F.get(F.map_values(F.map_filter(t["feats"], lambda k, v: F.lower(k) == name.lower())), F.lit(0))


def feat(name: str, value: str | None = None) -> Cond:
    """The feature is there, with a value that matches if one is given."""
    return Cond(lambda t: feature(t, name).isNotNull() if value is None else full(feature(t, name), value))


def misc(name: str, value: str | None = None) -> Cond:
    """MISC has the key (case matters), with a value that matches if one is given; a key without value never matches one."""
    return Cond(lambda t: F.exists(t["misc"], lambda m: (m["key"] == name) & (F.lit(True) if value is None else F.coalesce(full(m["val"], value), F.lit(False)))))


def token_id(n: int) -> Cond:
    return Cond(lambda t: t["id"] == n)


def head_id(n: int, relative: bool = False) -> Cond:
    return Cond(lambda t: t["head"] == (t["id"] + n if relative else F.lit(n)))


def eud(rel: str, head: int | None = None, relative: bool = False) -> Cond:
    """An enhanced edge of this label, from this head (own id plus `head` if relative), or from any."""
    where = lambda t, d: F.lit(True) if head is None else d["headid"] == (t["id"] + head if relative else F.lit(head))
    return Cond(lambda t: F.exists(t["deps"], lambda d: (d["deprel"] == rel) & where(t, d)))


def mwt(length: int) -> Cond:
    return Cond(lambda t: (t["kind"] == "MWT") & (t["subid"] + 1 - t["id"] == length))


is_mwt, is_empty = Cond(lambda t: t["kind"] == "MWT"), Cond(lambda t: t["kind"] == "EMPTY")
_is_word = lambda t: t["kind"] == "WORD"


def head(c: Cond) -> Cond:
    """The head is a word for which c holds; false for roots, multiword and empty tokens."""
    return Cond(lambda t: (t["head"] > 0) & _is_word(t) & F.get(the_words(), t["head"] - 1).isNotNull() & c(F.get(the_words(), t["head"] - 1)), ("head", c))


def child(c: Cond) -> Cond:
    """Some dependent satisfies c."""
    return Cond(lambda t: _is_word(t) & F.exists(the_words(), lambda w: (w["head"] == t["id"]) & c(w)), ("child", c))


def prec(c: Cond) -> Cond:
    """c holds for the word before."""
    return Cond(lambda t: (t["id"] > 1) & F.get(the_words(), t["id"] - 2).isNotNull() & c(F.get(the_words(), t["id"] - 2)), ("prec", c))


def next_(c: Cond) -> Cond:
    """c holds for the word after."""
    return Cond(lambda t: F.get(the_words(), t["id"]).isNotNull() & c(F.get(the_words(), t["id"])), ("next", c))


# values for comparisons: lists, null where there is nothing to take one from


def value(field: str) -> Getter:
    return Got(lambda t: F.array(t[field]))


def feat_value(name: str) -> Getter:
    return Got(lambda t: F.when(feature(t, name).isNotNull(), F.array(feature(t, name))))


def of_head(g: Getter) -> Getter:
    return Got(lambda t: F.when((t["head"] > 0) & F.get(the_words(), t["head"] - 1).isNotNull(), g(F.get(the_words(), t["head"] - 1))), ("head", g))


def of_prec(g: Getter) -> Getter:
    return Got(lambda t: F.when((t["id"] > 1) & F.get(the_words(), t["id"] - 2).isNotNull(), g(F.get(the_words(), t["id"] - 2))), ("prec", g))


def of_next(g: Getter) -> Getter:
    return Got(lambda t: F.when(F.get(the_words(), t["id"]).isNotNull(), g(F.get(the_words(), t["id"]))), ("next", g))


def of_child(g: Getter) -> Getter:
    return Got(lambda t: F.flatten(F.filter(F.transform(F.filter(the_words(), lambda w: w["head"] == t["id"]), g.__call__), lambda x: x.isNotNull())), ("child", g))


def same(a: Getter, b: Getter) -> Cond:
    """Some value of a equals some value of b; `_` equals nothing."""
    return Cond(lambda t: F.arrays_overlap(F.array_remove(a(t), "_"), F.array_remove(b(t), "_")), ("same", a, b))


def compatible(a: Getter, b: Getter) -> Cond:
    """No value to compare on one side, an undefined one (`_`), or an equal pair."""
    either = lambda x, y: F.array_contains(x, "_") | F.array_contains(y, "_") | F.arrays_overlap(x, y)
    return Cond(lambda t: F.when(a(t).isNull() | b(t).isNull(), True).otherwise(either(a(t), b(t))), ("compatible", a, b))


def tokens_where(sents: DataFrame, c: Cond, *keys: str, kinds: tuple[str, ...] = ("words",)) -> DataFrame:
    """Key columns and the fields of each token that satisfies c. Nothing is shuffled, and sentences are not copied per token."""
    found = sents.select(*keys, F.filter(F.concat(*(F.col(k) for k in kinds)) if len(kinds) > 1 else F.col(kinds[0]), lambda t: c(t)).alias("found_"))
    return found.where(F.size("found_") > 0).select(*keys, F.inline("found_"))


def sentences_where(sents: DataFrame, c: Cond) -> DataFrame:
    return sents.where(F.exists("words", lambda t: c(t)))
