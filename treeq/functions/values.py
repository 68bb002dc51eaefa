"""Values for updates: what a token's new column is computed from. Missing heads give the empty string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditions import feature
from .let import the_words

Value = Callable[[Column], Column]


def _read(t: Column, name: str) -> Column:
    low = name.lower()
    if low.startswith("feat_"):
        return feature(t, name[5:])
    if low.startswith("misc_"):
        return F.get(F.transform(F.filter(t["misc"], lambda m: m["key"] == name[5:]), lambda m: m["val"]), F.lit(0))
    if low == "headid":
        return t["head"].cast("string")
    return t[low]


def this(name: str) -> Value:
    """A column of the token: form, lemma, upos, xpos, deprel, headid, Feat_X or Misc_X."""
    return lambda t: F.coalesce(_read(t, name), F.lit(""))


def head(name: str, up: int = 1) -> Value:
    """A column of the head, or of the head's head (up=2), and so on."""
    def get(t: Column) -> Column:
        for _ in range(up):
            t = F.get(the_words(), t["head"] - 1)
        return F.coalesce(_read(t, name), F.lit(""))

    return get


def literal(text: str) -> Value:
    return lambda t: F.lit(text)


def concat(*parts: Value) -> Value:
    return lambda t: F.concat(*(p(t) for p in parts))


def substring(v: Value, start: int, end: int | None = None) -> Value:
    """Characters start (from 0) to end (exclusive); unchanged where they lie outside."""
    def cut(t: Column) -> Column:
        x, n = v(t), F.length(v(t))
        stop = n if end is None else F.lit(end)
        return F.when((F.lit(start) <= stop) & (stop <= n), F.substring(x, F.lit(start + 1), stop - start)).otherwise(x)

    return cut


def replace(v: Value, pattern: str, by: str) -> Value:
    return lambda t: F.regexp_replace(v(t), pattern, by)


def upper(v: Value) -> Value:
    return lambda t: F.upper(v(t))


def lower(v: Value) -> Value:
    return lambda t: F.lower(v(t))


def capitalised(v: Value) -> Value:
    """First character in upper case, the rest in lower case."""
    return lambda t: F.concat(F.upper(F.substring(v(t), 1, 1)), F.lower(F.substring(v(t), F.lit(2), F.length(v(t)))))
