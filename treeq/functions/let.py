"""Names for values inside an expression."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(*values: Column, then: Callable[..., Column]) -> Column:
    """`then` of the values, each evaluated once per row however often the result refers to it.

    An expression that refers to another from inside a lambda would evaluate it again for every element.
    """
    fields = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.get(F.transform(F.array(fields), lambda s: then(*(s[f"v{i}"] for i in range(len(values))))), F.lit(0))


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns computed once per row, at this place of the plan.

    Later expressions then refer to values. Else the optimizer could put a column's expression into the lambdas that refer to it, where
    it would be evaluated again for every element. Filters on other columns still pass.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names)))).select(df.columns)


_WORDS: ContextVar[Column | None] = ContextVar("words", default=None)


def the_words() -> Column:
    """The words that conditions and values look at: the column of the sentence, or those of `looking_at`."""
    words = _WORDS.get()
    return F.col("words") if words is None else words


@contextmanager
def looking_at(words: Column) -> Iterator[None]:
    """Conditions and values that are built inside look at these words instead of the sentence's."""
    token = _WORDS.set(words)
    try:
        yield
    finally:
        _WORDS.reset(token)
