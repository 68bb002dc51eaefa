"""Corpus jobs that chain operators: mass edits with a report, checks with a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Cond
from ..operators.edit import Rule, apply_rules
from ..operators.validate import implications


def mass_edit(sents: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(edited sentences, changes by rule)."""
    out = apply_rules(sents, rules)
    report = out.select(F.posexplode("changes").alias("rule", "n")).groupBy((F.col("rule") + 1).alias("rule")).agg(F.sum("n").alias("changes"))
    return out.drop("changes"), report


def check(sents: DataFrame, rules: list[tuple[Cond, Cond]], *keys: str) -> DataFrame:
    """rule, violations, sentences: a summary of implication rules over the corpus."""
    bad = implications(sents, rules, *keys)
    return bad.groupBy("rule").agg(F.count("*").alias("violations"), F.count_distinct(*keys).alias("sentences"))
