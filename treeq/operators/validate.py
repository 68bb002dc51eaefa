"""Validation: implications, lists of permitted values, features, text against forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Cond
from ..functions.text import first_difference, surface


def implications(sents: DataFrame, rules: list[tuple[Cond, Cond]], *keys: str) -> DataFrame:
    """key, rule, id: words for which a rule's first condition holds but not its second. All rules in one pass."""
    def bad(k: int, test: Cond, then: Cond) -> Column:
        return F.transform(F.filter("words", lambda w: test(w) & ~then(w)), lambda w: F.struct(F.lit(k).alias("rule"), w["id"].alias("id")))

    found = F.concat(*(bad(k + 1, a, b) for k, (a, b) in enumerate(rules)))
    return sents.select(*keys, F.inline(found))


def permitted(sents: DataFrame, uposs: list[str], xposs: list[str], deprels: list[str], *keys: str) -> DataFrame:
    """key, id and which of upos, xpos, deprel are not in the lists; `_` passes for upos and xpos, not for deprel."""
    def wrong(w: Column) -> Column:
        flags = F.array(
            F.when((w["upos"] != "_") & ~w["upos"].isin(uposs), "upos"), F.when((w["xpos"] != "_") & ~w["xpos"].isin(xposs), "xpos"), F.when(~w["deprel"].isin(deprels), "deprel")
        )
        return F.struct(w["id"].alias("id"), F.array_join(F.filter(flags, lambda x: x.isNotNull()), "+").alias("wrong"))

    return sents.select(*keys, F.inline(F.filter(F.transform("words", wrong), lambda x: x["wrong"] != "")))


def feature_codes(sents: DataFrame, allowed: DataFrame, *keys: str) -> DataFrame:
    """key, id, name, code: 1 for a feature name that is not allowed, at all or with the word's UPOS or XPOS, 2 for a value that is not; allowed
    ones are left out. `allowed` has (upos, name, value), where the UPOS `*` stands for every one, or (scope, tag, name, value) as `lists.feature_rules` gives them: then
    a tag without a list of its own has no restriction. Joins by name and by tag, so lists may be of any size."""
    token = lambda w: F.struct(*(w[f].alias(f) for f in ("id", "upos", "xpos", "feats")))
    feats = sents.select(*keys, F.inline(F.transform("words", token))).select(*keys, "id", "upos", "xpos", F.explode("feats").alias("name", "value"))
    code = _codes_by_scope(feats, allowed) if "scope" in allowed.columns else _codes_by_upos(feats, allowed)
    return code.where("code > 0").select(*keys, "id", "name", "code")


def _codes_by_upos(feats: DataFrame, allowed: DataFrame) -> DataFrame:
    sets = allowed.where("upos <> '*'").groupBy("upos", "name").agg(F.collect_set("value").alias("vals_"))
    every = allowed.where("upos = '*'").groupBy("name").agg(F.collect_set("value").alias("every_"))
    rows = feats.join(sets, ["upos", "name"], "left").join(every, "name", "left")
    none = F.array().cast("array<string>")
    vals = F.concat(F.coalesce("vals_", none), F.coalesce("every_", none))
    return rows.withColumn("code", F.when(F.col("vals_").isNull() & F.col("every_").isNull(), 1).when(~F.array_contains(vals, F.col("value")), 2).otherwise(0))


def _codes_by_scope(feats: DataFrame, rules: DataFrame) -> DataFrame:
    """By specificity: the name's values, then what the UPOS and the XPOS may have."""
    values = rules.where("scope = 'any'").groupBy("name").agg(F.collect_set("value").alias("vals_"))
    free = rules.where("tag = '*'").select("name", F.lit(True).alias("free_")).distinct()
    rows = feats.join(values, "name", "left").join(free, "name", "left")
    code = F.when(F.col("vals_").isNull(), 1).when(~F.array_contains("vals_", F.col("value")), 2)
    for scope in ("upos", "xpos"):
        own = rules.where((F.col("scope") == scope) & (F.col("tag") != "*"))
        # what a tag may have: a row for each of its names, and one that says that it has a list
        names = own.groupBy(F.col("tag").alias(scope), "name").agg(F.collect_set("value").alias(f"{scope}_vals_"), F.lit(True).alias(f"{scope}_has_"))
        rows = rows.join(names, [scope, "name"], "left").join(own.select(F.col("tag").alias(scope), F.lit(True).alias(f"{scope}_list_")).distinct(), scope, "left")
        missing = F.col(f"{scope}_list_").isNotNull() & F.col(f"{scope}_has_").isNull() & F.col("free_").isNull()
        other = (F.size(f"{scope}_vals_") > 0) & ~F.array_contains(f"{scope}_vals_", F.col("value"))
        code = code.when(missing, 1).when(other, 2)
    return rows.withColumn("code", code.otherwise(0))


def text_mismatch(sents: DataFrame, *keys: str) -> DataFrame:
    """key, at: where the text differs from the forms first."""
    return sents.select(*keys, first_difference(F.col("text"), surface()).alias("at")).where("at >= 0")
