"""Corpus statistics, feature profiles, and scores of a system's annotation against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(sents: DataFrame) -> DataFrame:
    """One row: sentences, syntactic words, multiword tokens, empty words, surface words (words that a multiword token covers count once)."""
    covered = F.aggregate("mwts", F.lit(0), lambda a, m: a + m["subid"] - m["id"])
    return sents.agg(
        F.count("*").alias("sentences"), F.sum(F.size("words")).alias("syntactic_words"), F.sum(F.size("mwts")).alias("mwts"),
        F.sum(F.size("empties")).alias("empty_words"), F.sum(F.size("words") - covered).alias("surface_words"),
    )


def _words(sents: DataFrame, *fields: str) -> DataFrame:
    """One row per word, with these fields only."""
    return sents.select(F.inline(F.transform("words", lambda w: F.struct(*(w[f].alias(f) for f in fields)))))


def by_field(sents: DataFrame, *fields: str) -> DataFrame:
    """Frequency of the values of one or more token fields."""
    return _words(sents, *fields).groupBy(*fields).agg(F.count("*").alias("n"))


def by_feature(sents: DataFrame) -> DataFrame:
    """Frequency of each feature=value with each UPOS."""
    return _words(sents, "upos", "feats").select("upos", F.explode("feats").alias("name", "value")).groupBy("upos", "name", "value").agg(F.count("*").alias("n"))


def length_histogram(sents: DataFrame) -> DataFrame:
    return sents.groupBy((F.size("words") + F.size("empties")).alias("length")).agg(F.count("*").alias("n"))


def identical_groups(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts that occur more than once: count, smallest key, and their share of all rows in percent."""
    groups = rows.groupBy(text).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    total = rows.agg(F.count("*").alias("total"))
    return groups.where("n > 1").crossJoin(F.broadcast(total)).select(text, "n", "first", (F.col("n") * 100.0 / F.col("total")).alias("share"))  # total is one row


def feature_profile(sents: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per UPOS and feature: how many tokens that have features carry it, the rate in percent, its rank within the
    UPOS and whether the rate reaches the threshold. Both counts come from one pass with partial aggregation."""
    words = _words(sents, "upos", "feats").where(F.size("feats") > 0)
    both = words.select("upos", F.explode(F.concat(F.array(F.lit("")), F.map_keys("feats"))).alias("name")).groupBy("upos", "name").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    w = W.partitionBy("upos")  # as many rows as there are feature names
    out = both.withColumn("tokens", F.max(F.when(F.col("name") == "", F.col("n"))).over(w)).where("name <> ''")
    out = out.withColumn("rate", F.col("n") * 100.0 / F.col("tokens"))
    return out.withColumn("place", F.row_number().over(w.orderBy(F.col("n").desc(), "name"))).withColumn("keep", F.col("rate") >= threshold)


def feature_values(sents: DataFrame) -> DataFrame:
    """The sorted distinct values of each feature."""
    pairs = _words(sents, "feats").select(F.explode("feats").alias("name", "value")).distinct()
    return pairs.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("vals"))


def features_json(sents: DataFrame) -> DataFrame:
    """One row per feature: JSON of its permitted values by UPOS."""
    pairs = _words(sents, "upos", "feats").select("upos", F.explode("feats").alias("name", "value")).groupBy("name", "upos").agg(F.array_sort(F.collect_set("value")).alias("vals"))
    by = pairs.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("upos", "vals")))).alias("byupos"))
    return by.select("name", F.to_json(F.struct(F.lit(1).alias("permitted"), "byupos")).alias("json"))


SCORES = ("form", "lemma", "upos", "xpos", "feats", "head", "las", "deprel", "misc")


def _same(name: str, g: Column, s: Column) -> Column:
    if name == "las":
        return (g["head"] == s["head"]) & (g["deprel"] == s["deprel"])
    if name == "feats":
        return F.array_sort(F.map_entries(g["feats"])) == F.array_sort(F.map_entries(s["feats"]))
    return g[name].eqNullSafe(s[name])


def scores(gold: DataFrame, system: DataFrame, key: str, fields=("lemma", "upos", "xpos", "feats", "head", "las", "deprel", "misc")) -> DataFrame:
    """Per sentence the share of words on which both agree, by field; 0 where the lengths differ. One join on the key."""
    both = gold.select(key, F.col("words").alias("g")).join(system.select(key, F.col("words").alias("s")), key)
    n = F.size("g")

    def rate(name: str) -> Column:
        hits = F.size(F.filter(F.zip_with("g", "s", lambda g, s: _same(name, g, s)), lambda x: x))
        return F.when((n == F.size("s")) & (n > 0), hits / n).otherwise(F.lit(0.0)).alias(name)

    return both.select(key, *(rate(f) for f in fields))


def corpus_scores(gold: DataFrame, system: DataFrame, key: str, fields=("lemma", "upos", "xpos", "feats", "head", "las", "deprel", "misc")) -> DataFrame:
    """One row: the mean of the sentences' scores in percent."""
    return scores(gold, system, key, fields).agg(*(F.round(F.avg(f) * 100, 2).alias(f) for f in fields))


def different_words(gold: DataFrame, system: DataFrame, key: str, fields=("form", "lemma", "upos", "xpos", "feats", "head", "deprel")) -> DataFrame:
    """Ids of the words that differ in any of the fields, in sentences of equal length."""
    both = gold.select(key, F.col("words").alias("g")).join(system.select(key, F.col("words").alias("s")), key)

    def differs(g: Column, s: Column) -> Column:
        out = F.lit(False)
        for f in fields:
            out = out | ~_same(f, g, s)
        return out

    marked = F.filter(F.zip_with("g", "s", lambda g, s: F.struct(g["id"].alias("id"), differs(g, s).alias("d"))), lambda x: x["d"])
    # as a filter, equal lengths would become a key of the join, and sentences that lie by key would be exchanged again
    return both.select(key, F.explode(F.when(F.size("g") == F.size("s"), marked)).alias("x")).select(key, F.col("x.id").alias("id"))


def annotation_errors(sents: DataFrame, uposs: list[str], deprels: list[str]) -> DataFrame:
    """One row: invalid UPOS and labels, roots beyond the first, words labelled root without head 0 or the other way round."""
    bad = lambda test: F.sum(F.size(F.filter("words", test)))
    return sents.agg(
        bad(lambda w: (w["upos"] != "_") & ~w["upos"].isin(uposs)).alias("upos"), bad(lambda w: ~w["deprel"].isin(deprels)).alias("deprels"),
        F.sum(F.greatest(F.size(F.filter("words", lambda w: w["head"] == 0)) - 1, F.lit(0))).alias("extra_roots"),
        bad(lambda w: (w["head"] == 0) != (w["deprel"] == "root")).alias("root_labels"),
    )
