"""Lists of permitted values as small tables: plain lines, feature lines, and the JSON of Universal Dependencies' tools."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def values(spark: SparkSession, path: str) -> DataFrame:
    """(value) one per line; blank lines and # comments are skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("value"))
    return rows.where("value <> '' and not startswith(value, '#')").distinct()


def features(spark: SparkSession, path: str) -> DataFrame:
    """(scope, tag, name, value) from lines "Name=Value" (scope any), "U:TAG Name ..." (upos) and "X:TAG Name ..." (xpos); value is null where only a name is given."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    scope = F.when(F.col("line").startswith("U:"), "upos").when(F.col("line").startswith("X:"), "xpos").otherwise("any")
    words = F.split(F.regexp_replace("line", r"\A[UX]:", ""), r"\s+")
    rows = rows.select(scope.alias("scope"), words.alias("w"))
    tag = F.when(F.col("scope") == "any", F.lit(None)).otherwise(F.get("w", F.lit(0)))
    names = F.when(F.col("scope") == "any", F.col("w")).otherwise(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))))
    rows = rows.select("scope", tag.alias("tag"), F.explode(names).alias("item"))
    return rows.select("scope", "tag", F.substring_index("item", "=", 1).alias("name"), F.when(F.col("item").contains("="), F.substring_index("item", "=", -1)).alias("value")).distinct()


def features_of_json(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(upos, name, value) that a feats.json permits for a language: universal and local values, by UPOS where listed."""
    kind = "map<string,map<string,map<string,struct<permitted:int,uvalues:array<string>,lvalues:array<string>,byupos:map<string,map<string,int>>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("j"))
    rows = rows.select(F.explode(F.try_element_at(F.try_element_at("j", F.lit("features")), F.lit(lang))).alias("name", "f")).where("f.permitted = 1")
    by = rows.select("name", F.explode("f.byupos").alias("upos", "vals")).select("upos", "name", F.explode("vals").alias("value", "ok")).where("ok = 1").drop("ok")
    free = rows.where("f.byupos is null").select(F.lit("*").alias("upos"), "name", F.explode(F.concat(F.coalesce("f.uvalues", F.array()), F.coalesce("f.lvalues", F.array()))).alias("value"))
    return by.unionByName(free)


def feature_rules(spark: SparkSession, paths: list[str], lang: str | None = None, unused: bool = False) -> DataFrame:
    """(scope, tag, name, value): what `validate.feature_codes` takes, from lists in text and feats.json files together.

    Scope any: a permitted value of a feature. Scope upos or xpos: a feature that a tag may have, with this value or, where it is null, with any permitted one; the tag
    `*` stands for all tags. A feats.json gives a language's permitted features with universal and local values and, where they are listed, the tags and values by UPOS
    (features without such a list go with every tag); without a language the features that some language has as universal and global, whose values count used or
    not. `unused` adds a language's unused values."""
    out = None
    for path in paths:
        part = _rules_of_json(spark, path, lang, unused) if path.endswith(".json") else _rules_of_text(spark, path)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "scope string, tag string, name string, value string")
    return out.distinct()


def _rules_of_text(spark: SparkSession, path: str) -> DataFrame:
    rows = features(spark, path)
    # a tag's list has names; values are those permitted anywhere
    return rows.withColumn("value", F.when(F.col("scope") == "any", F.coalesce("value", F.lit(""))))


def _rules_of_json(spark: SparkSession, path: str, lang: str | None, unused: bool) -> DataFrame:
    lists_ = "uvalues:array<string>,lvalues:array<string>,unused_uvalues:array<string>,unused_lvalues:array<string>"
    kind = f"map<string,map<string,map<string,struct<type:string,doc:string,permitted:int,{lists_},byupos:map<string,map<string,int>>>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.try_element_at(F.from_json("value", kind), F.lit("features"))).alias("lang", "fs"))
    rows = rows.select("lang", F.explode("fs").alias("name", "f"))
    if lang is None:
        rows, names = rows.where("f.type = 'universal' and f.doc = 'global'"), ["uvalues", "unused_uvalues"]
    else:
        rows, names = rows.where((F.col("lang") == lang) & (F.col("f.permitted") == 1)), ["uvalues", "lvalues"] + (["unused_uvalues", "unused_lvalues"] if unused else [])
    none = F.array().cast("array<string>")
    values_ = rows.select("name", F.explode(F.concat(*(F.coalesce(f"f.{n}", none) for n in names))).alias("value"))
    out = values_.select(F.lit("any").alias("scope"), F.lit(None).cast("string").alias("tag"), "name", "value")
    if lang is None:
        return out
    by = rows.select("name", F.explode("f.byupos").alias("tag", "vals")).select("tag", "name", F.explode("vals").alias("value", "ok")).where("ok = 1")
    free = rows.where("f.byupos is null").select(F.lit("*").alias("tag"), "name", F.lit(None).cast("string").alias("value"))
    tagged = by.select("tag", "name", "value").unionByName(free)
    return out.unionByName(tagged.select(F.lit("upos").alias("scope"), "tag", "name", "value"))


def labels_of_json(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(value) the relations that a deprels.json permits for a language."""
    kind = "map<string,map<string,map<string,struct<permitted:int>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("j"))
    return rows.select(F.explode(F.try_element_at(F.try_element_at("j", F.lit("deprels")), F.lit(lang))).alias("value", "f")).where("f.permitted = 1").select("value")


def listed(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """The values of a list file for a condition, such as form(listed(spark, path)); none if the file can't be read. A list of more than `most` values is
    an error: join it instead (`search.tokens_listed`)."""
    try:
        rows = values(spark, path).limit(most + 1).collect()
    except AnalysisException:
        return []
    if len(rows) > most:
        raise ValueError(f"{path} has more than {most} values")
    return sorted(r.value for r in rows)
