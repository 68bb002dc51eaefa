"""SD-parse text as sentences: a token line, then rel(head-n, dep-n) lines; a token may carry /TAG."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.let import let, settled

RELATION = r"\A\s*([^\s(]+)\s*\(\s*(\S+?)\s*,\s*(\S+?)\s*\)\s*\z"


def parse(blocks: DataFrame) -> DataFrame:
    """words and errors from blocks (`value`). A name may be form-n or, if the form occurs once, the form alone; ROOT-0 is the root."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    rows = settled(blocks.withColumn("lines_", lines), "lines_")
    tokens = F.filter(F.split(F.get("lines_", F.lit(0)), r"\s+"), lambda x: x != "")
    rows = settled(rows.withColumn("tokens_", tokens), "tokens_")
    rows = rows.withColumn("forms_", F.transform("tokens_", lambda x: F.regexp_replace(x, r"(?<=.)/[A-Za-z]+\z", ""))).withColumn("tags_", F.transform("tokens_", lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r".+/([A-Za-z]+)\z", 1), F.lit("")), F.lit("_"))))
    rows = settled(rows.withColumn("rels_", F.slice("lines_", F.lit(2), F.greatest(F.size("lines_") - 1, F.lit(0)))), "forms_", "tags_", "rels_")
    at = lambda name: F.coalesce(F.regexp_extract(name, r"-(\d+)\z", 1).try_cast("int"), F.when(name.rlike(r"-\d+\z"), F.lit(None)).otherwise(F.array_position("forms_", name).cast("int")))
    edge = lambda x: let(F.split(F.regexp_replace(x, RELATION, "$1\t$2\t$3"), "\t"), then=lambda e: F.struct(e[0].alias("rel"), at(e[1]).alias("head"), at(e[2]).alias("dep")))
    rows = settled(rows.withColumn("edges_", F.transform(F.filter("rels_", lambda x: x.rlike(RELATION)), edge)), "edges_")
    rows = settled(rows.withColumn("deps_", F.transform("edges_", lambda e: e["dep"])), "deps_")
    word = lambda f, i, e: F.struct(F.lit("WORD").alias("kind"), (i + 1).cast("int").alias("id"), F.lit(-1).alias("subid"), f.alias("form"), F.lit("_").alias("lemma"), F.get("tags_", i).alias("upos"), F.lit("_").alias("xpos"), F.coalesce(e["head"], F.lit(0)).alias("head"), F.coalesce(e["rel"], F.lit("root")).alias("deprel"))
    words = F.transform("forms_", lambda f, i: let(F.get("edges_", F.array_position("deps_", (i + 1).cast("int")).cast("int") - 1), then=lambda e: word(f, i, e)))
    wrong = F.filter(F.array(
        F.when(F.size("edges_") == 0, "no relation"), F.when(F.size("rels_") > F.size("edges_"), "unreadable relation"),
        F.when(F.exists("edges_", lambda e: ~e["dep"].between(1, F.size("forms_")) | ~e["head"].between(0, F.size("forms_"))), "unknown word"),
        F.when(F.size(F.array_distinct("deps_")) < F.size("edges_"), "two heads"),
    ), lambda x: x.isNotNull())
    return rows.select(*(c for c in blocks.columns if c != "value"), words.alias("words"), wrong.alias("errors"))
