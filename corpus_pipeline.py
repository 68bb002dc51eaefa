"""A training corpus from `documents`: quality, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
documents. run() writes what a stage returns as Parquet in the shared folder and rereads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm import mixing, neardup, packing, pii, quality
from treeq.llm.common import cut, drop, free


def once(docs: DataFrame) -> DataFrame:
    """docs with one row of those that are equal in id and text (of two that differ in other columns, either). Only rows that repeat are
    shuffled with their texts. Null ids and null texts are values like others."""
    key, row, mine = (free(docs, x) for x in ("key", "row", "text_hash"))
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias(key))
    often = cut(keyed.groupBy("id", key).agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias(row), F.col(key)))
    if often.isEmpty():
        return docs
    docs = docs.withColumn(mine, F.xxhash64("text"))
    same = docs["doc_id"].eqNullSafe(often[row]) & (docs[mine] == often[key])
    more = docs.join(often, same, "left_semi").dropDuplicates(["doc_id", mine])
    return docs.join(often, same, "left_anti").unionByName(more).drop(mine)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored as empty, very long ones whole; repeated rows are scored alike and all kept or all rejected; a score of 0.5 is kept.
    Columns of docs keep their names and values, whatever they are called; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, good = free(docs, "score"), free(docs, "predicted")
    return quality.quality(docs, labels, score_as=score, predicted_as=good).where(F.col(good) == 1).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (rows that repeat it: one).

    Rows without an id, null texts and texts without words are in no group and stay (repeated ones once); texts of any length are compared
    whole. Columns keep their names and values, whatever they are called; an empty table gives no rows.
    """
    kept = neardup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return once(docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; no row goes. Null and empty texts stay, very long ones are searched whole; overlaps are one mark, repeated rows
    are treated alike; n_chars follows, all other columns stay as they are; an empty table gives no rows."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, up to twice; one that it takes in part is cut after so many words.

    Rows that are equal in id and text are one here, with as much as the mixture takes of all of them. Null and empty texts, which have no words, are not taken; a null source is
    a source; ties are broken by hash and id. Columns keep their names and values, whatever they are called; an empty table gives no rows.
    """
    once_ = once(docs)
    key, id_, size, part, mine = (free(docs, x) for x in ("text_key", "id", "size", "part", "text_hash"))
    plan = mixing.mix(docs).where("taken > 0").select("doc_id", "text_key", "size", "taken")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    rest = F.when(F.col("taken") % F.col("size") > 0, F.array(F.col("taken") % F.col("size"))).otherwise(F.array().cast("array<bigint>"))
    parts = F.explode(F.concat(F.array_repeat("size", whole), rest))
    plan = plan.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("size").alias(size), parts.alias(part))
    rows = once_.withColumn(mine, F.xxhash64("text"))
    rows = rows.join(plan, rows["doc_id"].eqNullSafe(plan[id_]) & (rows[mine] == plan[key]))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut_text = F.array_join(F.slice(words, F.lit(1), F.col(part).cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col(part) == F.col(size), F.col("text")).otherwise(cut_text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the bins that they are packed into; null and empty texts have a row without a bin, very long ones fill whole
    bins first; repeated rows are packed each on its own, ties go by id; an empty table gives no rows (see `packing.pack`)."""
    return packing.pack(docs)


STAGES = [("quality_classifier", keep_good), ("ngram_jaccard_join", drop_near_duplicates), ("pii", redact_pii), ("mixing", mix_sources), ("best_fit_packing", pack_bins)]

#: SQL can express neither the network nor the trees; tests hold run()'s rows against plain Python, given the classifier's decisions and the fitted model of personal data.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            drop(before)
    return docs
