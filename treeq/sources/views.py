"""Treebank views over the star-schema and text tables: deterministic sentences for queries and benchmarks.

`orders`: an order is a sentence, its line items are tokens. The head of token i is i - 1 in orders with an even key
(a chain) and i div 2 in others (a heap, which has crossing arcs). `lines`: a line of a document is a sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.let import settled


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def orders(spark: SparkSession, sf_dir: str, changed: bool = False, per: int = 0) -> DataFrame:
    """sent, words, mwts, empties, text. With `changed`, a system's version with some wrong tags, heads and labels. With `per`, also grp, which sentences
    of so many keys share: they are dealt to tasks by it, so what groups, joins or orders them inside a grp needs no exchange."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    upos, rel = F.col("l_returnflag"), F.concat(F.lit("dep"), F.col("l_linenumber") % 5)
    if changed:
        upos = F.when(F.col("l_partkey") % 7 == 0, "X").otherwise(upos)
        rel = F.when(F.col("l_partkey") % 13 == 0, "dep9").otherwise(rel)
    misc = F.array(F.struct(F.lit("Line").alias("key"), F.col("l_linenumber").cast("string").alias("val")))
    gloss = F.array(F.struct(F.lit("Gloss").alias("key"), F.col("p_brand").alias("val")))
    key = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount", "p_name", "p_type", "p_brand", "p_size")
    made = (
        upos.alias("upos"), rel.alias("rel"), F.floor(F.col("p_size") / 10).cast("string").alias("size"), (F.col("l_discount") > 0.05).alias("disc"),
        (F.col("l_partkey") % 11 == 0).alias("wrong"), F.when(F.col("p_size") % 2 == 0, F.concat(misc, gloss)).otherwise(misc).alias("misc"),
    )
    rows = rows.select(F.col("l_orderkey").alias("sent"), *key)
    rows, keys = (rows.withColumn("grp", F.floor(F.col("sent") / per)).repartition("grp"), ["grp", "sent"]) if per else (rows.repartition("sent"), ["sent"])
    # structs are made of what has been dealt, which is a third of their size and the same for both versions, and before rows of an order come together: inside the
    # aggregate or a lambda, Spark would interpret what makes them
    sents = rows.select(*keys, F.struct(*key, *made).alias("item")).groupBy(*keys).agg(F.sort_array(F.collect_list("item")).alias("items"))

    def token(x, i):
        tid = (i + 1).cast("int")
        head = F.when(F.col("sent") % 2 == 0, i.cast("int")).otherwise(F.shiftright(tid, 1))
        if changed:
            head = F.when(x["wrong"] & (head > 1), head - 1).otherwise(head)
        rel = F.when(i == 0, "root").otherwise(x["rel"])
        edge = F.struct(head.alias("headid"), F.lit(-1).alias("headsubid"), rel.alias("deprel"))
        more = F.struct((tid - 2).alias("headid"), F.lit(-1).alias("headsubid"), F.lit("ext").alias("deprel"))
        feats = F.when(x["disc"], F.create_map(F.lit("Size"), x["size"], F.lit("Disc"), F.lit("Yes"))).otherwise(F.create_map(F.lit("Size"), x["size"]))
        return F.struct(
            F.lit("WORD").alias("kind"), tid.alias("id"), F.lit(-1).alias("subid"), x["p_name"].alias("form"), x["p_type"].alias("lemma"), x["upos"].alias("upos"), x["l_linestatus"].alias("xpos"),
            feats.alias("feats"), head.alias("head"), rel.alias("deprel"), F.when(tid > 2, F.array(edge, more)).otherwise(F.array(edge)).alias("deps"), x["misc"].alias("misc"),
        )

    sents = settled(sents.select(*keys, F.transform("items", token).alias("words")), "words")
    none = F.array().cast(sents.schema["words"].dataType)

    def other(kind: str, tid, sub, form, upos: str):
        w = F.get("words", F.lit(0))
        return F.struct(F.lit(kind).alias("kind"), F.lit(tid).alias("id"), F.lit(sub).alias("subid"), form.alias("form"), F.lit("_").alias("lemma"), F.lit(upos).alias("upos"), F.lit("_").alias("xpos"), F.create_map().cast("map<string,string>").alias("feats"), F.lit(-1).alias("head"), F.lit("_").alias("deprel"), F.slice(w["deps"], 1, 0).alias("deps"), F.slice(w["misc"], 1, 0).alias("misc"))

    both = F.concat(F.get("words", F.lit(0))["form"], F.get("words", F.lit(1))["form"])
    sents = sents.withColumn("mwts", F.when((F.col("sent") % 3 == 0) & (F.size("words") > 2), F.array(other("MWT", 1, 2, both, "_"))).otherwise(none))
    sents = sents.withColumn("empties", F.when(F.col("sent") % 5 == 0, F.array(other("EMPTY", 1, 1, F.lit("gap"), "E"))).otherwise(none))
    return sents.withColumn("text", F.array_join(F.transform("words", lambda w: w["form"]), " "))


#: The same tokens as SQL rows: `tok` (words), `sys` (changed words). For differential tests.
ORDERS_SQL = """
WITH raw AS (
  SELECT l_orderkey AS sent, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id,
    p_name AS form, p_type AS lemma, l_returnflag AS upos, l_linestatus AS xpos, CAST(p_size // 10 AS VARCHAR) AS size,
    CASE WHEN l_discount > 0.05 THEN 'Yes' END AS disc, l_linenumber AS line, p_brand AS brand, p_size AS psize, l_partkey AS part
  FROM lineitem JOIN part ON l_partkey = p_partkey),
tok AS (
  SELECT *, CASE WHEN sent % 2 = 0 THEN id - 1 WHEN id = 1 THEN 0 ELSE id // 2 END AS head,
    CASE WHEN id = 1 THEN 'root' ELSE 'dep' || (line % 5) END AS deprel, count(*) OVER (PARTITION BY sent) AS n FROM raw)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, text, words (form, lemma, id, head) for each line with a word."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    docs = docs.where(F.trim("text") != "")
    forms = F.filter(F.split("text", " "), lambda x: x != "")
    return docs.withColumn("words", F.transform(forms, lambda x, i: F.struct((i + 1).alias("id"), x.alias("form"), F.lower(x).alias("lemma"), i.alias("head"))))
