"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order (a hash of id and pass), whole passes one after another. A queued
document's virtual finish time is the words of its source up to and with it, divided by the source's target; the queue
of all sources is sorted by that time and cut where the total budget is used up. Both running sums are taken in two
levels (sums per range of the order, then inside a range), so that no source passes through one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, ranked, repeated

#: Ranges of virtual time; rows of one range of the shuffled order, about; ranges at most, beyond which they hold more rows.
TIMES, RANGE_ROWS, RANGES = 4096, 512, 1 << 16


def n_words(text: str = "text") -> Column:
    """Number of runs of characters other than blank and tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) by source: weights repeat in code-point order, null last.

    The budget, `share` of all words, is dealt by weight; no target passes `most` times its source's size, and what is
    over goes to the others by weight: as long as the level (what is left by the weight that is left) caps more sources, they
    are capped and the level is taken anew, from sums over the table of sources. There may be any number of sources.
    """
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by = ranked(by, F.col("source").isNull(), F.col("source"), name="k")
    wheel = F.array(*(F.lit(float(w)) for w in weights))
    by = cut(by.withColumn("weight", F.get(wheel, ((F.col("k") - 1) % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(most)))
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") <= F.col("weight") * F.lit(level)
        full, weight, n = by.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if n == capped or not weight:
            break
        capped, level = n, (total * share - (full or 0.0)) / weight
    return by.select("source", "source_size", F.when(over, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """A row per row of docs: doc_id, source, text_key (a hash of the text), size, source_size, target, taken.

    taken is the number of words that the mix takes of the row, from none to `most` times its size (a second pass
    repeats it); the one document at the cut may be taken in part. The order is fixed by the ids, so reruns agree: ties of
    finish time go by hash, id, text, source and size. Null texts have size 0, and texts of any length are one entry; a null source is a source; null ids queue like
    others. Rows that are equal in id, source, size and text queue together, as one entry with a count, and an empty table
    gives no rows. Other columns of docs are left out, whatever their names.
    """
    rows = docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("text_key"))
    sized = cut(rows.groupBy("doc_id", "source", "size", "text_key").agg(F.count("*").alias("copies")))
    by = cut(targets(sized.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, share, most))
    n, total = sized.count(), by.agg(F.sum("source_size")).first()[0] or 0
    budget = math.floor(total * min(share, most))  # the targets' sum, from a whole number: the same in whatever order they are added
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    passes = sized.select("*", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))).alias("pass"))
    passes = passes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "pass", "text_key"))
    # the range is the high part of the hash, so ranges in order are the shuffled order
    passes = passes.withColumn("range", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * ranges)).withColumn("load", F.col("size") * F.col("copies"))
    part = ["source_key", "pass", "range"]
    passes = passes.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    sums = passes.groupBy(*part).agg(F.sum("load").alias("sum"))
    earlier = W.partitionBy("source_key").orderBy("pass", "range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).drop("sum")
    queue = passes.join(sums, part)
    inner = W.partitionBy(*part).orderBy("h", "doc_id", "text_key", "size").rowsBetween(W.unboundedPreceding, 0)
    queue = queue.withColumn("upto", F.col("before") + F.sum("load").over(inner))
    by = by.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    queue = queue.join(by, "source_key").withColumn("finish", F.when(F.col("target") > 0, F.col("upto") / F.col("target")).otherwise(F.lit(0.0)))
    # targets take at most `most` passes of a source, so finish 1 is where each source has its target
    queue = queue.withColumn("time", F.least(F.lit(TIMES - 1), F.floor(F.col("finish") * F.lit(TIMES / 2))))
    queue = cut(queue.select("doc_id", "source", "size", "text_key", "copies", "pass", "load", "h", "finish", "time", "source_size", "target"))
    taken = _cut_at(queue, budget)
    key = ["doc_id", "source", "size", "text_key", "copies", "source_size", "target"]
    whole = taken.groupBy(*key).agg(F.collect_list("took").alias("took"))  # one number a pass
    whole = repeated(whole, "copies", "copy").withColumn("copy", F.col("copy") - 1)
    mine = lambda t: F.greatest(F.lit(0).cast("long"), F.least("size", t - F.col("copy") * F.col("size")))
    each = F.aggregate("took", F.lit(0).cast("long"), lambda a, t: a + mine(t))
    return whole.select("doc_id", "source", "text_key", "size", "source_size", "target", each.alias("taken"))


def _cut_at(queue: DataFrame, budget: int) -> DataFrame:
    """The queue with `took`, the words taken of each entry: all up to the budget in order of finish time, then none.

    The slice of time in which the budget ends is sliced again, so that only one part in TIMES * TIMES / 2 of the queue is
    gone through entry by entry.
    """
    none = F.lit(0).cast("long")
    fine = F.floor((F.col("finish") * F.lit(TIMES / 2) - F.col("time")) * TIMES)
    done, edge_of, before = [], queue, 0
    for of in (F.col("time"), fine):
        part = edge_of.withColumn("part", of.cast("double"))
        sums = part.groupBy("part").agg(F.sum("load").alias("sum"))
        upto = sums.withColumn("upto", F.sum("sum").over(W.orderBy("part")) + before)  # a row per slice
        edge = upto.where(F.col("upto") > budget).orderBy("part").select("part", "upto", "sum").first()
        if edge is None:  # the budget is not used up
            return _union([*done, edge_of.withColumn("took", F.col("load"))])
        done.append(part.where(F.col("part") < edge["part"]).drop("part").withColumn("took", F.col("load")))
        done.append(part.where(F.col("part") > edge["part"]).drop("part").withColumn("took", none))
        edge_of, before = part.where(F.col("part") == edge["part"]).drop("part"), edge["upto"] - edge["sum"]
    order = W.orderBy("finish", "h", "doc_id", "text_key", "source", "size").rowsBetween(W.unboundedPreceding, 0)
    left = F.lit(budget - before) - F.sum("load").over(order) + F.col("load")
    return _union([*done, edge_of.withColumn("took", F.greatest(none, F.least("load", left)))])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
