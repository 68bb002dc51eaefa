"""Connected components by alternating large-star and small-star steps, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

TASK_ROWS = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Edges with a null end or equal ends bind nothing; direction and repeats don't matter, and no edges give no rows. No node's
    neighbours are ever gathered: each step takes minima (which combine before the shuffle) and joins
    them back, so a hub of any degree is only a skewed join, which AQE splits. A step's tables go once the next has its own.
    """
    e = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    # tables of one task per TASK_ROWS edges: a loop over many tiny files would take longer than its work
    parts = max(1, -(-e.count() // TASK_ROWS))
    save = lambda df: cut(df.coalesce(parts))
    # minima are written before they are joined: AQE splits a hub's edges only if both sides of a join are plain exchanges
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = save(large.distinct())
        least = save(large.groupBy("u").agg(F.min("v").alias("m")))
        pairs = F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))
        small = large.join(least, "u").select(F.explode(pairs).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        done, e = e, save(small.where("u <> v").distinct())
        drop(done, low, large, least)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        last = now
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
