"""Whole-corpus operators: slices, folds, shuffles, merging, line lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.let import settled


def between(sents: DataFrame, position: str, first: int | None, last: int | None) -> DataFrame:
    """Sentences first to last, from 1 and inclusive; the position counts from 0."""
    col = F.col(position) + 1
    out = sents if first is None else sents.where(col >= first)
    return out if last is None else out.where(col <= last)


def shuffled(sents: DataFrame, seed: int, *key: str) -> DataFrame:
    """A random order that the seed and the key fix."""
    return sents.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def folds(sents: DataFrame, position: str, k: int) -> DataFrame:
    """Every sentence once per fold, with `fold` and `part` (test or train): fold i tests sentences with (position + i) mod k = 0.
    Write with partitionBy("fold", "part")."""
    out = sents.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return out.withColumn("part", F.when(F.pmod(F.col(position) + F.col("fold"), F.lit(k)) == 0, "test").otherwise("train"))


def write_folds(sents: DataFrame, position: str, k: int, path: str, columns: tuple[str, ...] | None = None) -> None:
    """The folds as CoNLL-U files, in folders fold=i/part=test and fold=i/part=train."""
    from ..sources.conllu import COLUMNS, block

    # a sentence's lines are made before it goes to all folds
    rows = sents.select(position, F.concat(block(columns or COLUMNS), F.lit("\n")).alias("value"))
    rows = folds(rows, position, k).select("fold", "part", "value")
    rows.write.partitionBy("fold", "part").text(path)


def merged(sents: DataFrame, group: str, position: str) -> DataFrame:
    """One sentence per group: its sentences' words, multiword tokens and empty words in order, with ids, heads and enhanced heads shifted; comments
    follow one another, texts are joined by blanks. A sentence is a row, so this is for groups that fit into one; `merged_tokens` numbers those of any size."""
    order = lambda a, b: F.when(a[position] < b[position], -1).when(a[position] > b[position], 1).otherwise(0)
    arrays = [c for c in ("words", "mwts", "empties") if c in sents.columns]
    lists = [c for c in ("comments",) if c in sents.columns]
    parts = F.array_sort(F.collect_list(F.struct(position, *arrays, *lists, *(c for c in ("text",) if c in sents.columns))), order)
    rows = settled(sents.groupBy(group).agg(parts.alias("parts")), "parts")
    kinds = {c: sents.schema[c].dataType.simpleString() for c in arrays}
    start = F.struct(*(F.array().cast(kinds[c]).alias(c) for c in arrays))

    def add(acc: Column, p: Column) -> Column:
        n = F.size(acc["words"])
        # empty words in front of a sentence (0.m) follow those behind the last word before it
        last = F.coalesce(F.array_max(F.transform(F.filter(acc["empties"], lambda e: e["id"] == n), lambda e: e["subid"])), F.lit(0)) if "empties" in arrays else F.lit(0)
        sub = lambda x, i: F.when((x >= 0) & (i == 0), x + last).otherwise(x)
        edge = lambda d: d.withField("headsubid", sub(d["headsubid"], d["headid"])).withField("headid", F.when((d["headid"] > 0) | (d["headsubid"] >= 0), d["headid"] + n).otherwise(d["headid"]))
        edges = lambda t: F.transform(t["deps"], edge)
        head = lambda w: F.when(w["head"] > 0, w["head"] + n).otherwise(w["head"])
        shifted = {
            "words": lambda w: w.withField("id", w["id"] + n).withField("head", head(w)).withField("deps", edges(w)),
            "mwts": lambda m: m.withField("id", m["id"] + n).withField("subid", m["subid"] + n),
            "empties": lambda e: e.withField("subid", sub(e["subid"], e["id"])).withField("id", e["id"] + n).withField("deps", edges(e)),
        }
        return F.struct(*(F.concat(acc[c], F.transform(p[c], shifted[c])).alias(c) for c in arrays))

    done = settled(rows.withColumn("all_", F.aggregate("parts", start, add)), "all_")
    out = [F.col(f"all_.{c}").alias(c) for c in arrays]
    out += [F.flatten(F.transform("parts", lambda p: p[c])).alias(c) for c in lists]
    if "text" in sents.columns:
        out.append(F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))
    return done.select(group, *out)


#: Sentences of one window, by position.
CHUNK = 10_000


def running(rows: DataFrame, group: str, position: str, amount: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """rows with the sum of `amount` over what stands before them in their group. Positions are numbers; a group is summed in chunks of `chunk` of them, then
    within each, so no group passes through one task. Rows are read twice."""
    rows = rows.withColumn("amount_", amount).withColumn("chunk_", F.floor(F.col(position) / chunk))
    sums = rows.groupBy(group, "chunk_").agg(F.sum("amount_").alias("sum_"))
    earlier = W.partitionBy(group).orderBy("chunk_").rowsBetween(W.unboundedPreceding, -1)  # a row per chunk
    sums = sums.select(group, "chunk_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0)).alias("before_"))
    inner = W.partitionBy(group, "chunk_").orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    here = rows.withColumn("here_", F.coalesce(F.sum("amount_").over(inner), F.lit(0)))
    return here.join(sums, [group, "chunk_"]).withColumn(name, F.col("before_") + F.col("here_")).drop("amount_", "chunk_", "before_", "here_")


def merged_tokens(sents: DataFrame, group: str, position: str, bounded: bool = False) -> DataFrame:
    """(group, kind, id, subid, form, head, deprel, deps, ...): all tokens of a group as one sentence has them, ids, heads and enhanced heads shifted by the words
    before. A group may be of any size: nothing is gathered. Empty words in front of a sentence keep their number, so add `position` to tell them apart.
    `bounded` says that a group is no more than a task can order: then its sentences are read once, and not exchanged where they already lie together."""
    if bounded:
        before = W.partitionBy(group).orderBy(position).rowsBetween(W.unboundedPreceding, -1)
        rows = sents.withColumn("n_", F.coalesce(F.sum(F.size("words")).over(before), F.lit(0)))
    else:
        rows = running(sents, group, position, F.size("words"), "n_")
    rows = rows.withColumn("n_", F.col("n_").cast("int"))
    n = F.col("n_")
    edge = lambda d: d.withField("headid", F.when((d["headid"] > 0) | (d["headsubid"] >= 0), d["headid"] + n).otherwise(d["headid"]))
    moved = {
        "subid": F.when(F.col("kind") == "MWT", F.col("subid") + n).otherwise(F.col("subid")), "id": F.col("id") + n,
        "head": F.when(F.col("head") > 0, F.col("head") + n).otherwise(F.col("head")), "deps": F.transform("deps", edge),
    }
    arrays = [c for c in ("words", "mwts", "empties") if c in sents.columns]
    fields = sents.schema[arrays[0]].dataType.elementType.names
    # tokens are rows before anything is changed: inside a lambda, Spark would interpret it
    tokens = rows.select(group, position, "n_", F.inline(F.concat(*arrays) if len(arrays) > 1 else F.col(arrays[0])))
    return tokens.select(group, position, *(moved.get(f, F.col(f)).alias(f) for f in fields))


def line_numbers(sents: DataFrame, group: str, position: str, n_lines: str) -> DataFrame:
    """sents with first_line and last_line in their file, a blank line after each sentence."""
    out = running(sents, group, position, F.col(n_lines) + 1, "first_line").withColumn("first_line", F.col("first_line") + 1)
    return out.withColumn("last_line", F.col("first_line") + F.col(n_lines) - 1)


def at_line(numbered: DataFrame, line: int) -> DataFrame:
    return numbered.where(F.lit(line).between(F.col("first_line"), F.col("last_line") + 1))
