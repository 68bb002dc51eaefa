"""Near-duplicate documents by Jaccard similarity of word shingles: a chosen-path join.

Texts become sets of hashed runs of five words; sets that are equal are one class from then on. A set is embedded as a
number of MinHash values, so that two sets agree in a place with the probability of their similarity. In each run, and
in each bucket on its own, places are sampled at random (the same for all members), and the bucket is split by the
tokens found there; large buckets are split again. Small buckets are compared by brute force, on the embedding. Runs are
repeated until the expected recall at the threshold reaches the target.

What buckets link is then made exact: connected groups of linked classes are compared in full on their sets, in blocks,
so a group of any size becomes many tasks of bounded size, and only counts and spanning forests leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, digest, drop, gram_hashes, mix64, small_batches, span_hashes, text_steps, with_fields, words
from .components import components

PLACES = 64
#: Members of a bucket that is compared by brute force, and of a block; levels of splitting; expected number of buckets at a level.
BUCKET, BLOCK, LEVELS, FANOUT = 128, 256, 3, 1.25
_SEED = mix64(np.arange(1, 2 * PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL, _ADD = (_SEED[:PLACES] | np.uint64(1)).astype(np.uint32), _SEED[PLACES:].astype(np.uint32)


def runs_for(recall: float, threshold: float, levels: int = LEVELS, fanout: float = FANOUT) -> int:
    """Runs until a pair at the threshold has met in a bucket with probability `recall`, all levels being needed."""
    lost = 0.0
    for _ in range(levels):
        lost = math.exp(-fanout * threshold * (1 - lost))
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each lower-cased text's runs of k words; of all its words if it has fewer."""
    for lo, hi, data, offs in text_steps(texts, lower=True):
        starts, ends, doc = words(data, offs)
        h = span_hashes(data, starts, ends)
        at = np.searchsorted(doc, np.arange(hi - lo + 1))
        grams = gram_hashes(h, k)
        for i in range(hi - lo):
            n = at[i + 1] - at[i]
            yield np.unique(grams[at[i] : at[i + 1] - k + 1] if n >= k else gram_hashes(h[at[i] : at[i + 1]], n)) if n else np.zeros(0, np.uint64)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PLACES) smallest hashes; every set must have members."""
    flat = np.concatenate(sets)
    flat = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), PLACES), np.uint32)
    for j in range(PLACES):
        x = flat * _MUL[j] + _ADD[j]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        out[:, j] = np.minimum.reduceat(x, at)
    return out


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, node, sig) of documents with an id and a word: a digest of the shingle set, and its embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nodes, sigs, keep = [], [], [], []

            def flush():
                if keep:
                    sigs.extend(r.tobytes() for r in minhash(keep))
                    keep.clear()

            for i, s in zip(b.column("doc_id"), shingle_sets(b.column("text"), k), strict=True):
                if len(s):
                    ids.append(i.as_py())
                    nodes.append(digest(s))
                    keep.append(s)
                    if len(keep) >= 512:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "node", "sig"])

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInArrow(run, with_fields(rows.schema[:1], node="binary", sig="binary"))


def _split(rows: DataFrame, level: int, runs: int) -> DataFrame:
    """(path, node) of the buckets that the members of `rows` (path, node, sig) go to; at level 0 a path is a run."""
    chance = np.uint64(int(FANOUT / PLACES * 2.0**64))
    place = np.arange(1, PLACES + 1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            if not n:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(n, PLACES).astype(np.uint64)
            nodes = b.column("node")
            if level == 0:  # all members of a run share their places; each run has one at least
                draw = mix64(mix64(np.arange(runs, dtype=np.uint64) + np.uint64(1))[:, None] + place * np.uint64(0xD1B54A32D192ED03))
                for r, c in zip(*np.nonzero((draw < chance) | (draw == draw.min(1, keepdims=True))), strict=True):
                    to = mix64(draw[r, c] ^ mix64(sig[:, c] + np.uint64(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), nodes], ["path", "node"])
                continue
            path = mix64(b.column("path").to_numpy().view(np.uint64) + np.uint64(level))
            for lo in range(0, n, 4096):
                draw = mix64(path[lo : lo + 4096, None] + place * np.uint64(0xD1B54A32D192ED03))
                row, col = np.nonzero(draw < chance)
                if len(row):
                    to = mix64(draw[row, col] ^ mix64(sig[lo + row, col] + np.uint64(1)))
                    yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), nodes.take(pa.array(lo + row))], ["path", "node"])

    return rows.mapInArrow(run, "path long, node binary")


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """For each of n members, the least member that the links i-j lead to."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def _brute(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Star edges (a, b) over the members of a bucket whose embeddings agree in `least` of the places."""
    sig = np.frombuffer(b"".join(pdf.sig), np.uint32).reshape(len(pdf), PLACES)
    same = np.zeros((len(pdf), len(pdf)), np.uint8)
    for c in sig.T:
        same += c[:, None] == c
    i, j = np.nonzero(np.triu(same >= least * PLACES, 1))
    root, nodes = _forest(len(pdf), i, j), pdf.node.tolist()
    return pd.DataFrame([(nodes[r], nodes[x]) for x, r in enumerate(root) if r != x], columns=["a", "b"])


def candidates(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges (a, b) between classes (node, sig) that a bucket of some run puts together."""
    runs = runs_for(recall, threshold)
    slack = 4 * math.sqrt(threshold * (1 - threshold) / PLACES)  # four deviations of the estimate
    rows, small, level = classes, None, 0
    while True:
        found = cut(_split(rows, level, runs)) if level else _split(rows, level, runs)
        counts = found.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        found = cut(found.join(counts, "path"))
        part = found.where(F.col("n") <= BUCKET).select("path", "node")
        small = part if small is None else small.unionByName(part)
        level += 1
        large = found.where(F.col("n") > BUCKET)
        if level == LEVELS or large.isEmpty():
            break
        rows = large.select("path", "node").join(classes, "node")
    # members that stay together over all levels agree nearly everywhere: one star, which the exact pass resolves
    hub = large.groupBy("path").agg(F.min("node").alias("a"))
    stars = large.join(hub, "path").select("a", F.col("node").alias("b")).where("a <> b")
    shape = _split_pairs(small.join(classes, "node"), max(0.0, threshold - slack))
    return shape.unionByName(stars)


def _split_pairs(members: DataFrame, least: float) -> DataFrame:
    """Brute force over all buckets: members of one path stand together, in runs of bounded memory."""
    rows = members.repartition("path").sortWithinPartitions("path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            pdf = pd.concat([rest, pdf], ignore_index=True) if rest is not None else pdf
            edge = np.flatnonzero(np.diff(pdf.path.to_numpy())) + 1
            cuts = [0, *edge.tolist()]
            done = [_brute(pdf.iloc[a:b], least) for a, b in zip(cuts, cuts[1:], strict=False)]
            rest = pdf.iloc[cuts[-1] :]
            if done:
                yield pd.concat(done, ignore_index=True).drop_duplicates()
        if rest is not None and len(rest):
            yield _brute(rest, least)

    return rows.select("path", "node", "sig").mapInPandas(run, "a binary, b binary")


class Deltas:
    """Sets by what they have besides a base that all of them share, and what of the base they lack."""

    def __init__(self, plus: list[np.ndarray], minus: list[np.ndarray], base: int):
        self.sides = (plus, minus)
        self.base = base
        self.size = np.array([base + len(p) - len(m) for p, m in zip(plus, minus, strict=True)])

    def shared(self, other: Deltas | None) -> np.ndarray:
        """The size of the intersection of each set with each of `other` (None: of the same)."""
        other = other or self
        lack = [np.array([len(x) for x in d.sides[1]]) for d in (self, other)]
        both = self.base - lack[0][:, None] - lack[1].astype(np.float32)
        for mine, its in zip(self.sides, other.sides, strict=True):
            both += _common(mine, None if other is self else its)
        return both


def _common(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """How many members each of the sets a has in common with each of b (None: with a)."""
    left = np.concatenate(a)
    right = left if b is None else np.concatenate(b)
    token, slot = np.unique(np.concatenate([left, right]), return_inverse=True)
    sizes = [np.array([len(x) for x in s]) for s in (a, a if b is None else b)]
    rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
    slots = [slot[: len(left)], slot[: len(left)] if b is None else slot[len(left) :]]
    # only tokens of two sets at least can meet; their columns are multiplied in slices of bounded width
    often = np.bincount(slots[0], minlength=len(token)) > (1 if b is None else 0)
    if b is not None:
        often &= np.bincount(slots[1], minlength=len(token)) > 0
    place = np.cumsum(often) - 1
    keep = [often[s] for s in slots]
    col = [place[s[k]] for s, k in zip(slots, keep, strict=True)]
    row = [r[k] for r, k in zip(rows, keep, strict=True)]
    order = [np.argsort(c, kind="stable") for c in col]
    col, row = [c[o] for c, o in zip(col, order, strict=True)], [r[o] for r, o in zip(row, order, strict=True)]
    both, width, step = np.zeros((len(a), len(sizes[1])), np.float32), int(often.sum()), 4096
    for lo in range(0, width, step):
        m = []
        for c, r, s in zip(col, row, sizes, strict=True):
            x, y = np.searchsorted(c, [lo, lo + step])
            d = np.zeros((len(s), min(step, width - lo)), np.float32)
            d[r[x:y], c[x:y] - lo] = 1
            m.append(d)
        both += m[0] @ m[1].T
    if b is None:  # tokens of one set only were left out
        both[np.arange(len(a)), np.arange(len(a))] = sizes[0]
    return both


def _links(a: Deltas, b: Deltas | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with Jaccard similarity >= threshold: within a (i < j), or between a and b. Exact."""
    both = a.shared(b)
    hit = both >= threshold * (a.size[:, None] + (a if b is None else b).size - both) - 1e-9
    return np.nonzero(np.triu(hit, 1) if b is None else hit)


def _members(rows: DataFrame, k: int) -> DataFrame:
    """Rows (grp, block, node, copies, text, model) with their sets as `plus` and `minus` against the set of the model's text, of
    `base` members; without a model, the set is all in `plus`. Rows whose text is not the node's (a repeated id may bring another) go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plus, minus, base, keep = [], [], [], []
            models: dict[str | None, np.ndarray] = {None: np.zeros(0, np.uint64)}
            nodes, named = b.column("node").to_pylist(), b.column("model").to_pylist()
            for m in set(named) - {None}:
                models[m] = next(shingle_sets(pa.array([m], pa.string()), k))
            for i, x in enumerate(shingle_sets(b.column("text"), k)):
                if digest(x) == nodes[i]:
                    of = models[named[i]]
                    keep.append(i)
                    plus.append(np.setdiff1d(x, of, assume_unique=True).tobytes())
                    minus.append(np.setdiff1d(of, x, assume_unique=True).tobytes())
                    base.append(len(of))
            same = b.select(["grp", "blocks", "block", "node", "copies"]).take(pa.array(keep, pa.int64()))
            more = [pa.array(plus, pa.binary()), pa.array(minus, pa.binary()), pa.array(base, pa.int32())]
            yield pa.RecordBatch.from_arrays([*same.columns, *more], [*same.schema.names, "plus", "minus", "base"])

    kept = rows.select("grp", "blocks", "block", "node", "copies", "text", "model")
    return kept.mapInArrow(run, with_fields(kept.schema[:5], plus="binary", minus="binary", base="integer"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.995) -> DataFrame:
    """A row per document with an id: doc_id, class_id, n_links, kept.

    n_links is the number of other documents with similarity >= threshold, copies included; class_id is the smallest
    doc_id that links lead to; kept is true for one row of each class. A text of fewer than k words is one shingle, so it links
    with its copies only; a null text, or one without words, links with nothing; of a text of any length all shingles count. Rows without an id have null class_id, no
    links, and are kept. Rows that repeat an id are documents of their own: copies if their texts are equal. Other columns are left out,
    whatever their names; an empty table gives no rows.

    A linked group of more than BLOCK classes is compared block by block. What is sent for that of each class is not its text but how its
    set differs from that of one class of the group, which is little where a group is large because its texts are alike.
    """
    small_batches(docs.sparkSession)
    sigs = cut(signatures(docs, k))
    classes = cut(sigs.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.first("sig").alias("sig")))
    groups = components(candidates(classes.select("node", "sig"), threshold, recall))
    groups = cut(groups.withColumnRenamed("component", "grp"))
    sizes = groups.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = groups.join(sizes, "grp").join(classes.select("node", "copies", "first"), "node")
    # one text for each class: the sets are equal whichever copy it is
    texts = docs.select(F.col("doc_id").alias("first"), "text").join(members.select("first").distinct(), "first", "left_semi")
    members = members.join(texts, "first").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = cut(members.select("grp", "blocks", "block", "node", "copies", "text"))
    # the component is named by a class of its own, which serves as the model of its group; written, so that AQE can split a large group
    models = cut(members.where("blocks > 1 and node = grp").groupBy("grp").agg(F.min("text").alias("model")))
    few = members.where("blocks = 1").withColumn("model", F.lit(None).cast("string"))
    sets = _members(few.unionByName(members.where("blocks > 1").join(models, "grp")), k)
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    p, q = F.least("block", "other"), F.greatest("block", "other")
    # the block pairs of a group are dealt in turn, so that no task gets several of a large group while others get none
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.pmod(F.xxhash64("grp") + p * F.col("blocks") + q, F.lit(parts)).cast("int")
    part = sets.select("grp", p.alias("p"), q.alias("q"), "block", "node", "copies", "plus", "minus", "base", task.alias("task"))
    part = part.repartitionById(parts, F.col("task")).drop("task").sortWithinPartitions("grp", "p", "q", "block", "node")

    def compare(pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.drop_duplicates(["block", "node"])  # of an id that is repeated with texts of one set
        p, q, n = int(pdf.p.iloc[0]), int(pdf.q.iloc[0]), len(pdf)
        m = int((pdf.block == p).sum())
        sides = [pdf] if p == q else [pdf.iloc[:m], pdf.iloc[m:]]
        if min(map(len, sides)) < (2 if p == q else 1):
            return []
        sets = [Deltas(*([np.frombuffer(x, np.uint64) for x in s[c]] for c in ("plus", "minus")), int(pdf.base.iloc[0])) for s in sides]
        i, j = _links(sets[0], sets[1] if p != q else None, threshold)
        j = j if p == q else j + m
        nodes, copies = pdf.node.tolist(), pdf.copies.to_numpy()
        links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        return [(nodes[x], nodes[r], int(links[x])) for x, r in enumerate(_forest(n, i, j)) if links[x]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            pdf = pd.concat([rest, pdf], ignore_index=True) if rest is not None else pdf
            key = list(zip(pdf.grp, pdf.p, pdf.q, strict=True))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1])]
            done = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in compare(pdf.iloc[a:b])]
            rest = pdf.iloc[cuts[-1] :]
            if done:
                yield pd.DataFrame(done, columns=["node", "root", "links"])
        if rest is not None and len(rest) and (done := compare(rest)):
            yield pd.DataFrame(done, columns=["node", "root", "links"])

    linked = cut(part.mapInPandas(run, "node binary, root binary, links long"))
    drop(members, models, groups)
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = cut(components(linked.select("node", "root"), "node", "root"))
    named = joined.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    named = joined.join(named, "component").select("node", "least").join(links, "node")
    info = classes.select("node", "copies", "first").join(named, "node", "left")
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    info = cut(info.select("node", n_links.alias("n_links"), F.coalesce("least", "first").alias("class_id")))
    out = sigs.select("doc_id", "node").join(info, "node").select("doc_id", "class_id", "n_links")
    none = docs.select("doc_id", "text").where(F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    out = out.unionByName(none.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
