"""Ranked search with inverted treaps: the best documents of each item by a sum over the item's terms.

Documents are indexed in blocks, in order of doc_id. In a block each term has a treap: a binary tree that is in search order by document
and in heap order by impact, so the top of a subtree is the most that any of its documents gets from the term. An item is
answered by going through the treaps of its terms together: a range of documents has a node of each term, whose impacts add up to a bound; a range
that can't reach the item's k best so far goes as a whole; else it is split at the document of the node that gives most, or, if it is small, scored. That document is
scored, and each term's node moves down to either side. The best ranges come first, and what an item has found in one block prunes the next of the same task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small_batches, span_hashes, text_steps, words

#: Bytes of text a block, terms of items that are searched for at once, ranges that are split at once, documents of a range that isn't split any more.
BLOCK, QUERY_TERMS, STEP, LEAF = 4 << 20, 200_000, 256, 200
#: Blocks a file: all of a file's are in memory when one of them is read.
PER_FILE = 4
#: What separates terms: all ASCII that is neither letter nor digit. Only A to Z are lower-cased.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each term of some texts."""
    data = LOWER[data]
    starts, ends, row = words(data, offs, SEPARATORS)
    return span_hashes(data, starts, ends).view(np.int64), row


def index(docs: DataFrame) -> DataFrame:
    """Blocks of documents: ids in order, their numbers of terms, and of each term the documents (by place) and how often they have it.

    Columns: n_docs (with a term), n_terms, ids, n (terms of each document), terms (sorted hashes), df, first (where a term's postings begin), docs, tf.
    Rows without an id count in n_docs, n_terms and df and have no postings."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in text_steps(b.column("text"), limit=BLOCK):
                ids = b.column("doc_id").slice(lo, hi - lo)
                order = pc.sort_indices(ids, null_placement="at_end")
                place = np.empty(hi - lo, np.int64)
                place[order.to_numpy()] = np.arange(hi - lo)
                h, row = terms(data, offs)
                n = np.bincount(place[row], minlength=hi - lo)
                row = place[row]
                by = np.lexsort((row, h))
                h, row = h[by], row[by]
                head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
                tf, h, row = np.diff(np.append(head, len(h))), h[head], row[head]
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                df = np.diff(np.append(start, len(h)))
                named = row < hi - lo - ids.null_count
                first = np.append(0, np.cumsum(named))[np.append(start, len(h))]
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                known = ids.take(order).slice(0, hi - lo - ids.null_count)
                columns = [
                    pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known), one(n[: len(known)], pa.int64()),
                    one(h[start], pa.int64()), one(df, pa.int64()), one(first, pa.int32()), one(row[named], pa.int32()), one(tf[named], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["n_docs", "n_terms", "ids", "n", "terms", "df", "first", "docs", "tf"])

    kinds = f"n_docs long, n_terms long, ids array<{kind}>, n array<long>, terms array<long>, df array<long>, first array<int>, docs array<int>, tf array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


class Treap:
    """Nodes in search order, from `base` on: their documents are sorted, children are node numbers or -1; equal impacts are in order of a mixed number."""

    def __init__(self, impact: np.ndarray, base: int):
        n = len(impact)
        left, right, stack = [-1] * n, [-1] * n, []
        key = list(zip(impact.tolist(), (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).tolist()))
        for i in range(n):
            last = -1
            while stack and key[stack[-1]] < key[i]:
                last = stack.pop()
            left[i] = last
            if stack:
                right[stack[-1]] = i
            stack.append(i)
        down = lambda x: np.where(np.array(x, np.int64) < 0, -1, np.array(x, np.int64) + base)
        self.left, self.right, self.root = down(left), down(right), base + stack[0]


class Forest:
    """The treaps of a block, built for terms as items ask for them."""

    def __init__(self, row: dict[str, pa.Scalar], docs: int, length: int):
        get = lambda c: row[c].values.to_numpy(zero_copy_only=False)
        self.ids, self.terms, self.first = row["ids"].values.to_pylist(), get("terms"), get("first")
        doc, tf = get("docs").astype(np.int64), get("tf").astype(np.int64)
        m = 25 + 75 * get("n") * docs // max(length, 1)
        self.doc, self.impact = np.append(doc, -1), np.append(1_000_000_000 * tf // (1000 * tf + 8 * m[doc]), 0)
        # the last node is none: without children, impact and document
        self.left, self.right = np.full(len(doc) + 1, -1), np.full(len(doc) + 1, -1)
        self.roots: dict[int, int] = {}
        some = self.first[1:] > self.first[:-1]
        self.most = np.zeros(len(self.terms), np.int64)
        if some.any():
            self.most[some] = np.maximum.reduceat(self.impact[:-1], self.first[:-1][some])

    def root(self, term: int) -> int:
        if term not in self.roots:
            lo, hi = self.first[term], self.first[term + 1]
            t = Treap(self.impact[lo:hi], lo)
            self.left[lo:hi], self.right[lo:hi], self.roots[term] = t.left, t.right, t.root
        return self.roots[term]

    def down(self, nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The top node of each term among the documents lo to hi (exclusive) of each row, from nodes at or above it."""
        out = nodes.ravel().copy()
        wide = nodes.shape[1]
        left = np.flatnonzero(out >= 0)
        lo, hi = lo[left // wide], hi[left // wide]
        while len(left):  # those that are not inside yet
            node = out[left]
            doc = self.doc[node]
            low = doc < lo
            move = low | (doc >= hi)
            left, lo, hi, node, low = left[move], lo[move], hi[move], node[move], low[move]
            node = np.where(low, self.right[node], self.left[node])
            out[left] = node
            some = node >= 0
            left, lo, hi = left[some], lo[some], hi[some]
        return out.reshape(nodes.shape)

    def scores(self, nodes: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The whole score of the documents `at`, searched for below these nodes."""
        out, wide = np.zeros(nodes.size, np.int64), nodes.shape[1]
        node = nodes.ravel()
        left = np.flatnonzero(node >= 0)
        node, at = node[left], at[left // wide]
        while len(left):
            doc = self.doc[node]
            here = doc == at
            out[left[here]] = self.impact[node[here]]
            node = np.where(doc > at, self.left[node], self.right[node])
            more = ~here & (node >= 0)
            left, node, at = left[more], node[more], at[more]
        return (out.reshape(nodes.shape) * weight).sum(1)

    def outermost(self, nodes: np.ndarray, edge: np.ndarray, first: bool) -> np.ndarray:
        """The first node with a document from `edge` on, or the last one before it, at or below each of these nodes, which are such themselves."""
        out, left = nodes.copy(), np.arange(len(nodes))
        node = nodes
        while len(left):
            inside = (self.doc[node] >= edge) == first
            out[left[inside]] = node[inside]
            node = np.where(inside == first, self.left[node], self.right[node])
            some = node >= 0
            left, node, edge = left[some], node[some], edge[some]
        return out

    def whole(self, nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all documents of small ranges: nodes are numbered in search order, so those of a range follow each other."""
        base = np.append(0, np.cumsum(hi - lo))
        row, term = np.nonzero(nodes >= 0)
        top = nodes[row, term]
        first, last = self.outermost(top, lo[row], True), self.outermost(top, hi[row], False)
        n = last - first + 1
        node = np.repeat(first - np.append(0, np.cumsum(n)[:-1])[: len(n)], n) + np.arange(n.sum())
        score = np.zeros(base[-1], np.int64)
        np.add.at(score, np.repeat((base[:-1] - lo)[row], n) + self.doc[node], self.impact[node] * np.repeat(weight[term], n))
        return np.repeat(lo - base[:-1], hi - lo) + np.arange(base[-1]), score

    def search(self, term: np.ndarray, weight: np.ndarray, k: int, best: list[tuple[int, object]]) -> list[tuple[int, object]]:
        """The k best (score, id) of `best` and this block."""
        nodes = np.array([[self.root(t) for t in term]])
        lo, hi = np.zeros(1, np.int64), np.full(1, len(self.ids))
        score, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = best[-1][0] if len(best) == k else 0
        edge = bisect_right(self.ids, best[-1][1]) if len(best) == k else len(self.ids)
        before = np.array([s for s, _ in best], np.int64)
        while len(nodes):
            part = self.impact[nodes] * weight
            bound = part.sum(1)
            may = (bound > least) | ((bound == least) & (lo < edge) & (bound > 0))
            nodes, lo, hi, part, bound = nodes[may], lo[may], hi[may], part[may], bound[may]
            if len(nodes) > STEP:
                order = np.argsort(-bound, kind="stable")
                nodes, lo, hi, part = nodes[order], lo[order], hi[order], part[order]
            if not len(nodes):
                break
            now, first, end, part = nodes[:STEP], lo[:STEP], hi[:STEP], part[:STEP]
            nodes, lo, hi = nodes[STEP:], lo[STEP:], hi[STEP:]
            small = end - first <= LEAF
            within, each = self.whole(now[small], first[small], end[small], weight)
            now, first, end, part = now[~small], first[~small], end[~small], part[~small]
            at = self.doc[now[np.arange(len(now)), part.argmax(1)]]
            score, found = np.concatenate([score, each, self.scores(now, at, weight)]), np.concatenate([found, within, at])
            total = np.append(before, score)
            if len(total) >= k:
                top = int(np.partition(total, len(total) - k)[len(total) - k])
                if top > least:  # the edge is that of the k best before this block
                    least, edge = top, len(self.ids)
                keep = score >= max(least, 1)
                score, found = score[keep], found[keep]
                before = before[before >= least]
                total = np.append(before, score)
            left, right = self.down(now, first, at), self.down(now, at + 1, end)
            nodes, lo, hi = np.concatenate([nodes, left, right]), np.concatenate([lo, first, at + 1]), np.concatenate([hi, at, end])
        score, found = score[score > 0], found[score > 0]  # a small range is scored whole
        if len(found):
            best = best + [(int(s), self.ids[i]) for s, i in zip(score, found)]
            best = sorted(best, key=lambda x: x[1])
            best.sort(key=lambda x: -x[0])
        return best[:k]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): a row for each term of each item; rows of one id with different texts add up."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offs in text_steps(b.column("text")):
                h, row = terms(data, offs)
                yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(lo + row)), pa.array(h)], ["item_id", "term"])

    found = items.select("item_id", "text").distinct().mapInArrow(run, f"item_id {kind}, term long")
    return found.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item; equal scores by ascending doc_id.

    `docs` has doc_id and text, `items` item_id and text. Terms are runs of ASCII letters, digits and all characters beyond ASCII, with A to Z
    lower-cased; scores are whole numbers from 64-bit arithmetic (the weight of a term is a floor of a double's logarithm). Null and empty texts have no terms,
    and an item without terms, or with none that a document has, has no rows. Texts of any length are indexed and asked for whole. Rows
    that repeat a doc_id are documents of their own; those without one count in the statistics and are never returned. Equal rows of items
    count once, and different texts of one item_id, null too, are one item. Other columns are left out, whatever their names; empty tables give no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = cut(index(docs), PER_FILE)
    size = blocks.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n, length = int(size.docs or 0), int(size.terms or 0)
    asked = cut(item_terms(items))
    known = blocks.select(F.inline(F.arrays_zip("terms", "df"))).withColumnRenamed("terms", "term")
    known = known.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n + 2)) / (2 * F.col("df") + 1)))
    asked = cut(asked.join(known.withColumn("w", weight), "term").where("w > 0").select("item_id", "term", (F.col("w") * F.col("times")).alias("weight")))
    kinds = f"item_id {dict(items.dtypes)['item_id']}, doc_id {dict(docs.dtypes)['doc_id']}, score long"
    # a block of items has about QUERY_TERMS terms, or is one item: that, not all items, is sent to the tasks
    groups = max(1, -(-asked.count() // QUERY_TERMS))
    found = None
    for g in range(groups):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toArrow()
        part = _best(blocks, mine, n, length, k, kinds)
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _best(blocks: DataFrame, asked: pa.Table, n: int, length: int, k: int, kinds: str) -> DataFrame:
    """(item_id, doc_id, score): the k best of each item in each task."""
    asked = asked.combine_chunks()
    at = pc.rank(asked.column("item_id"), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64) if len(asked) else np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0])) if len(at) else np.zeros(0, np.int64)
    term, weight = asked.column("term").to_numpy()[order], asked.column("weight").to_numpy()[order]
    ids = asked.column("item_id").take(pa.array(order[head]))
    ends, item = np.append(head, len(at)), np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at))))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in head]
        kind = None
        for b in batches:
            kind = b.column("ids").type.value_type
            for i in range(len(b)):
                if not len(term):
                    continue
                f = Forest({c: b.column(c)[i] for c in b.schema.names}, n, length)
                if not len(f.ids) or not len(f.terms):
                    continue
                place = np.minimum(np.searchsorted(f.terms, term), len(f.terms) - 1)
                most = np.where(f.terms[place] == term, f.most[place], 0)
                bound = np.bincount(item, most * weight.astype(np.float64), len(head))
                for q in np.flatnonzero(bound > 0):
                    some = slice(ends[q], ends[q + 1])
                    have = most[some] > 0
                    top = best[q]
                    if len(top) == k and int((most[some] * weight[some]).sum()) < top[-1][0]:
                        continue
                    best[q] = f.search(place[some][have], weight[some][have], k, top)
        rows = [(q, s, d) for q, top in enumerate(best) for s, d in top]
        if rows:
            q, s, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([ids.combine_chunks().take(pa.array(q)), pa.array(d, kind), pa.array(s, pa.int64())], ["item_id", "doc_id", "score"])

    return blocks.select("ids", "n", "terms", "first", "docs", "tf").mapInArrow(run, kinds)
