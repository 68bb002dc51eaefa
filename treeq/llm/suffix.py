"""Passages that repeat across documents, by a sparse suffix array.

Of all suffixes (at words) those at content-selected positions are retained: the places of the smallest hash among any SPAN
consecutive runs of SEED words. Two documents that share a passage of `words` words retain a suffix at the same
place of it, with at least words - SPAN + 1 of the words still to come; hashes of so many words order the suffixes. The
retained suffixes are sorted over all partitions, and neighbours of different documents with the same beginning
match. A match is then extended: to the left word by word, up to where the passage can begin, and from each such place to
the right by `words` words. These longer suffixes are sorted and compared with their neighbours in the same way, so nothing is joined by content and a
passage that very many documents have is spread over as many tasks as it needs. What matches makes up the passages, which end exactly where
sharing ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from .common import cut, drop, gram_hashes, mix64, small_batches, span_hashes, text_steps, words

SEED, SPAN = 8, 21


def anchors(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the leftmost smallest seed in every SPAN consecutive seeds of one document."""
    need = SEED + SPAN - 1
    if len(hashes) < need:
        return np.zeros(0, np.int64)
    order = mix64(gram_hashes(hashes, SEED) + np.uint64(77))
    low = np.lib.stride_tricks.sliding_window_view(order, SPAN).argmin(1)
    at = np.arange(len(low))
    ok = doc[: len(low)] == doc[need - 1 :]
    return np.unique((at + low)[ok])


def _hashed(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, document of each, first word of each document) by steps."""
    for lo, hi, data, offs in text_steps(texts, lower=True):
        starts, ends, doc = words(data, offs)
        yield lo, hi, span_hashes(data, starts, ends), doc, np.searchsorted(doc, np.arange(hi - lo + 1))


def retained(docs: DataFrame, least: int) -> DataFrame:
    """(h, doc_id, pos): a hash of the first words of each retained suffix."""
    reach = least - SPAN + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, doc, at in _hashed(b.column("text")):
                p = anchors(h, doc)
                g = gram_hashes(h, reach)
                p = p[p < len(g)]
                p = p[doc[p] == doc[p + reach - 1]]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(g[p].view(np.int64)), b.column("doc_id").take(pa.array(lo + doc[p])), pa.array((p - at[doc[p]]).astype(np.int32))], ["h", "doc_id", "pos"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"h long, doc_id {dict(docs.dtypes)['doc_id']}, pos int")


#: Rows that are gone through at once.
BULK = 1 << 17


def _bulk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    some: list[pa.RecordBatch] = []
    for b in batches:
        some.append(b)
        if sum(map(len, some)) >= BULK:
            yield pa.Table.from_batches(some).combine_chunks()
            some = []
    if some:
        yield pa.Table.from_batches(some).combine_chunks()


def matched(suffixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, pos) of the suffixes (h, doc_id, pos) whose beginning h another document's suffix has too; and the table behind it.

    The sort is one range partitioning over (h, doc_id, pos), so suffixes of one beginning spread over as many
    tasks as they need. A run of rows of one document is compared with the runs before and after it; the first and the last
    run of each partition are compared with those of its neighbours, from two runs a partition.
    """
    kind = dict(suffixes.dtypes)["doc_id"]
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h", "doc_id", "pos"]
    ordered = suffixes.select(order).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, before, first = None, None, True
        for t in _bulk(batches):
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            h, d = t.column("h").to_numpy(), t.column("doc_id")
            other = pc.not_equal(d.slice(1), d.slice(0, len(d) - 1)).to_numpy(zero_copy_only=False).astype(bool)
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | other]))
            last = int(new[-1])  # the last run may go on in the next rows
            if last:
                yield from _hits(t.slice(0, last), new[:-1], before, h[last], first, False)
                before, first = h[new[-2]], False
            rest = t.slice(last)
        if rest is not None and len(rest):
            yield from _hits(rest, np.zeros(1, int), before, None, first, True)

    marked = cut(ordered.mapInArrow(run, f"h long, doc_id {kind}, pos int, hit boolean"))
    # runs at the ends of partitions: a beginning that two of them have in different documents, or one of them has as a hit
    ends = marked.where("h is not null")
    both = ends.groupBy("h").agg(((F.min("doc_id") != F.max("doc_id")) | F.max("hit")).alias("shared")).where("shared").select("h")
    more = ends.where("not hit").join(F.broadcast(both), "h", "left_semi")  # two runs a partition at most
    return marked.where("hit").select("doc_id", "pos").unionByName(more.select("doc_id", "pos")), marked


def _hits(t: pa.Table, new: np.ndarray, before, after, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose run has a neighbouring run with the same h, and all of the partition's first and last run: only these keep their h."""
    key = t.column("h").to_numpy()[new]
    hit = np.zeros(len(new), bool)
    hit[1:] |= key[1:] == key[:-1]
    hit[:-1] |= key[1:] == key[:-1]
    hit[0] |= before is not None and key[0] == before
    hit[-1] |= after is not None and key[-1] == after
    edge = np.zeros(len(new), bool)
    edge[-1] |= last
    edge[0] |= first
    size = np.diff(np.append(new, len(t)))
    row_hit, row_edge = np.repeat(hit, size), np.repeat(edge, size)
    keep = np.flatnonzero(row_hit | row_edge)
    if len(keep):
        out = t.take(pa.array(keep)).combine_chunks().to_batches()[0]
        h = pa.array(out.column("h").to_numpy(zero_copy_only=False), pa.int64(), mask=~row_edge[keep])
        yield pa.RecordBatch.from_arrays([h, out.column("doc_id"), out.column("pos"), pa.array(row_hit[keep])], ["h", "doc_id", "pos", "hit"])


def windows(docs: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """(h, doc_id, pos): hashes of `least` words at the places to which matches extend on their left. `found` has doc_id and the places `at` of its matches."""
    both = docs.select("doc_id", "text").join(found, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, ids = b.column("at"), b.column("doc_id")
            for lo, hi, h, _, at in _hashed(b.column("text")):
                g = gram_hashes(h, least)
                take, start, value = [], [], []
                for i in range(hi - lo):
                    n = at[i + 1] - at[i]
                    near = np.zeros(n + SPAN, np.int64)  # places up to SPAN - 1 left of a match
                    p = np.array(pos[lo + i].values)
                    np.add.at(near, np.maximum(0, p[p < n] - SPAN + 1), 1)
                    np.add.at(near, p[p < n] + 1, -1)
                    p = np.flatnonzero(np.cumsum(near)[: max(0, n - least + 1)])
                    take.append(np.full(len(p), lo + i))
                    start.append(p.astype(np.int32))
                    value.append(g[p + at[i]])
                if take and sum(map(len, take)):
                    columns = [pa.array(np.concatenate(value).view(np.int64)), ids.take(pa.array(np.concatenate(take))), pa.array(np.concatenate(start))]
                    yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "pos"])

    return both.mapInArrow(run, f"h long, doc_id {dict(docs.dtypes)['doc_id']}, pos int")


def _runs(starts: Column, least: int) -> Column:
    """(start, end) of the runs of overlapping or touching windows, from their sorted starts."""
    def of(starts: Column) -> Column:
        step = lambda i: F.get(starts, i) - F.get(starts, i - 1)
        heads = F.filter(F.sequence(F.lit(0), F.size(starts) - 1), lambda i: (i == 0) | (step(i) > least))
        last = lambda heads, k: F.coalesce(F.get(heads, k + 1), F.size(starts)) - 1
        span = lambda heads: F.transform(heads, lambda h, k: F.struct(F.get(starts, h).alias("start"), (F.get(starts, last(heads, k)) + least).alias("end")))
        return let(heads, then=span)

    return let(starts, then=of)


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, start, end): words start to end (exclusive) of passages whose every window of `least` words is in another document too.

    Words are lower-cased runs of characters other than blank and tab to carriage return; a document's passages are maximal. Documents
    without such a passage have no row. Repetition inside one document doesn't count, and rows of one id are one
    document, repeated ones too. Null ids, null and short texts take no part; texts of any length are gone through whole; ties (equal beginnings of any number) are all
    compared. Other columns are left out, whatever their names; an empty table gives no rows.
    """
    if least < SPAN + SEED + SPAN:
        raise ValueError(f"least must be {2 * SPAN + SEED} at least")
    small_batches(docs.sparkSession)
    # once each, whatever ids repeat: equal keys could not be dealt to several tasks
    distinct = lambda suffixes: suffixes.dropDuplicates(["h", "doc_id", "pos"])
    hits, first = matched(distinct(retained(docs, least)))
    # written, so that AQE can split the rows of an id that repeats
    found = cut(hits.groupBy("doc_id").agg(F.collect_set("pos").alias("at")))
    drop(first)
    hits, _ = matched(distinct(windows(docs, found, least)))
    drop(found)
    starts = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("starts"))  # of one document's own words
    return starts.select("doc_id", F.explode(_runs(F.col("starts"), least)).alias("x")).select("doc_id", "x.start", "x.end")
