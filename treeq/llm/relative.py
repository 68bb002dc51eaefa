"""Removal of passages that an earlier document has, by relative Lempel-Ziv parsing.

The documents with smaller ids are what a document is factored against. The reference is indexed in blocks by content: a window of
`least` words belongs to the block of its minimiser, the smallest hash among its runs of SEED words, so a window and all its copies meet in
one block, and neighbouring windows of a document mostly go there together, as one stretch. In each block every stretch is factored
greedily: from a window that the index has from an earlier document, the factor goes on for as long as the next window goes on in the same place of
the reference; where it ends, the windows over the boundary are looked up themselves. A factor has at least `least` words, so
all factors are duplicate spans, and no window that an earlier document has is missed.

A batch of documents is a reference block of its own first: of equal windows only that of its earliest document is sent on. So what very many
documents share reaches the other blocks once a batch. Minimisers that many different windows have are counted beforehand; their windows are dealt by their own hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, gram_hashes, mix64, small_batches, span_hashes, text_steps, words

#: Words of a minimiser; bytes of text whose windows are compared before any are sent; bytes of text a block of the reference.
SEED, BATCH, BLOCK = 5, 4 << 20, 16 << 20
HOT = 4096


class Windows:
    """The windows of a batch of documents: fingerprint, row, place in its text, minimiser."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, least: int):
        starts, ends, row = words(data, offs)
        h = span_hashes(data, starts, ends)
        self.first_word = np.searchsorted(row, np.arange(len(offs)))
        n = max(0, len(h) - least + 1)
        at = np.flatnonzero(row[:n] == row[least - 1 :]) if n else np.zeros(0, np.int64)
        self.print, self.row = gram_hashes(h, least)[at], row[at]
        self.pos = at - self.first_word[self.row]
        order = mix64(gram_hashes(h, SEED) + np.uint64(12))
        span = least - SEED + 1
        low = np.lib.stride_tricks.sliding_window_view(order, span).argmin(1)[at] + at if n else at
        self.low, self.seed = low, order[low]


def _earliest(prints: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the least rank among windows like it, and the place of the first window with that rank."""
    order = np.lexsort((rank, prints))
    p = prints[order]
    head = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(p)))
    place = np.empty(len(p), np.int64)
    place[order] = np.repeat(order[head], size)
    return rank[place], place


def _ranks(ids: pa.Array) -> np.ndarray:
    """Dense ranks of ids; -1 for null."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    rank[ids.is_null().to_numpy(zero_copy_only=False)] = -1
    return rank


def _batches(b: pa.RecordBatch, least: int) -> Iterator[tuple[int, int, Windows, np.ndarray, np.ndarray]]:
    """(first row, end row, windows, those that an earlier document of the batch has, those to be sent on)."""
    for lo, hi, data, offs in text_steps(b.column("text"), limit=BATCH):
        w = Windows(data, offs, least)
        if not len(w.row):
            continue
        rank = _ranks(b.column("doc_id").slice(lo, hi - lo))
        key = b.column("key").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
        named = rank[w.row] >= 0
        high = np.where(named, rank[w.row], np.iinfo(np.int64).max)
        least_rank, _ = _earliest(w.print, high)
        here = named & (high > least_rank)
        # once for each text of the earliest id that has the window
        sent = np.flatnonzero(named & ~here)
        _, text = np.unique(np.stack([rank, key]), axis=1, return_inverse=True)
        order = sent[np.lexsort((w.pos[sent], w.row[sent], text.reshape(-1)[w.row[sent]], w.print[sent]))]
        same = (w.print[order][1:] == w.print[order][:-1]) & (text.reshape(-1)[w.row[order]][1:] == text.reshape(-1)[w.row[order]][:-1])
        yield lo, hi, w, np.flatnonzero(here), np.sort(order[np.concatenate([[True], ~same])] if len(order) else order)


def _runs(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of runs in which the last array goes up by one and the others stay."""
    n = len(parts[-1])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = parts[-1][1:] != parts[-1][:-1] + 1
    for p in parts[:-1]:
        new |= p[1:] != p[:-1]
    first = np.flatnonzero(np.concatenate([[True], new]))
    return first, np.diff(np.append(first, n))


def _frequent(docs: DataFrame, least: int, hot: int) -> np.ndarray:
    """Minimisers of more than 2 / hot of all windows that are sent, and none of less than 1 / hot: at most `hot`. A batch leaves
    out those with less than its own share, which are a hot-th of all windows together at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *_, w, _, sent in _batches(b, least):
                seed, n = np.unique(w.seed[sent], return_counts=True)
                big = n * hot >= len(sent)
                out = np.append(seed[big].view(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(out, mask=np.arange(len(out)) == big.sum()), pa.array(np.append(n[big], len(sent)))], ["seed", "n"])

    counts = cut(docs.mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")))
    total = counts.where("seed is null").first()
    if not total:
        return np.zeros(0, np.uint64)
    found = counts.where(F.col("seed").isNotNull() & (F.col("n") * hot >= total.n)).select("seed").toPandas()  # at most `hot` rows
    drop(counts)
    return np.sort(found.seed.to_numpy(np.int64).view(np.uint64))


def factors(docs: DataFrame, least: int = 13) -> DataFrame:
    """(doc_id, key, start, n, ref_id): factors of each document, as its first word, the number of windows that begin in it, and the document it is
    copied from. `docs` has doc_id, text and a hash of the text as `key`. A window that a document has several times is in a factor at one of its places at least."""
    kind = dict(docs.dtypes)["doc_id"]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BLOCK)
    hot = _frequent(docs, least, max(HOT, 4 * number))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, w, here, sent in _batches(b, least):
                frequent = np.isin(w.seed[sent], hot)
                block = mix64(np.where(frequent, w.print[sent], w.seed[sent])) % np.uint64(number)
                # stretches: windows that follow each other and have one minimiser; frequent ones are stretches by themselves
                alone = np.where(frequent, np.arange(len(sent)), -1)
                first, n = _runs(w.row[sent], w.low[sent], alone, w.pos[sent])
                yield from _rows(b, lo, block[first].astype(np.int32), w.row[sent][first], w.pos[sent][first], n, w.print[sent], first)
                first, n = _runs(w.row[here], w.pos[here])
                if len(first):
                    some = np.full(len(first), int(w.print[here[0]] % np.uint64(number)), np.int32)
                    yield from _rows(b, lo, some, w.row[here][first], w.pos[here][first], n, None, first)

    def factor(table: pa.Table) -> pa.Table:
        rows = [(r["ids"].values, r["keys"].values, *(np.asarray(r[c].values) for c in ("row", "pos", "n", "prints"))) for r in _each(table)]
        base = np.cumsum([0] + [len(r[0]) for r in rows])
        ids, keys = pa.concat_arrays([r[0] for r in rows]), pa.concat_arrays([r[1] for r in rows])
        row = np.concatenate([r[2] + at for r, at in zip(rows, base)]).astype(np.int64)
        pos, n = (np.concatenate([r[i] for r in rows]).astype(np.int64) for i in (3, 4))
        asked = np.repeat(np.array([len(r[5]) > 0 for r in rows]), [len(r[2]) for r in rows])
        prints = np.concatenate([r[5] for r in rows])
        rank = _ranks(ids)
        of = np.repeat(np.flatnonzero(asked), n[asked])  # the stretch of each window
        least_rank, ref = _earliest(prints, rank[row[of]])
        found = np.flatnonzero(rank[row[of]] > least_rank)
        # a factor goes on while the next window goes on in the same stretch of the reference
        first, size = _runs(of[found], of[ref[found]], found - ref[found], found)
        step = np.arange(len(prints)) - np.repeat(np.concatenate([[0], np.cumsum(n[asked])[:-1]]) if asked.any() else np.zeros(0, int), n[asked])
        at = found[first]
        known = np.flatnonzero(~asked)
        who = pa.array(np.concatenate([row[of[at]], row[known]]))
        start = np.concatenate([pos[of[at]] + step[at], pos[known]]).astype(np.int32)
        source = pa.array(np.concatenate([row[of[ref[at]]], np.zeros(len(known), np.int64)]), mask=np.arange(len(start)) >= len(at))
        return pa.table([ids.take(who), keys.take(who), pa.array(start), pa.array(np.concatenate([size, n[known]]).astype(np.int32)), ids.take(source)], ["doc_id", "key", "start", "n", "ref_id"])

    dealt = docs.mapInArrow(deal, f"block int, ids array<{kind}>, keys array<long>, row array<int>, pos array<int>, n array<int>, prints array<long>")
    return dealt.groupBy("block").applyInArrow(factor, f"doc_id {kind}, key long, start int, n int, ref_id {kind}")


def _each(table: pa.Table) -> Iterator[dict[str, pa.Scalar]]:
    table = table.combine_chunks()
    columns = {c: table.column(c).combine_chunks() for c in table.column_names}
    for i in range(len(table)):
        yield {c: x[i] for c, x in columns.items()}


def _rows(b: pa.RecordBatch, lo: int, block: np.ndarray, row: np.ndarray, pos: np.ndarray, n: np.ndarray, prints: np.ndarray | None, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each block of the reference, with all stretches for it and the documents that these are in; without
    prints, of spans that are known already (then the document it is copied from is left open)."""
    order = np.argsort(block, kind="stable")
    block, row, pos, n, first = block[order], row[order], pos[order], n[order], first[order]
    head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    if not len(head):
        return
    ends = np.append(head, len(block)).astype(np.int32)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])  # rows go up in a block
    number = np.cumsum(new) - 1
    docs = np.append(number[head], number[-1] + 1).astype(np.int32)
    which = pa.array(lo + row[new])
    total = np.append(0, np.cumsum(n))
    values = prints[np.repeat(first - total[:-1], n) + np.arange(total[-1])].view(np.int64) if prints is not None else np.zeros(0, np.int64)
    lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at), x)
    columns = [
        pa.array(block[head]), lists(docs, b.column("doc_id").take(which)), lists(docs, b.column("key").take(which)), lists(ends, pa.array((number - np.repeat(docs[:-1], np.diff(ends))).astype(np.int32))),
        lists(ends, pa.array(pos.astype(np.int32))), lists(ends, pa.array(n.astype(np.int32))), lists((total[ends] if prints is not None else 0 * ends).astype(np.int32), pa.array(values)),
    ]
    yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "keys", "row", "pos", "n", "prints"])


def _kept(data: np.ndarray, offs: np.ndarray, runs: list, least: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(words, words removed, text left) of each row; runs has (first words, windows) of each row's factors, or None."""
    starts, ends, row = words(data, offs)
    at = np.searchsorted(row, np.arange(len(offs)))
    gone = np.zeros(len(starts) + 1, np.int64)
    some = [i for i, r in enumerate(runs) if r is not None and len(r[0])]
    if some:
        prints = gram_hashes(span_hashes(data, starts, ends), least)
        for i in some:
            begin, n = runs[i]
            p = np.repeat(begin - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            mine = prints[at[i] : max(at[i], at[i + 1] - least + 1)]
            p = at[i] + np.flatnonzero(np.isin(mine, mine[p]))  # its other places in the document too
            np.add.at(gone, p, 1)
            np.add.at(gone, p + least, -1)
    keep = np.cumsum(gone[:-1]) == 0
    kept = np.flatnonzero(keep)
    edge = np.zeros(len(data) + 1, np.int32)
    last = np.ones(len(kept), bool)  # the last word that its row keeps has no blank after it
    last[:-1] = row[kept][1:] != row[kept][:-1]
    np.add.at(edge, starts[kept], 1)
    np.add.at(edge, ends[kept] + ~last, -1)
    mask = np.cumsum(edge[:-1]) > 0
    out = data.copy()
    out[ends[kept][~last]] = 0x20
    where = np.append(0, np.cumsum(mask))[offs]
    text = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(out[mask].tobytes()))
    total = np.append(0, np.cumsum(keep))
    n = np.diff(at)
    return n, n - np.diff(total[at]), text


def remove_copied(docs: DataFrame, least: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one blank) of each document, of `doc_id` and `text`.

    Words are runs of characters other than blank and tab to carriage return. A word goes if it is in a window of `least` words whose words also
    stand, in this order, in a document with a smaller id; texts are compared as they came. Null and empty texts have no words and keep the empty
    text; texts of any length are gone through whole. Rows that repeat an id don't count against each other. Rows without an id lose nothing and
    nothing is removed for them. Other columns are left out, whatever their names; an empty table gives no rows.
    """
    if least < SEED:
        raise ValueError(f"least must be {SEED} at least")
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    pairs = F.collect_list(F.struct("start", "n"))
    found = cut(factors(texts, least).groupBy("doc_id", "key").agg(pairs.alias("runs")))
    rows = texts.join(found, ["doc_id", "key"], "left").select("doc_id", "text", F.col("runs.start").alias("begin"), F.col("runs.n").alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in text_steps(b.column("text"), limit=BATCH):
                lists = [[None if x is None else np.asarray(x, np.int64) for x in (b.column(c)[i].values if b.column(c)[i].is_valid else None for i in range(lo, hi))] for c in ("begin", "windows")]
                n, removed, text = _kept(data, offs, [None if x is None else (x, y) for x, y in zip(*lists)], least)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), text.cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")
