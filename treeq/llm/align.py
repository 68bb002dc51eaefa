"""Alignment of two tokenizers over the same texts: groups of tokens that cover the same bytes, and links between overlapping tokens.

Neither tokenizer has a token that goes on over a single blank between two other characters, so a text is the same as its pieces
between such blanks, and a piece that many documents have is tokenised once in a block of documents: as many as come to a task until
KNOWN different pieces have been seen. New pieces are tokenised TOGETHER, with single blanks between them, and aligned as arrays of a
step: ends that both tokenizations have cut a piece into groups, and every stretch between two ends of either is one link. All that
needs other blocks is Spark's: counts of links are summed over pieces with their numbers, and what a document has is folded from its pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import cut, cut_by, drop, small_batches, span_hashes, text_steps

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are cut up at once, different pieces of a block, and the most pairs of ids that are broadcast: those that make
#: up a HOT-th of all links or more, of which there can be no more than HOT.
STEP, KNOWN, HOT = 1 << 20, 1 << 19, 1 << 17
#: Pieces that are tokenised as one text.
TOGETHER = 256
#: Least number of buckets for blocks; spark.sql.shuffle.partitions if that is more.
BUCKETS = 128


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, from the contents of their files, and the tokens of pieces seen before."""

    def __init__(self, byte_level: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(byte_level), SentencePieceProcessor(model_proto=pieces)
        self.a.encode_special_tokens = True
        letters = byte_alphabet()
        self.a_bytes = [bytes(letters.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in named]
        if any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in self.b_bytes):
            raise ValueError("a piece of the vocabulary goes on over a blank, so texts can't be cut there")
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        # what is written for a token: its id, and a mark by what comes after it
        self.said = pa.array([f"{i}{x}" for i in range(len(self.a_bytes)) for x in ",|"] + [f"{i}{x}" for i in range(len(self.b_bytes)) for x in (",", ";", "")])
        self.forget()

    def forget(self) -> None:
        """No piece is known: `place` numbers the known ones; `good` and `sizes` (tokens of A, of B, groups) are by number, `groups` and `links` by step."""
        self.place: dict[bytes, int] = {}
        self.good, self.sizes = np.zeros(0, bool), np.zeros((3, 0), np.int32)
        self.groups: list[pa.Array] = []
        self.links: list[pa.Array] = []

    def number(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of pieces, each read with a blank before it; new ones are tokenised and aligned. They are not good, and have no tokens, where the
        tokens' bytes aren't the blank and the piece."""
        new = [p for p in dict.fromkeys(pieces) if p not in self.place]
        if new:
            data = np.frombuffer(b"x " + b" x ".join(new) + b" x", np.uint8)
            size = np.array([len(p) for p in new])
            start = np.cumsum(size + 3) - size - 1
            starts, ends = piece_edges(data, np.array([0, len(data)]))
            plain = np.isin(start, starts) & np.isin(start + size, ends)  # blanks on either side are cuts
            new = [new[i] for i in np.argsort(~plain, kind="stable")]
            n = int(plain.sum())
            parts = [self._joined(new[lo : min(lo + TOGETHER, n)]) for lo in range(0, n, TOGETHER)]
            parts += [self._single(new[lo : lo + TOGETHER]) for lo in range(n, len(new), TOGETHER)]
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self._align(*map(np.concatenate, zip(*parts)))
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))

    def _tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], self.b.encode(texts, num_threads=1)

    def _same(self, whole: bytes, x: list[int], y: list[int]) -> bool:
        """Whether both lists of ids stand for these bytes."""
        return b"".join([self.a_bytes[i] for i in x]) == whole == b"".join([self.b_bytes[i] for i in y])

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        """(ids by A, ids by B, their numbers by piece) of pieces that may stand beside each other, tokenised as one text."""
        whole = b" ".join(pieces)
        ((x,), (y,)) = self._tokens([whole.decode()])
        to = np.cumsum([len(p) + 1 for p in pieces])
        if not self._same(b" " + whole, x, y):
            return self._single(pieces)
        ids = np.array(x, np.int32), np.array(y, np.int32)
        ends = np.cumsum(self.a_size[ids[0]]), np.cumsum(self.b_size[ids[1]])
        n = [np.searchsorted(e, to, "right") for e in ends]
        if not all(np.array_equal(e[k - 1], to) for e, k in zip(ends, n)):
            return self._single(pieces)
        return *ids, *(np.ediff1d(k, to_begin=k[:1]) for k in n)

    def _single(self, pieces: list[bytes]) -> tuple[np.ndarray, ...]:
        """The same of pieces each on its own; one without tokens is not good."""
        both = [t if self._same(b" " + p, *t) else ([], []) for p, *t in zip(pieces, *self._tokens([p.decode() for p in pieces]), strict=True)]
        ids = (np.array([i for t in both for i in t[side]], np.int32) for side in (0, 1))
        return *ids, *(np.array([len(t[side]) for t in both], np.int64) for side in (0, 1))

    def _align(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        """Adds new pieces, of these ids and numbers of ids, with their groups as text and their links as pairs of ids in one number."""
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        at_a, at_b = (np.zeros((ends_a[-1] if len(a) else 0) + 1, bool) for _ in range(2))
        at_a[ends_a], at_b[ends_b] = True, True
        stretch = np.flatnonzero(at_a | at_b)
        pair = a[np.searchsorted(ends_a, stretch)].astype(np.int64) << 32 | b[np.searchsorted(ends_b, stretch)]
        last_a, last_b = at_b[ends_a], at_a[ends_b]  # of their group
        to_a, to_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # ids in the order in which they are written: a group's by A, then its by B
        first_a, first_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        of_piece = np.zeros(len(b), bool)
        of_piece[first_b[1:][n_b > 0] - 1] = True
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, to_b)[group_a]] = 2 * a.astype(np.int64) + last_a
        order[np.arange(len(b)) + to_a[group_b]] = 2 * len(self.a_bytes) + 3 * b.astype(np.int64) + last_b + of_piece
        text = self.said.take(pa.array(order))
        where = np.frombuffer(text.buffers()[1], np.int32, len(order) + 1)[first_a + first_b]
        self.groups.append(pa.StringArray.from_buffers(len(n_a), pa.py_buffer(where), text.buffers()[2]))
        n_groups = np.diff(np.append(0, np.cumsum(last_b))[first_b])
        self.good = np.append(self.good, n_a > 0)
        self.sizes = np.append(self.sizes, np.array([n_a, n_b, n_groups], np.int32), 1)
        first = np.append(0, np.cumsum(n_a + n_b - n_groups))
        self.links.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(pair)))


@lru_cache(1)
def _tools(byte_level: str, pieces: bytes) -> Tokenizers:
    """One pair a Python worker."""
    return Tokenizers(byte_level, pieces)


def piece_edges(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of texts: they are apart at blanks that have no other white space on either side."""
    p = np.flatnonzero(data == 0x20)
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    p = p[~edge[p] & ~edge[p + 1]]  # not the first or the last of its text
    at = lambda i: data[np.clip(i, 0, len(data) - 1)]
    after, before = at(p + 1), at(p - 1)
    # characters that may be white space: two bytes from C2, three from E1 to E3
    wide = lambda b: (b >= 0xE1) & (b <= 0xE3)
    no_break = lambda lead, b: (lead == 0xC2) & ((b == 0x85) | (b == 0xA0))
    solid = (after > 0x20) & ~wide(after) & ~no_break(after, at(p + 2)) & (before > 0x20)
    p = p[solid & ((before < 0x80) | (~no_break(at(p - 2), before) & ~wide(at(p - 3))))]
    some = offs[1:] > offs[:-1]
    return np.sort(np.concatenate([offs[:-1][some], p + 1])), np.sort(np.concatenate([offs[1:][some], p]))


def blocks(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Rows of three kinds. (block, docs): documents, each with its id, its numbers of tokens and groups and the numbers of its pieces in order;
    documents that can't be aligned have none. (block, groups): the groups of all pieces of the block, in order of their numbers.
    (block, at, n, links): a piece, its number in the block, how often the block's documents have it, and its links."""
    kind = dict(docs.dtypes)["doc_id"]
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # two vocabularies, whose size is fixed

    def batch(block: int, rows: int, /, **columns: pa.Array) -> pa.RecordBatch:
        every = {"block": pa.array(np.full(rows, block))} | {c: columns.get(c, pa.nulls(rows, t)) for c, t in kinds.items()}
        return pa.RecordBatch.from_pydict(every)

    def listed(block: int, both: Tokenizers, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(n):
            return
        both.place.clear()  # what is listed takes its room
        groups, both.groups = pa.concat_arrays(both.groups), []
        yield batch(block, 1, groups=pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), groups))
        del groups
        at = 0
        for links in both.links:
            for lo in range(0, len(links), 8192):
                some = links.slice(lo, 8192)
                hi = at + len(some)
                yield batch(block, len(some), at=pa.array(np.arange(at, hi, dtype=np.int32)), n=pa.array(n[at:hi]), links=some)
                at = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, count = _tools(*files.value), np.zeros(0, np.int64)
        both.forget()
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi, data, offs in text_steps(b.column("text"), limit=STEP):
                starts, ends = piece_edges(data, offs)
                doc = np.searchsorted(offs, starts, "right") - 1
                _, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                raw = data.tobytes()
                known = both.number([raw[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist())])
                fine = np.ones(hi - lo, bool)
                fine[doc[~both.good[known][number]]] = False
                number, doc = known[number[fine[doc]]], doc[fine[doc]]
                count = np.append(count, np.zeros(len(both.good) - len(count), np.int64))
                count += np.bincount(number, minlength=len(count))
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                sizes = [np.diff(np.append(0, np.cumsum(n[number]))[at]) for n in both.sizes]
                seq = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(number.astype(np.int32)))
                rows = pa.StructArray.from_arrays([b.column("doc_id").slice(lo, hi - lo), *map(pa.array, sizes), seq], ["doc_id", "n_a", "n_b", "n_groups", "seq"])
                yield batch(block, 1, docs=pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), rows))
                if len(count) > KNOWN:
                    yield from listed(block, both, count)
                    both.forget()
                    block, count = block + 1, np.zeros(0, np.int64)
        yield from listed(block, both, count)
        both.forget()  # the worker stays for other tasks

    said = f"docs array<struct<doc_id: {kind}, n_a: bigint, n_b: bigint, n_groups: bigint, seq: array<int>>>, groups array<string>, at int, n long, links array<long>"
    kinds = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(said)}
    return docs.select("doc_id", "text").mapInArrow(run, f"block long, {said}")


def _links(pieces: DataFrame) -> DataFrame:
    """(block, at, n, pair): the links of pieces, a pair of ids in one number; a piece without tokens has one row without a pair."""
    return pieces.select("block", "at", "n", F.explode_outer("links").alias("pair"))


def pair_counts(pieces: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold the pair, and whether no pair with its B id has more."""
    counts = cut(_links(pieces.where("n > 0")).groupBy("pair").agg(F.sum("n").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    out = cut(counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best")))
    drop(counts)
    return out


def _figures(pieces: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """(block, best, count): of each piece of a block, in order, its links that are best and the sum of its links' counts. Written, in buckets.

    Pairs of a HOT-th of all links are joined by broadcast, inside the bucket of the block; only links of rarer pairs are shuffled, by pair,
    where none is hot, and their sums back to the bucket. Every number from 0 on has a row, so a piece's number is its place."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    often, key = F.col("count") * HOT >= total, ["block", "at"]
    known = F.broadcast(counts.where(often))
    sums = lambda rows, *names: rows.groupBy(*key).agg(*(F.sum(c).alias(n) for c, n in zip(("best", "count"), names)))
    found = sums(_links(pieces).join(known, "pair", "left"), "best", "count")
    links = _links(pieces.where("n > 0")).drop("n")
    rare = sums(links.join(known, "pair", "left_anti").join(counts.where(~often), "pair"), "more_best", "more_count")
    whole = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
    each = found.hint("merge").join(rare.repartition(buckets, "block"), key, "left").select(*key, whole("best"), whole("count"))
    per = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", F.col("best").cast("int").alias("best"), "count"))).alias("each"))
    per = per.select("block", "each.best", "each.count")
    # both sides of the join are in the block's bucket, which Spark takes for a reason not to shuffle only without this setting
    conf, name = pieces.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut_by(per, "block", buckets)
    finally:
        conf.set(name, before)


def align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (`a1,a2|b1;a3|b2,b3`) of each document, of `doc_id` and `text`.

    A is the byte-level tokenizer and reads a blank and the text, B the one of pieces, which adds the blank itself; special tokens' names in a
    text are plain text. Texts that are null, empty or not what their tokens' bytes say have zeros and no groups. Texts of any
    length are aligned whole. Rows that repeat an id are documents of their own, and all of them count; a null id is kept. Ties of counts are all
    best. Other columns are left out, whatever their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = cut_by(blocks(docs, byte_level, pieces), "block", buckets)
    each = made.where("at is not null").select("block", "at", "n", "links")
    counts = pair_counts(each)
    # written before they are joined: a task that puts a block's arrays together has nothing else in its memory
    known, figures = made.where("groups is not null").select("block", "groups"), _figures(each, counts, buckets)
    drop(counts)
    rows = made.where("docs is not null").select("block", "docs").hint("merge").join(known, "block", "left").hint("merge").join(figures, "block", "left")

    def document(d: Column) -> Column:
        total = lambda of: F.aggregate(d["seq"], F.lit(0).cast("long"), lambda s, i: s + F.get(of, i)).alias(of)
        text = F.array_join(F.transform(d["seq"], lambda i: F.get("groups", i)), ";").alias("groups")
        return F.struct(d["doc_id"].alias("doc_id"), d["n_a"].alias("n_a"), d["n_b"].alias("n_b"), d["n_groups"].alias("n_groups"), total("best"), total("count"), text)

    out = rows.select(F.inline(F.transform("docs", document)))
    links = F.col("n_a") + F.col("n_b") - F.col("n_groups")
    return out.select("doc_id", "n_a", "n_b", "n_groups", links.alias("n_links"), F.col("best").alias("n_best"), F.col("count").alias("count_sum"), "groups")
