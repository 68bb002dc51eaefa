"""Language of words and documents: a linear-chain conditional random field over words.

A word's features are hashed byte trigrams, its first and last bytes (affixes) and the word itself (a lexicon with
learned weights); transitions between the languages of neighbouring words and the language of a first word are learned
too. Forward-backward gives every word of a text, also of a code-switched one, a probability for each language; a
document's language is the one with the largest mean over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, excerpt, small_batches, span_hashes, text_steps, with_fields, words

#: Documents that are fitted on, at most: the first by a hash of the id; characters of one text that are fitted on, at most:
#: of a longer text, `excerpt` takes pieces from its beginning to its end.
MAX_LABELLED, FIT_CHARS = 2000, 32_768
#: Bytes of a text that are worked on at once when it is labelled.
SLICE = 1 << 18
BITS, BLOCK = 16, 128
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MIX = np.uint32(0x9E3779B1)


def _slots(value: np.ndarray, kind: int) -> np.ndarray:
    return ((value.astype(np.uint32) + np.uint32(kind * 0x3C6EF372 & 0xFFFFFFFF)) * _MIX) >> np.uint32(32 - BITS)


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the trigrams around every byte that is in a word, in order; slots of each word's affixes and of itself).

    A word's features come from its own bytes, with blanks around them, whatever stands beside it."""
    b = np.zeros(len(data) + 4, np.uint32)
    b[2:-2] = data
    length = ends - starts
    first = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else np.zeros(0, np.int64)
    at = np.arange(length.sum()) + np.repeat(starts - first, length)
    left, right = b[at + 1], b[at + 3]
    left[first] = 32
    right[first + length - 1] = 32
    grams = _slots(left << np.uint32(16) | b[at + 2] << np.uint32(8) | right, 1)
    s, e = starts + 2, ends + 2
    head = [np.where(length > i, b[s + i], np.uint32(32)) for i in range(3)]
    tail = [np.where(length > i, b[e - 1 - i], np.uint32(0)) for i in range(3)]
    own = np.stack([
        _slots(head[0] << np.uint32(16) | head[1] << np.uint32(8) | head[2], 2),
        _slots(tail[2] << np.uint32(16) | tail[1] << np.uint32(8) | tail[0], 3),
        _slots(tail[1] << np.uint32(8) | tail[0], 4),
        _slots((span_hashes(data, starts, ends) >> np.uint64(32)).astype(np.uint32), 5),
    ], 1)
    return grams, own


class Field:
    """Weights by hashed feature, transitions and first-word weights; languages in order of name."""

    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs, self.weight = langs, np.zeros((1 << BITS, n), np.float32)
        self.move, self.first = np.zeros((n, n)), np.zeros(n)

    def scores(self, grams: np.ndarray, own: np.ndarray, length: np.ndarray) -> np.ndarray:
        total = np.add.reduceat(self.weight[grams], np.concatenate([[0], np.cumsum(length)[:-1]]), 0)
        for j in range(own.shape[1]):
            total += self.weight[own[:, j]]
        return total

    def transfer(self, scores: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """What a stretch of words does to a message from its left, as a matrix (scaled); from its right, its transpose does."""
        return self._stretch(scores, begins)[4]

    def _stretch(self, scores: np.ndarray, begins: np.ndarray):
        """(weights of words, which of them begin a sequence, which are words at all, by blocks; matrix of each block, matrix of all)."""
        n, k = scores.shape
        blocks = -(-n // BLOCK)
        e = np.ones((blocks * BLOCK, k))
        e[:n] = np.exp(scores - scores.max(1, keepdims=True))
        reset, real = np.zeros(blocks * BLOCK, bool), np.zeros(blocks * BLOCK, bool)
        reset[:n], real[:n] = begins, True
        e, reset, real = e.reshape(blocks, BLOCK, k), reset.reshape(blocks, BLOCK), real.reshape(blocks, BLOCK)
        move, first = np.exp(self.move), np.exp(self.first)
        p = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
        for t in range(BLOCK):
            q = (p.reshape(-1, k) @ move).reshape(blocks, k, k)
            at = np.flatnonzero(reset[:, t])
            if len(at):
                q[at] = p[at].sum(2, keepdims=True) * first
            q = q * e[:, t, None, :]
            p = np.where(real[:, t, None, None], q / q.sum((1, 2), keepdims=True), p)
        whole = np.eye(k)
        for x in p:
            whole = whole @ x
            whole /= whole.sum()
        return e, reset, real, p, whole

    def messages(self, scores: np.ndarray, begins: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised forward and backward messages of a stream of sequences; begins marks their first words. Of a stretch of a
        longer stream, with the messages that reach it from the left and from the right.

        Exact, and quick for long sequences: blocks of words are multiplied out side by side, a short loop links
        the blocks, and then every block is filled in side by side.
        """
        n, k = scores.shape
        if before is None:  # the stream begins here, so its first word begins a sequence
            begins = begins.copy()
            begins[0] = True
        e, reset, real, p, _ = self._stretch(scores, begins)
        blocks = len(p)
        move, first = np.exp(self.move), np.exp(self.first)
        left, right = np.empty((blocks, k)), np.empty((blocks, k))
        x = np.full(k, 1 / k) if before is None else before
        for i in range(blocks):
            left[i] = x
            x = x @ p[i]
            x /= x.sum()
        x = np.full(k, 1 / k) if after is None else after
        for i in range(blocks - 1, -1, -1):
            right[i] = x
            x = p[i] @ x
            x /= x.sum()
        forward, backward = np.empty_like(e), np.empty_like(e)
        x, y = left, right
        for t in range(BLOCK):
            x = np.where(reset[:, t, None], first, x @ move) * e[:, t]
            x /= x.sum(1, keepdims=True)
            forward[:, t] = x
            s = BLOCK - 1 - t
            backward[:, s] = y
            z = y * e[:, s]
            z = np.where(reset[:, s, None], 1.0, z @ move.T)
            y = np.where(real[:, s, None], z / z.sum(1, keepdims=True), y)
        return forward.reshape(-1, k)[:n], backward.reshape(-1, k)[:n], e.reshape(-1, k)[:n]

    def posteriors(self, scores: np.ndarray, begins: np.ndarray) -> np.ndarray:
        forward, backward, _ = self.messages(scores, begins)
        p = forward * backward
        return p / p.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 3, run: int = 32, seed: int = 3) -> Field:
    """A field for texts of one known language each, fitted on sequences that switch between texts every few words."""
    field = Field(sorted(set(langs)))
    if not texts:
        return field
    rng, number = np.random.default_rng(seed), {x: i for i, x in enumerate(field.langs)}
    data = pa.array(texts, pa.string())
    parts = []
    for lo, hi, buf, offs in text_steps(data, lower=True, limit=1 << 30):
        starts, ends, doc = words(buf, offs, ~_LETTER)
        parts.append((*word_features(buf, starts, ends), ends - starts, doc + lo))
    grams, own, length, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.concatenate([[0], np.cumsum(length)])
    label = np.array([number[x] for x in langs])[doc]
    count = len(length)
    weights = np.bincount(label, minlength=len(field.langs))
    chance = (weights.max() / np.maximum(1, weights))[label]
    chance /= chance.sum()
    speed = np.full_like(field.weight, 1e-3)
    speed_m, speed_f = np.full_like(field.move, 1e-3), np.full_like(field.first, 1e-3)
    k = len(field.langs)
    for epoch in range(epochs):
        for _ in range(max(1, min(60, count // (128 * run)))):
            pieces = rng.choice(count, 128 * run // 6, p=chance)  # a switch after about six words
            size = rng.integers(1, 12, len(pieces))
            rows = np.concatenate([np.arange(p, min(count, p + s)) for p, s in zip(pieces, size, strict=True)])
            rows = rows[: len(rows) // run * run] if len(rows) >= run else rows
            begins = np.arange(len(rows)) % run == 0
            g = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows])
            word = np.repeat(np.arange(len(rows)), length[rows])
            forward, backward, e = field.messages(field.scores(grams[g], own[rows], length[rows]), begins)
            p = forward * backward
            p /= p.sum(1, keepdims=True)
            gold = np.eye(k)[label[rows]]
            d = (gold - p).astype(np.float32)
            grad = np.zeros_like(field.weight)
            slots = np.concatenate([grams[g], own[rows].T.ravel()])
            rowsof = np.concatenate([word, np.tile(np.arange(len(rows)), own.shape[1])])
            for j in range(k):
                grad[:, j] = np.bincount(slots, d[rowsof, j], 1 << BITS)
            pair = forward[:-1, :, None] * np.exp(field.move) * (e * backward)[1:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            inner = ~begins[1:]
            gm = np.einsum("ni,nj->ij", gold[:-1][inner], gold[1:][inner]) - pair[inner].sum(0)
            gf = d[begins].sum(0)
            for w, s, x in ((field.weight, speed, grad), (field.move, speed_m, gm), (field.first, speed_f, gf)):
                s += x * x
                w += 0.25 * x / np.sqrt(s)
    return field


def labelled(docs: DataFrame, limit: int = MAX_LABELLED, fold: int = 5) -> DataFrame:
    """(doc_id, text, lang) of at most `limit` documents that have a language, outside the held-out fold, by a hash of the id; of
    rows that repeat an id, one, by a hash of the text; of long texts, `excerpt`."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null").where(crc_mod("doc_id", fold) != 0)
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit(29)), "doc_id").limit(limit)
    rows = rows.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id")
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("text", excerpt(F.col("text"), FIT_CHARS))
    one = F.min_by(F.struct("text", "lang"), F.struct("h", "lang")).alias("one")
    return rows.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.lang")


def train(docs: DataFrame, limit: int = MAX_LABELLED) -> Field:
    """Fits on the driver, on the bounded sample of `labelled`."""
    rows = sorted(labelled(docs, limit).collect(), key=lambda r: (r.doc_id, r.lang, r.text))
    return fit([r.text for r in rows], [r.lang for r in rows])


def label_words(field: Field, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document, probability per language) of each word of a step of lower-cased texts."""
    starts, ends, doc = words(data, offs, ~_LETTER)
    if not len(starts) or not field.langs:
        return starts, ends, doc, np.zeros((len(starts), len(field.langs)))
    grams, own = word_features(data, starts, ends)
    begins = np.ones(len(doc), bool)
    begins[1:] = doc[1:] != doc[:-1]
    return starts, ends, doc, field.posteriors(field.scores(grams, own, ends - starts), begins)


def _stretches(data: np.ndarray, size: int = SLICE) -> list[tuple[int, int]]:
    """Where a text is cut, about every `size` bytes and behind a byte that is no letter; a word of more than that is cut itself."""
    cuts = [0]
    while len(data) - cuts[-1] > size:
        lo, hi = cuts[-1] + size // 2, cuts[-1] + size
        free = np.flatnonzero(~_LETTER[data[lo:hi]])
        cuts.append(lo + int(free[-1]) + 1 if len(free) else hi)
    return list(zip(cuts, [*cuts[1:], len(data)], strict=True))


def label_long(field: Field, data: np.ndarray, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, probabilities) of the words of one text of any length, stretch by stretch.

    A first pass makes each stretch a small matrix, from which the messages between stretches come; a second one labels the words.
    """
    def scored(lo: int, hi: int):
        starts, ends, _ = words(data[lo:hi], np.array([0, hi - lo]), ~_LETTER)
        if not len(starts):
            return starts, ends, None
        return starts, ends, field.scores(*word_features(data[lo:hi], starts, ends), ends - starts)

    k, cuts, through, some = len(field.langs), _stretches(data, size), [], False
    for lo, hi in cuts:
        scores = scored(lo, hi)[2]
        begins = np.zeros(0 if scores is None else len(scores), bool)
        if scores is not None and not some:
            begins[0] = some = True
        through.append(np.eye(k) if scores is None else field.transfer(scores, begins))
    after = [np.full(k, 1 / k)]
    for m in reversed(through):
        x = m @ after[-1]
        after.append(x / x.sum())
    before, some = np.full(k, 1 / k), False
    for (lo, hi), m, right in zip(cuts, through, after[-2::-1], strict=True):
        starts, ends, scores = scored(lo, hi)
        if scores is not None:
            forward, backward, _ = field.messages(scores, np.zeros(len(scores), bool), before if some else None, right)
            p, some = forward * backward, True
            yield starts + lo, ends + lo, p / p.sum(1, keepdims=True)
        x = before @ m
        before = x / x.sum()


def _means(field: Field, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document of a step: number of words, mean probability of each language, whether a word begins with an ASCII letter."""
    docs, k = len(offs) - 1, len(field.langs)
    n, total, plain = np.zeros(docs, np.int64), np.zeros((docs, max(1, k))), np.zeros(docs, bool)
    if docs == 1 and k and len(data) > SLICE:
        parts = ((s, np.zeros(len(s), np.int64), p) for s, _, p in label_long(field, data))
    else:
        s, _, d, p = label_words(field, data, offs)
        parts = [(s, d, p)]
    for starts, doc, p in parts:
        n += np.bincount(doc, minlength=docs)
        for j in range(k):
            total[:, j] += np.bincount(doc, p[:, j], docs)
        plain[doc[data[starts] < 0x80]] = True
    return n, total / np.maximum(1, n)[:, None], plain


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """docs with lang_pred and score: the language with the largest mean probability over the words (of equal ones the first by
    name), and that mean.

    A null text, or one without any letter, is `und` with score 0; so is every text if no language was learned. A text of any length is
    labelled as one sequence, in stretches of bounded memory. Columns of the two names are replaced; all others,
    nulls in them and rows that are repeated stay as they are; an empty table gives no rows.
    """
    columns = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "text")]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score = [], []
            for lo, hi, data, offs in text_steps(b.column("text"), lower=True, limit=SLICE):
                n, mean, plain = _means(field, data, offs)
                top = mean.argmax(1)
                for i in range(hi - lo):
                    letter = plain[i] or any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode(errors="ignore")))
                    known = field.langs and n[i] and letter
                    best.append(field.langs[top[i]] if known else "und")
                    score.append(float(min(1.0, mean[i, top[i]])) if known else 0.0)
            values = [*(b.column(c) for c in columns), b.column("text"), pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(values, [*columns, "text", "lang_pred", "score"])

    kept = docs.select(*columns, "text")
    return kept.mapInArrow(run, with_fields(kept.schema, lang_pred="string", score="double"))


def langid(docs: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """docs with lang_pred and score, by a field fitted on a bounded sample of docs; nulls, odd texts, repeated rows, empty tables and
    clashing names as in `predict`."""
    return predict(docs, train(docs, limit))
