"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into blocks of 64; four blocks make a chunk of 256 bytes, and a chunk starts
every 128, so chunks overlap and together cover the whole text. Learned filters slide over the byte
embeddings; each chunk has the mean of each rectified filter, and two self-match channels (how well a block
equals itself some bytes earlier, by which verbatim repetition shows). A hidden layer reads a chunk, its
units are max-pooled over all chunks of the document, and a logistic unit makes one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, excerpt, small_batches, text_steps, with_fields

BLOCK, CHUNK, STRIDE = 64, 4, 2  # bytes in a block; blocks in a chunk; blocks from one chunk to the next
DIM, TAP, FILTERS, HIDDEN = 8, 4, 24, 24  # byte embedding; bytes in half a filter; filters; hidden units
LAGS = range(1, 25)
#: Labelled rows that are fitted on, at most: the first by a hash of the id; characters of one text that are fitted on, at most:
#: of a longer text, `excerpt` takes pieces from its beginning to its end.
MAX_LABELLED, FIT_CHARS = 4000, 32_768
#: Blocks of a text that are worked on at once when it is scored.
SLICE = 4096


def _pad(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with each document filled up with zeros to whole blocks (one at least), after a block of zeros that keeps it apart
    from the one before; the first block of each document, and where it ends."""
    size = np.diff(offs)
    blocks = np.maximum(1, -(-size // BLOCK))
    end = np.cumsum(blocks + 1)
    first = end - blocks
    out = np.zeros((end[-1] + 1) * BLOCK, np.uint8)
    out[np.arange(len(data)) + np.repeat(first * BLOCK - offs[:-1], size)] = data
    return out, first, end


def _matches(data: np.ndarray) -> np.ndarray:
    """Per block: the largest and the mean share of bytes that equal the byte some lag before."""
    n = len(data) // BLOCK
    best, total = np.zeros(n, np.float32), np.zeros(n, np.float32)
    for lag in LAGS:
        same = np.zeros(len(data), np.uint8)
        np.equal(data[lag:], data[:-lag], out=same[lag:].view(bool))
        share = same.reshape(n, BLOCK).sum(1, dtype=np.uint16).astype(np.float32) / BLOCK
        np.maximum(best, share, out=best)
        total += share
    return np.stack([best, total / len(LAGS)], 1)


def _chunks(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end block of each chunk, and the document's first chunk."""
    count = np.maximum(1, -(-(last - first - CHUNK) // STRIDE) + 1)
    at = np.concatenate([[0], np.cumsum(count)])
    local = np.arange(at[-1]) - np.repeat(at[:-1], count)
    begin = np.repeat(first, count) + local * STRIDE
    return begin, np.minimum(begin + CHUNK, np.repeat(last, count)), at


class Net:
    """Weights, forward pass and Adam steps."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.w = {
            "emb": rng.normal(0, 0.5, (256, DIM)).astype(f),
            "near": rng.normal(0, 0.3, (TAP * DIM, FILTERS)).astype(f),
            "next": rng.normal(0, 0.3, (TAP * DIM, FILTERS)).astype(f),
            "fb": np.zeros(FILTERS, f),
            "hid": rng.normal(0, 0.3, (FILTERS + 2, HIDDEN)).astype(f),
            "hb": np.zeros(HIDDEN, f),
            "out": rng.normal(0, 0.3, HIDDEN).astype(f),
            "ob": np.zeros(1, f),
        }
        self.moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        self.steps = 0

    def _blocks(self, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(taps' embeddings, rectified filters, features of each block) of whole blocks of bytes."""
        w = self.w
        x = w["emb"][padded].reshape(-1, TAP * DIM)
        z = x @ w["near"] + w["fb"]
        z[:-1] += x[1:] @ w["next"]
        np.maximum(z, 0, out=z)
        return x, z, np.concatenate([z.reshape(-1, BLOCK // TAP, FILTERS).mean(1), _matches(padded)], 1)

    def _pooled(self, block: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray):
        """(blocks, features, hidden units of each chunk; the largest of each document) from features of blocks."""
        total = np.concatenate([np.zeros((1, block.shape[1]), np.float64), np.cumsum(block, 0, dtype=np.float64)])
        size = (end - begin)[:, None]
        feat = ((total[end] - total[begin]) / size).astype(np.float32)
        h = np.tanh(feat @ self.w["hid"] + self.w["hb"])
        return size, feat, h, np.maximum.reduceat(h, at[:-1], 0)

    def _chance(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(top @ self.w["out"] + self.w["ob"][0], -30, 30).astype(np.float64)))

    def forward(self, data: np.ndarray, offs: np.ndarray, keep: bool = False):
        """The probability of each document; but for rounding, it doesn't depend on the others."""
        padded, first, last = _pad(data, offs)
        begin, end, at = _chunks(first, last)
        x, z, block = self._blocks(padded)
        size, feat, h, top = self._pooled(block, begin, end, at)
        p = self._chance(top)
        return (p, padded, x, z, begin, end, at, size, feat, h, top) if keep else p

    def long(self, data: np.ndarray, slice_: int = SLICE) -> float:
        """The probability of one document of any length, slice by slice: only the largest units so far are carried on."""
        blocks, top = max(1, -(-len(data) // BLOCK)), None
        for a in range(0, max(1, blocks - CHUNK + STRIDE), slice_):
            b = min(blocks, a + slice_ + CHUNK - STRIDE)
            # the block before and the one after, or zeros
            padded = np.zeros((b - a + 2) * BLOCK, np.uint8)
            lo, hi = max(0, (a - 1) * BLOCK), min(len(data), (b + 1) * BLOCK)
            padded[lo - (a - 1) * BLOCK :][: hi - lo] = data[lo:hi]
            begin, end, at = _chunks(np.array([1]), np.array([b - a + 1]))
            most = self._pooled(self._blocks(padded)[2], begin, end, at)[3]
            top = most if top is None else np.maximum(top, most)
        return float(self._chance(top)[0])

    def step(self, data: np.ndarray, offs: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> float:
        w = self.w
        p, padded, x, z, begin, end, at, size, feat, h, top = self.forward(data, offs, True)
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": top.T @ d, "ob": d.sum(keepdims=True)}
        doc = np.repeat(np.arange(len(y)), np.diff(at))
        won = (h == top[doc]).astype(np.float32)
        won /= np.maximum(1, np.add.reduceat(won, at[:-1], 0))[doc]
        dh = won * (d[:, None] * w["out"])[doc] * (1 - h * h)
        g |= {"hid": feat.T @ dh, "hb": dh.sum(0)}
        dfeat = (dh @ w["hid"].T)[:, :FILTERS] / size
        per = BLOCK // TAP
        dblock = np.zeros((len(padded) // BLOCK + 1, FILTERS), np.float32)
        np.add.at(dblock, begin, dfeat)
        np.add.at(dblock, end, -dfeat)
        dz = np.repeat(np.cumsum(dblock, 0)[:-1] / per, per, 0) * (z > 0)
        g |= {"near": x.T @ dz, "next": x[1:].T @ dz[:-1], "fb": dz.sum(0)}
        dx = dz @ w["near"].T
        dx[1:] += dz[:-1] @ w["next"].T
        dx = dx.reshape(-1, DIM)
        g["emb"] = np.stack([np.bincount(padded, dx[:, j], 256) for j in range(DIM)], 1).astype(np.float32)
        self.steps += 1
        for k, v in g.items():
            m, s = self.moments[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            w[k] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-8)
        return float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / weight.sum())


def fit(texts: list[str], y: list[int], epochs: int = 6, batch: int = 64, seed: int = 7) -> Net:
    """A net for texts and 0/1 labels; both classes weigh equally. No rows: the untrained net, which is near 0.5."""
    net, rng = Net(seed), np.random.default_rng(seed)
    raw = [t.encode() for t in texts]
    y = np.asarray(y, float)
    ones = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    weight = np.where(y > 0, len(y) / ones[0], len(y) / ones[1]) if len(y) else y
    for epoch in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            at = order[i : i + batch]
            data = np.frombuffer(b"".join(raw[j] for j in at), np.uint8)
            net.step(data, np.concatenate([[0], np.cumsum([len(raw[j]) for j in at])]), y[at], weight[at], 0.01 * 0.6**epoch)
    return net


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, quality) of at most `limit` labelled documents outside the held-out fold, chosen by a hash of the id; of rows
    that repeat an id, one, by a hash of the text; of long texts, `excerpt`."""
    y = labels.where("quality in (0, 1) and doc_id is not null")
    y = y.where(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    y = y.orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(limit)
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(y), "doc_id")
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("text", excerpt(F.col("text"), FIT_CHARS))
    return rows.groupBy("doc_id", "quality").agg(F.min_by("text", "h").alias("text")).select("doc_id", "text", "quality")


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Net:
    """Fits on the driver, on the bounded sample of `labelled`; the result doesn't depend on the row order."""
    rows = sorted(labelled(docs, labels, limit).collect(), key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows], [r.quality for r in rows])


def score(docs: DataFrame, net: Net, name: str = "score") -> DataFrame:
    """docs with a column of this name, the probability of label 1 of each whole text.

    Null and empty texts score as empty; a text of any length is worked through in slices of bounded memory. A column of
    that name is replaced; all others, nulls in them and rows that are repeated stay as they are; an empty table gives no rows.
    """
    columns = [c for c in docs.columns if c.lower() not in (name.lower(), "text")]
    weights = net.w
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net()
        net.w = weights
        for b in batches:
            p = [np.zeros(0)]
            for _, _, data, offs in text_steps(b.column("text"), limit=SLICE * BLOCK):
                p.append(net.forward(data, offs) if len(data) <= SLICE * BLOCK else np.array([net.long(data)]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), b.column("text"), pa.array(np.concatenate(p), pa.float64())], [*columns, "text", name])

    kept = docs.select(*columns, "text")
    return kept.mapInArrow(run, with_fields(kept.schema, **{name: "double"}))


def quality(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, score_as: str = "score", predicted_as: str = "predicted") -> DataFrame:
    """docs with a score, and whether it is 0.5 or more as 1 or 0, in columns of the two names, which replace columns of that name.

    Nulls in any column, empty and very long texts, repeated rows, an empty table and columns of other names are fine (see `score`);
    rows stay as they are. Without a label the score is an unfitted net's. A score of 0.5 counts as 1.
    """
    out = score(docs, train(docs, labels, limit), score_as)
    return out.withColumn(predicted_as, (F.col(score_as) >= 0.5).cast("int"))
