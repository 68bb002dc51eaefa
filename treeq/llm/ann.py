"""Nearest neighbours by largest cosine: score-aware quantisation, four-bit tables, exact reranking.

A unit vector is stored as one of 16 centres in each of many small subspaces: four bits each. Codes and centres are
chosen by an anisotropic loss, in which the part of the residual that is parallel to the vector weighs more than the rest,
because only that part moves large inner products. A query scans codes by table lookup (two subspaces at a
time). A code carries the angle between its vector and the point it stands for, so a scanned score bounds the true cosine:
all that can be among the nearest by that bound are ranked by their true cosine, in double precision. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .vectors import matrix, with_node

#: Vectors that centres are fitted on, at most; the angle (cosine) from which neighbours matter, which sets the weights.
SAMPLE, COSINE = 16384, 0.2
#: Queries and codes of a block (codes of up to WIDE dimensions; fewer of longer ones; codes are sent once per block of queries); per result asked for, candidates whose true cosines set a block's cut-off.
QUERIES, CODES, WIDE, PASS = 2048, 8192, 256, 24
#: More than the rounding of scores scanned in single precision (per subspace), and of cosines in double precision.
SINGLE, DOUBLE = 1e-7, 1e-9


class Quantiser:
    """Centres (subspaces, 16, width) for vectors of one length, filled up with zeros to whole pairs of subspaces."""

    def __init__(self, dim: int, width: int = 1):
        self.dim, self.width = dim, width
        self.parts = -(-dim // (2 * width)) * 2
        self.eta = max(1.0, (dim - 1) * COSINE**2 / (1 - COSINE**2))
        self.centres = np.zeros((self.parts, 16, width))

    def cutup(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * self.width))
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, self.width)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """(rows, subspaces) codes: nearest centres first, then each subspace in turn by the whole vector's loss."""
        v = self.cutup(x)
        codes = np.stack([((v[:, m, None] - c) ** 2).sum(2).argmin(1) for m, c in enumerate(self.centres)], 1)
        part = lambda m, c: ((v[:, m] - self.centres[m][c]) * v[:, m]).sum(1)
        along = np.stack([part(m, codes[:, m]) for m in range(self.parts)], 1)
        total = along.sum(1)
        for _ in range(rounds):
            for m, c in enumerate(self.centres):
                rest = total - along[:, m]
                r = v[:, m, None] - c
                cost = (r**2).sum(2) + (self.eta - 1) * (rest[:, None] + (r * v[:, m, None]).sum(2)) ** 2
                codes[:, m] = cost.argmin(1)
                along[:, m] = part(m, codes[:, m])
                total = rest + along[:, m]
        return codes.astype(np.uint8)

    def fit(self, x: np.ndarray, rounds: int = 6, seed: int = 1) -> Quantiser:
        v, rng = self.cutup(x), np.random.default_rng(seed)
        for m in range(self.parts):
            self.centres[m] = v[rng.choice(len(x), 16, replace=len(x) < 16), m]
            for _ in range(4):
                near = ((v[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1)
                for c in np.unique(near):
                    self.centres[m, c] = v[near == c, m].mean(0)
        for _ in range(rounds):
            codes = self.encode(x, 1)
            along = np.stack([((v[:, m] - self.centres[m][codes[:, m]]) * v[:, m]).sum(1) for m in range(self.parts)], 1)
            total = along.sum(1)
            for m in range(self.parts):
                for c in np.unique(codes[:, m]):  # weighted least squares for one centre
                    at = codes[:, m] == c
                    u, rest = v[at, m], (total - along[:, m])[at]
                    left = at.sum() * np.eye(self.width) + (self.eta - 1) * u.T @ u
                    right = u.sum(0) + (self.eta - 1) * (u * (rest + (u**2).sum(1))[:, None]).sum(0)
                    self.centres[m, c] = np.linalg.solve(left, right)
                now = ((v[:, m] - self.centres[m][codes[:, m]]) * v[:, m]).sum(1)
                total += now - along[:, m]
                along[:, m] = now
        return self

    def points(self, codes: np.ndarray) -> np.ndarray:
        """The points that codes stand for, in the vectors' own dimensions (those of the filling are left out)."""
        return np.concatenate([self.centres[m][codes[:, m]] for m in range(self.parts)], 1)[:, : self.dim]

    def bounds(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length of a code's point, its angle to the unit vector x); a point of length 0 says nothing, so its angle is pi."""
        c = self.points(codes)
        length = np.sqrt((c * c).sum(1))
        some = length > 0
        cos = (c * x).sum(1) / np.where(some, length, 1)
        return np.where(some, length, 1), np.where(some, np.arccos(np.clip(cos - DOUBLE, -1, 1)), np.pi)

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, 0::2] | codes[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(byte, 256, queries) inner products of a query's two parts with the two centres that a byte names."""
        t = np.einsum("qmw,mcw->mcq", self.cutup(q), self.centres).astype(np.float32)
        return (t[1::2, :, None] + t[0::2, None, :]).reshape(self.parts // 2, 256, len(q))

    def scan(self, tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """(codes, queries) scores."""
        out = tables[0][packed[:, 0]]
        for m in range(1, len(tables)):
            out += tables[m][packed[:, m]]
        return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows with rows, each by itself: the same whatever else is in the block. Scaling first keeps squares in range."""
    x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def nearest(vectors: DataFrame, queries, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row of `vectors` for which the Column `queries` holds.

    All other rows are candidates (a query's own row is not). Vectors that are null, empty, zero or have null or
    non-finite components, and rows without an id, take no part. Equal vectors are scanned once, and stand for the
    k + 1 smallest of their ids; ties go to the smaller id. Vectors of other lengths than the query's are no candidates. Rows that repeat an id with an
    equal vector count as one. Other columns are left out, whatever their names; an empty table gives no rows.
    """
    rows = cut(with_node(vectors.withColumn("asks", F.coalesce(queries, F.lit(False))).select("vec_id", "embedding", "asks")).withColumn("dim", F.size("embedding")))
    spark, found = vectors.sparkSession, None
    ids = rows.select("node", "vec_id").distinct().withColumn("k", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("k") <= k + 1).drop("k")
    ids = cut(ids)
    classes = cut(rows.groupBy("node", "dim").agg(F.first("embedding").alias("embedding"), F.max("asks").alias("asks"), F.min("vec_id").alias("least")))
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():
        part = _scan(classes.where(F.col("dim") == dim), dim, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id {dict(vectors.dtypes)['vec_id']}, rank int, vec_id {dict(vectors.dtypes)['vec_id']}, score double")
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).distinct()
    # a query's class has the same neighbours for all its members, k + 1 of them besides the member itself
    each = found.join(ids, "node").withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    each = asked.join(cut(each), "query").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(classes: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, node, score): the k + 1 best of each block of codes by exact cosine, then by smallest id, for classes of one length."""
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("embedding").toPandas()
    quantiser = Quantiser(dim).fit(matrix(sample.embedding))
    first, keep = k * PASS, k + 1
    kind = classes.schema["least"].dataType.simpleString()

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = matrix(pdf.embedding)
                codes = quantiser.encode(x)
                length, angle = quantiser.bounds(x, codes)
                yield pdf.assign(code=[r.tobytes() for r in quantiser.pack(codes)], length=length, angle=angle)

    vector = dict(classes.dtypes)["embedding"]
    coded = cut(classes.select("node", "least", "embedding").mapInPandas(encode, f"node binary, least {kind}, embedding {vector}, code binary, length double, angle double"))
    asking = classes.where("asks").select(F.col("node").alias("query"), "embedding")
    block = max(1, CODES * WIDE // max(dim, WIDE))
    code_blocks, query_blocks = max(1, -(-coded.count() // block)), max(1, -(-asking.count() // QUERIES))
    spread = lambda of, n, other, m: (F.pmod(F.xxhash64(of), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    cb, qb = spread("node", code_blocks, "qb", query_blocks)
    codes = coded.select("*", cb.alias("cb"), qb.alias("qb"))
    qb, cb = spread("query", query_blocks, "cb", code_blocks)
    asks = asking.select("query", "embedding", qb.alias("qb"), cb.alias("cb"))

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "node": [], "score": []})
        right = right.sort_values("least", kind="stable")
        packed = np.frombuffer(b"".join(right.code), np.uint8).reshape(len(right), -1)
        unit, raw, node = matrix(right.embedding), right.embedding.to_numpy(), right.node.to_numpy()
        length, angle = right["length"].to_numpy(), right["angle"].to_numpy()
        n, m = min(first, len(right)), min(keep, len(right))
        out = []
        for lo in range(0, len(left), 64):
            some = left.iloc[lo : lo + 64]
            q = matrix(some.embedding)
            s = quantiser.scan(quantiser.tables(q), packed).T
            best = np.argpartition(-s, n - 1, 1)[:, :n]
            true = np.stack([unit[b] @ v for b, v in zip(best, q, strict=True)])
            least = np.partition(true, n - m, 1)[:, n - m] - DOUBLE  # no more than the m-th best cosine
            # a vector is no nearer to the query than its code's point, less the angle between the two
            reach = s / length + SINGLE * quantiser.parts >= np.cos(np.minimum(np.pi, np.arccos(np.clip(least, -1, 1))[:, None] + angle))
            for i in range(len(some)):
                at = np.flatnonzero(reach[i])
                t = unit[at] @ q[i]
                at = at[t >= np.partition(t, len(t) - m)[len(t) - m] - DOUBLE]
                asked = some.embedding.iloc[i]
                exact = cosines(np.stack(raw[at]).astype(np.float64), np.asarray(asked, np.float64)[None])
                top = np.argsort(-exact, kind="stable")[:m]
                out.append(pd.DataFrame({"query": [some["query"].iloc[i]] * m, "node": node[at[top]], "score": exact[top]}))
        return pd.concat(out, ignore_index=True)

    return asks.groupBy("qb", "cb").cogroup(codes.groupBy("qb", "cb")).applyInPandas(scan, "query binary, node binary, score double")
