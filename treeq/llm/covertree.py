"""Near-duplicate vectors by cosine: cover trees and a dual traversal with exact results.

On unit vectors a cosine is a chord length, a metric. Vectors are dealt to blocks around pivots; each block gets a cover tree, from
one root down: nested centres whose radii halve from level to level (the root's holds everything), each vector within a level's radius of its
centre, and centres of a level further apart than that. Two blocks are compared by walking their trees together from the two roots, level by level:
a pair of nodes goes on only if its centres are nearer than the threshold plus both covering radii (the true largest distances below
the nodes), so whole pairs of subtrees fall away; a pair that lies within the threshold whatever its members is counted whole. The last
level compares vectors in double precision. Pairs of blocks whose pivots are too far apart for their radii are left out before
that, by the same bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .neardup import _forest
from .vectors import matrix, usable, with_node

#: Vectors of a block, about; pivots at most; levels of a tree from its root (the vectors themselves are one more).
BLOCK, PIVOTS, DEPTH = 3072, 512, 5
_EPS = 1e-7
#: Node pairs of two parents from which on they are taken as a matrix product; partners of a node likewise; rows of such a product.
DENSE, MANY, ROWS = 4096, 1024, 1024


def _levels(x: np.ndarray) -> np.ndarray:
    """(levels, rows) of each vector's centre at each radius; a centre is its own centre at all deeper levels."""
    n = len(x)
    small = x.astype(np.float32)
    gram = small @ small.T
    out = np.zeros((DEPTH, n), np.int64)  # the root is the first vector
    root = np.sqrt(max(0.0, 2 - 2 * float(gram[0].min())))
    for level in range(1, DEPTH):
        radius = root / 2**level
        parent, near = out[level - 1], gram >= 1 - radius * radius / 2
        alone = near.sum(1) == 1
        centre, covered = alone.copy(), alone.copy()
        for i in np.flatnonzero(~alone & (parent == np.arange(n))):  # centres of the level above stay centres, and come first
            centre[i] = covered[i] = True
            covered |= near[i] & (parent == i)
        for i in np.flatnonzero(~alone):
            if not covered[i]:
                centre[i] = True
                covered |= near[i] & (parent == parent[i])
        out[level] = np.arange(n)
        centres, rest = np.flatnonzero(centre), np.flatnonzero(~centre)
        for lo in range(0, len(rest), ROWS):  # the nearest of the parent's centres
            some = rest[lo : lo + ROWS]
            g = np.where(parent[some][:, None] == parent[centres], gram[some][:, centres], -np.inf)
            out[level, some] = centres[g.argmax(1)]
    return out


class Tree:
    """A block's tree: per level the centres, their covering radii and their children (nodes of the next level)."""

    def __init__(self, x: np.ndarray, centre: np.ndarray):
        self.x, self.nodes, self.radius, self.children = x, [], [], []
        rows = np.arange(len(x))
        for level in range(len(centre) + 1):
            c = centre[level] if level < len(centre) else rows
            ids, inverse = np.unique(c, return_inverse=True)
            away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[c])))
            r = np.zeros(len(ids))
            np.maximum.at(r, inverse, away)
            r[np.bincount(inverse) == 1] = 0
            self.nodes.append(ids)
            self.radius.append(r)
            if level:
                above = np.searchsorted(self.nodes[level - 1], centre[level - 1][ids])
                order = np.argsort(above, kind="stable")
                self.children.append((order, np.searchsorted(above[order], np.arange(len(self.nodes[level - 1]) + 1))))
        self.size = [np.bincount(np.searchsorted(ids, centre[level])) if level < len(centre) else np.ones(len(x), int) for level, ids in enumerate(self.nodes)]
        self.below = centre
        self.small = x.astype(np.float32)

    def expand(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in `node`, child) for every child of the nodes."""
        order, at = self.children[level]
        count = at[node + 1] - at[node]
        which = np.repeat(np.arange(len(node)), count)
        return which, order[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[node], count)]


def _near(a: Tree, b: Tree, level: int, i: np.ndarray, j: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes i of a and j of b at a level, all pairs whose centres are nearer than the limit and both radii, from products in
    single precision with a margin for it. Most nodes are single vectors (radius 0): for them one bound holds."""
    p, q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ra, rb = a.radius[level], b.radius[level]
    for left in (i[ra[i] == 0], i[ra[i] > 0]):
        for right in (j[rb[j] == 0], j[rb[j] > 0]):
            for lo in range(0, len(left) if len(right) else 0, ROWS):
                some = left[lo : lo + ROWS]
                reach = np.full((1, 1), limit)
                if ra[some[0]] or rb[right[0]]:
                    reach = np.minimum(2, limit + ra[some][:, None] + rb[right])
                g = a.small[a.nodes[level][some]] @ b.small[b.nodes[level][right]].T
                u, v = np.nonzero(g >= (1 - reach * reach / 2 - 1e-5).astype(np.float32))
                p.append(some[u])
                q.append(right[v])
    return np.concatenate(p), np.concatenate(q)


def dual(a: Tree, b: Tree, cosine: float, same: bool, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Linked pairs of rows (i of a, j of b; each pair once, in either order, if the trees are the same), and node pairs (level, p, q) all of
    whose rows link. `seen` gets the number of node pairs of each level that are looked at: the others fell away above."""
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    whole: list[tuple[int, int, int]] = []
    chord = lambda g: np.sqrt(np.maximum(0, 2 - 2 * g))
    done: list[tuple[np.ndarray, np.ndarray]] = []

    def sure(level: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are to be looked into: without those of two single vectors, which are done, and those all of whose rows link."""
        r, size = a.radius[level][p] + b.radius[level][q], a.size[level][p] * b.size[level][q]
        done.append((a.nodes[level][p[size == 1]], b.nodes[level][q[size == 1]]))
        all_ = (r < limit) & (size > 1)
        at = np.flatnonzero(all_)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            d = chord(np.einsum("ij,ij->i", a.x[a.nodes[level][p[some]]], b.x[b.nodes[level][q[some]]]))
            all_[some] = d + r[some] < limit - _EPS
        whole.extend((level, int(x), int(y)) for x, y in zip(p[all_], q[all_], strict=True))
        rest = ~all_ & (size > 1)
        return p[rest], q[rest]

    last = len(a.nodes) - 1
    p, q = sure(0, np.zeros(1, np.int64), np.zeros(1, np.int64))
    for level in range(1, last + 1):
        keep_p, keep_q, looked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        (oa, ta), (ob, tb) = a.children[level - 1], b.children[level - 1]
        count = (ta[p + 1] - ta[p]) * (tb[q + 1] - tb[q])
        for x, y in zip(p[count >= DENSE], q[count >= DENSE], strict=True):
            i, j = oa[ta[x] : ta[x + 1]], ob[tb[y] : tb[y + 1]]
            looked += len(i) * len(j)
            u, v = _near(a, b, level, i, j, limit)
            ok = u <= v if same and x == y else slice(None)  # below one node, one order of a pair is enough
            keep_p.append(u[ok])
            keep_q.append(v[ok])
        p, q = p[count < DENSE], q[count < DENSE]
        for left in (True, False):  # nodes with many partners: their children against all the partners' children
            one, other = (p, q) if left else (q, p)
            alone = np.ones(len(p), bool)
            order = np.argsort(one, kind="stable")
            often = np.bincount(one, minlength=1)
            ends = np.cumsum(often)
            for x in np.flatnonzero(often >= MANY):
                at = order[ends[x] - often[x] : ends[x]]
                at = at[p[at] != q[at]] if same else at
                alone[at] = False
                mine = oa[ta[x] : ta[x + 1]] if left else ob[tb[x] : tb[x + 1]]
                its = (b if left else a).expand(level - 1, other[at])[1]
                looked += len(mine) * len(its)
                u, v = _near(a, b, level, mine, its, limit) if left else _near(a, b, level, its, mine, limit)
                keep_p.append(u)
                keep_q.append(v)
            p, q = p[alone], q[alone]
        for lo in range(0, len(p), 1 << 14):
            some, other = p[lo : lo + (1 << 14)], q[lo : lo + (1 << 14)]
            k, i = a.expand(level - 1, some)
            m, j = b.expand(level - 1, other[k])
            looked += len(j)
            i, alike = i[m], (some == other)[k][m]
            if same:
                ok = ~alike | (i <= j)
                i, j = i[ok], j[ok]
            for at in range(0, len(i), 1 << 16):
                u, v = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                e = chord(np.einsum("ij,ij->i", a.x[a.nodes[level][u]], b.x[b.nodes[level][v]]))
                ok = e <= limit + a.radius[level][u] + b.radius[level][v] + _EPS
                keep_p.append(u[ok])
                keep_q.append(v[ok])
        p, q = np.concatenate(keep_p), np.concatenate(keep_q)
        if seen is not None:
            seen.append(looked)
        if level < last:
            p, q = sure(level, p, q)
    done.append((a.nodes[-1][p], b.nodes[-1][q]))
    i, j = (np.concatenate(x) for x in zip(*done, strict=True))
    ok = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", a.x[i[lo : lo + (1 << 16)]], b.x[j[lo : lo + (1 << 16)]]) >= cosine for lo in range(0, len(i), 1 << 16))])
    if same:
        ok &= i != j
    return i[ok], j[ok], whole


def links(a: Tree, b: Tree, copies_a: np.ndarray, copies_b: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row of a, links of each row of b, i, j): copies that each row links with, and pairs that span the linked groups."""
    i, j, whole = dual(a, b, cosine, same)
    na, nb = (np.bincount(x, c, n).astype(np.int64) for x, c, n in ((i, copies_b[j], len(a.x)), (j, copies_a[i], len(b.x))))
    more_i, more_j = [i], [j]
    for level, p, q in whole:
        left, right = np.flatnonzero(a.below[level] == a.nodes[level][p]), np.flatnonzero(b.below[level] == b.nodes[level][q])
        na[left] += copies_b[right].sum()
        if same and p == q:
            na[left] -= copies_a[left]
        else:
            nb[right] += copies_a[left].sum()
        more_i += [left, np.full(len(right), left[0])]
        more_j += [np.full(len(left), right[0]), right]
    return na, nb, np.concatenate(more_i), np.concatenate(more_j)


def near_vectors(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept, for links of cosine >= `cosine` in double precision.

    Vectors that are null, empty, zero or have null or non-finite components, and rows without an id, link with nothing
    (component_id is their id). Equal vectors link (one class from the start, so copies are never paired). Vectors of
    different lengths never link. Repeated ids are vectors of their own. Other columns are left out, whatever their names; an empty table gives no rows.
    """
    rows = with_node(vectors.select("vec_id", "embedding")).withColumn("dim", F.size("embedding"))
    rows = cut(rows)
    classes = cut(rows.groupBy("node", "dim").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("embedding").alias("embedding")))
    total = classes.count()
    parts = []
    for (dim,) in classes.select("dim").distinct().orderBy("dim").collect():
        parts.append(_compare(classes.where(F.col("dim") == dim), max(1, total // block), cosine, block))
    if not parts:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = parts[0]
    for p in parts[1:]:
        linked = linked.unionByName(p)
    linked = cut(linked)
    count = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(linked.select("node", "root"), "node", "root")
    least = joined.join(classes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    named = joined.join(least, "component").select("node", "least").join(count, "node", "left")
    info = classes.select("node", "copies", "first").join(named, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    out = rows.select("vec_id", "node").join(info, "node").select("vec_id", "n_links", "component_id")
    none = vectors.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _compare(classes: DataFrame, want: int, cosine: float, block: int) -> DataFrame:
    """(node, root, links) of classes of one length: counts and spanning edges from every pair of blocks."""
    pivots = classes.orderBy(F.xxhash64("node"), "node").limit(min(PIVOTS, want)).select("embedding").toPandas()
    around = matrix(pivots.embedding).astype(np.float32)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                g = matrix(pdf.embedding).astype(np.float32) @ around.T
                best = g.argmax(1)
                yield pdf.assign(cell=best.astype(np.int32), away=np.sqrt(np.maximum(0, 2 - 2 * g[np.arange(len(g)), best])).astype(float))

    kind = dict(classes.dtypes)["embedding"]
    dealt = cut(classes.select("node", "copies", "embedding").mapInPandas(assign, f"node binary, copies long, embedding {kind}, cell int, away double"))
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # PIVOTS rows at most
    blocks = {c.cell: max(1, round(c.n / block)) for c in cells}
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    apart = np.sqrt(np.maximum(0, 2 - 2 * (around @ around.T)))
    radius = {c.cell: c.radius for c in cells}
    # cells further apart than both radii and the threshold have no link
    pairs = [(s, t) for s in blocks for t in blocks if apart[s, t] <= radius[s] + radius[t] + limit + 1e-3]
    spark = classes.sparkSession
    count = spark.createDataFrame(list(blocks.items()), "cell int, blocks int")
    dealt = dealt.join(F.broadcast(count), "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        centre = _levels(matrix(pdf.embedding))
        return pdf[["node", "copies", "embedding", "cell", "block"]].assign(**{f"c{k}": c.astype(np.int32) for k, c in enumerate(centre)}, row=np.arange(len(pdf), dtype=np.int32))

    at = "".join(f", c{k} int" for k in range(DEPTH))
    trees = cut(dealt.groupBy("cell", "block").applyInPandas(grow, f"node binary, copies long, embedding {kind}, cell int, block int{at}, row int"))
    to = spark.createDataFrame([(s, t, blocks[t]) for s, t in pairs], "cell int, other int, others int")  # PIVOTS squared at most
    sent = trees.join(F.broadcast(to), "cell").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    mine, its = F.struct("cell", "block"), F.struct(F.col("other").alias("cell"), F.col("o").alias("block"))
    sent = sent.withColumn("p", F.least(mine, its)).withColumn("q", F.greatest(mine, its))
    sent = sent.select(F.col("p.cell").alias("pc"), F.col("p.block").alias("pb"), F.col("q.cell").alias("qc"), F.col("q.block").alias("qb"), "cell", "block", "node", "copies", "embedding", "row", *(f"c{k}" for k in range(DEPTH)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        pc, pb, qc, qb = pdf.iloc[0][["pc", "pb", "qc", "qb"]]
        same = (pc, pb) == (qc, qb)
        sides = [pdf[(pdf.cell == pc) & (pdf.block == pb)]] + ([] if same else [pdf[(pdf.cell == qc) & (pdf.block == qb)]])
        if not all(map(len, sides)):
            return pd.DataFrame({"node": [], "root": [], "links": []})
        t = [Tree(matrix(s.embedding), np.stack([s[f"c{k}"].to_numpy(np.int64) for k in range(DEPTH)])) for s in sides]
        copies = [s.copies.to_numpy() for s in sides]
        na, nb, i, j = links(t[0], t[-1], copies[0], copies[-1], cosine, same)
        n = len(sides[0])
        nodes = pd.concat([s.node for s in sides], ignore_index=True)
        total = na + nb if same else np.concatenate([na, nb])
        root = np.array(_forest(len(nodes), i, j if same else j + n))
        keep = np.flatnonzero(total > 0)
        return pd.DataFrame({"node": nodes.to_numpy()[keep], "root": nodes.to_numpy()[root[keep]], "links": total[keep].astype(np.int64)})

    return sent.groupBy("pc", "pb", "qc", "qb").applyInPandas(compare, "node binary, root binary, links long")
