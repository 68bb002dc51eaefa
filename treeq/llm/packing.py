"""Best-fit packing of documents into bins of a fixed number of words, under conflicts.

No bin holds two pieces of one source, nor two of one cluster of duplicates. A document longer than a bin fills whole
bins with its first pieces; the rest of it is packed. Rests are dealt to shards of bounded size by a hash (so copies and
hot sources spread evenly) and each shard packs on its own, largest first: bins are ordered by the room they have left,
each carries a bitmap of its sources and clusters, and the search goes from the tightest bin that is large enough to the
next until one is compatible.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, repeated
from .mixing import n_words

#: Pieces of one shard, about.
SHARD_ROWS = 4096


class Bins:
    """Open bins by room left. A segment tree over the room holds the AND of the bitmaps below each node: where a
    document shares a bit with that, every bin below conflicts and the search skips them all at once. In the tree bitmaps
    are shifted by one: bit 0 is set where there is no bin at all, so a document without any bit skips only those."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [-1] * (2 * self.leaves)
        self.at: list[dict[int, int]] = [{} for _ in range(self.leaves)]  # by room: bin -> bitmap

    def _up(self, room: int) -> None:
        both = -1
        for m in self.at[room].values():
            both &= m << 1
        i = room + self.leaves
        self.tree[i] = both
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] & self.tree[2 * i + 1]

    def put(self, room: int, bin_: int, mask: int) -> None:
        self.at[room][bin_] = mask
        self._up(room)

    def take(self, size: int, mask: int) -> tuple[int, int, int] | None:
        """Removes and returns (room, bin, bitmap) of the tightest compatible bin with room for size."""
        stack, skip = [(1, 0, self.leaves)], mask << 1 | 1
        while stack:
            i, lo, n = stack.pop()
            if lo + n <= size or self.tree[i] & skip:
                continue
            if n > 1:
                h = n // 2
                stack += [(2 * i + 1, lo + h, h), (2 * i, lo, h)]
                continue
            for b, m in self.at[lo].items():
                if not m & mask:
                    del self.at[lo][b]
                    self._up(lo)
                    return lo, b, m
        return None


def best_fit(sizes: list[int], masks: list[int], capacity: int) -> list[int]:
    """The bin of each piece; pieces come in the order in which they are to be placed, and no size is over capacity."""
    bins, count, out = Bins(capacity), 0, []
    for size, mask in zip(sizes, masks, strict=True):
        room, b, has = bins.take(size, mask) or (capacity, count, 0)
        count += b == count
        bins.put(room - size, b, has | mask)
        out.append(b)
    return out


def _masks(*columns: pd.Series) -> list[int]:
    """A bit for each value that occurs twice at least, columns side by side; a row without any conflicts with none."""
    out, bit = [0] * len(columns[0]), 1
    for c in columns:
        codes, _ = pd.factorize(c, use_na_sentinel=False)
        often = pd.Series(codes).map(pd.Series(codes).value_counts()).to_numpy() > 1
        place: dict[int, int] = {}
        for i, (code, o) in enumerate(zip(codes, often, strict=True)):
            if o:
                out[i] |= 1 << place.setdefault(code, bit + len(place))
        bit += len(place)
    return out


def pack(docs: DataFrame, capacity: int = 1024, cluster: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per piece: doc_id, source, cluster, piece, first_word, n_words, bin, bin_words.

    cluster names a column of docs that tells duplicates; without one, texts that are equal but for case and blanks
    form a cluster. Words are runs of characters other than blank and tab to carriage return. A text that is null or has no
    word has one row, without a bin; a text of any length becomes pieces of whole bins and a rest. Ids may be numbers or strings. A null
    id, source or cluster is a value like others. Rows that are repeated are packed each on its own; no row is dropped. Pieces of
    one size are placed in order of the id's text, cluster, source and copy. Other columns are left out, whatever their names; an empty table gives no rows.
    """
    plain = F.lower(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    same = F.col(cluster).cast("string") if cluster else F.md5(plain.cast("binary"))
    rows = docs.select("doc_id", "source", same.alias("cluster"), n_words().alias("size"))
    rows = cut(rows.groupBy("doc_id", "source", "cluster", "size").agg(F.count("*").alias("copies")))
    whole = F.floor(F.col("size") / capacity).cast("long")
    one = repeated(rows, "copies", "copy").select("*", whole.alias("whole"), (F.col("size") - whole * capacity).alias("rest"))
    total = rows.where((F.col("size") % capacity) > 0).agg(F.sum("copies")).first()[0] or 0
    shards = max(1, -(-total // shard_rows))
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "copy", "source", "size"), F.lit(shards))
    rest = one.where("rest > 0").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "cluster", F.col("whole").alias("piece"), "copy", F.col("rest").alias("n_words"), shard.alias("shard"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = ["n_words", "doc_id", "cluster", "source", "copy"]
        pdf = pdf.sort_values(order, ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        pdf["k"] = best_fit(pdf.n_words.tolist(), _masks(pdf.source, pdf.cluster), capacity)
        pdf["bin_words"] = pdf.groupby("k").n_words.transform("sum")
        pdf["bin"] = "s" + pdf["shard"].astype(str) + "-" + pdf.k.astype(str)
        return pdf[fields]

    fields = ["doc_id", "source", "cluster", "piece", "n_words", "bin", "bin_words"]
    kinds = f"doc_id string, source {types['source']}, cluster string, piece long, n_words long, bin string, bin_words long"
    packed = rest.groupBy("shard").applyInPandas(run, kinds).withColumn("doc_id", F.col("doc_id").cast(types["doc_id"]))
    full = one.where("whole > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    name = F.concat_ws("-", F.lit("f"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("source", "cluster", "size"), "copy", "piece")
    full = full.select("doc_id", "source", "cluster", "piece", F.lit(capacity).cast("long").alias("n_words"), name.alias("bin"), F.lit(capacity).cast("long").alias("bin_words"))
    zero = F.lit(0).cast("long")
    none = one.where("size = 0").select("doc_id", "source", "cluster", zero.alias("piece"), zero.alias("n_words"), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("bin_words"))
    out = full.unionByName(packed.select(*fields)).unionByName(none)
    return out.withColumn("first_word", F.col("piece") * capacity)
