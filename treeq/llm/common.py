"""Helpers shared by the training-data operators: stable storage, byte-level text views, hashing."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20
BATCH_ROWS = 1000
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local session gets a folder of its own
    (all of it is one machine); on a cluster that could not work, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="treeq-")
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Where the tables of `cut` are, by the identity of their DataFrame.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, per_file: int = 0) -> DataFrame:
    """The same rows, read from Parquet files in the shared folder: short lineage, and safe from lost executors.

    The files stay for as long as results may be computed from them; `drop` removes those that were only a step. A reader holds some thousand rows
    of a file at once: of rows of MBs a file has at most `per_file`.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/treeq-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", per_file).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def cut_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As `cut`, but in buckets of a key: what groups or joins by the key over as many partitions needs no exchange."""
    spark, name = df.sparkSession, f"treeq_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: a table with a path of its own keeps its files
    _PATHS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that `cut` wrote and that nothing will read again."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def free(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """df with the rank of each row, from 1, in this order: one range sort, then an offset per partition. Equal rows are in any order."""
    part, row = free(df, "part"), free(df, "row")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    here = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = cut(rows.withColumn(part, F.spark_partition_id()).withColumn(row, here))
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"))  # a row per partition
    out = rows.join(F.broadcast(before.withColumnRenamed("n", name)), part)
    return out.withColumn(name, F.col(name) + F.col(row) + 1).drop(part, row)


def repeated(df: DataFrame, copies: str, name: str, step: int = 1024) -> DataFrame:
    """Each row as often as its column `copies` says, numbered from 1 in a new column.

    Rows of more than `step` copies first become rows of at most so many, which are dealt anew, so counts may be of any size.
    """
    few = df.where(F.col(copies) <= step).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    many = df.where(F.col(copies) > step)
    many = many.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / step).cast("long"))))
    many = many.repartition(name, *df.columns)
    first = F.col(name) * step
    return few.unionByName(many.withColumn(name, F.explode(F.sequence(first + 1, F.least(F.col(copies), first + step)))))


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts go to Python at most BATCH_ROWS at a time: the default of 10000 can be hundreds of MB on either side.

    This is a setting of the session, read when a plan runs, so it stays as it is set here."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def with_fields(schema: T.StructType, **more: str) -> T.StructType:
    """The schema with fields of these names and types at its end."""
    out = T.StructType(list(schema.fields))
    for name, kind in more.items():
        out.add(name, kind)
    return out


def crc_mod(id_col: str, m: int):
    """crc32 of the id's text, modulo m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def excerpt(text: Column, chars: int, pieces: int = 16) -> Column:
    """A text of up to `chars` characters; of a longer one, equal pieces that begin at equal distances, the last at its end."""
    size = chars // pieces
    start = lambda i: F.floor(i * (F.length(text) - size) / (pieces - 1)).cast("int") + 1
    parts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, start(i), F.lit(size)))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(parts, " "))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads the bits of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse modulo 2**64, n of each at least."""
    if len(_POW[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for i, base in enumerate((_P, _PINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[i] = np.cumprod(x, dtype=np.uint64)
    return _POW[0], _POW[1]


def text_steps(texts: pa.Array, lower: bool = False, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the runs of bytes that are not separators (blank, tab to carriage return)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~(_SPACE if sep is None else sep)[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts])


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k values that begin at each place (len - k + 1 of them), whatever documents they span."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return mix64((total[k:] - total[:-k]) * inverse[:n])


def digest(x: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()
