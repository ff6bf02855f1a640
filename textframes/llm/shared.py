"""What several operators of this folder need: tables, shared folders, batches, word splitting."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Upper-case ASCII bytes to lower case; other bytes stay.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows of ids that are broadcast at most, once counted; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes that are broadcast at most, once summed.
BROADCAST_BYTES = 32 << 20
#: Bytes that Spark hands Python at a time in the stages of an operator that are written, and the setting for that.
BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows that Python handles together; bounds a worker's memory.
BLOCK_ROWS = 512
#: Characters that Python handles together; a longer text stands alone.
BLOCK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, only a local session gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/textframes-shared"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it holds, Spark hands Python BATCH_BYTES at a time, so that long rows don't add up in a worker."""
    before = spark.conf.get(BATCH_CONF)
    size = before.rstrip("b")
    spark.conf.set(BATCH_CONF, str(min(int(size), BATCH_BYTES) if size.isdigit() else BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame | None) -> None:
    """Removes what saved() wrote for tables that nothing reads any more."""
    for df in tables:
        if df is not None:
            for path in df.inputFiles()[:1]:
                jvm = df.sparkSession._jvm
                folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
                folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its counted rows and bytes are few; else left to a shuffle."""
    size = F.lit(8 * len(df.columns)).cast("bigint")
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith("array<"):  # of numbers
            size = size + 8 * F.coalesce(F.size(c), F.lit(0))
    rows, total = df.agg(F.count("*"), F.sum(size)).head()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES else df


def fold(doc_id: str, k: int) -> F.Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % k


def lowest(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """About the n rows of each value of `by` with the lowest hash of `key`, n at most: a bounded sample.

    Rows are counted first; then only the share of the hash space that should hold twice as many
    as wanted is looked at, so that no task sees more of a value, however frequent it is.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("_rows"))
    hashed = rows.withColumn("_h", F.xxhash64(key)).join(small(counts), by)
    place = F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53))
    few = hashed.where(place * F.col("_rows") < 2.0 * n + 64)
    order = Window.partitionBy(by).orderBy(F.shiftrightunsigned("_h", 11), key)
    return few.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_h", "_rows", "_k")


#: Bits of a filter at most: 32 MB to broadcast. A fuller filter lets more through, and loses nothing.
FILTER_BITS = 28


class BitFilter:
    """A set of 64-bit hashes by their first bits: holds all that were put in, and some others."""

    def __init__(self, found: DataFrame, prefix: str, width: int) -> None:
        """found: rows of `prefix`, the first `width` bits of hashes as a long. 2^FILTER_BITS / 64 words are gathered at most."""
        self.bits = max(16, min(FILTER_BITS, width, (16 * found.count()).bit_length()))
        bit = F.shiftrightunsigned(prefix, width - self.bits)
        words = found.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({prefix}, {width - self.bits}) % 64 as int))")).alias("set"))
        got = words.toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.int64)
        self.words[got.column("word").to_numpy()] = got.column("set").to_numpy()
        self.words = self.words.view(np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> np.uint64(64 - self.bits)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def slices(batch: pa.RecordBatch, column: str, rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, bounded in rows and characters of a column. Memory that Arrow no longer uses goes back after each batch."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < batch.num_rows:
        total = np.cumsum(lengths[start : start + rows])
        n = max(1, int(np.searchsorted(total, BLOCK_CHARS, "right")))
        yield batch.slice(start, n)
        start += n
    pa.default_memory_pool().release_unused()


def blocks(batch: pa.RecordBatch, column: str, rows: int = BLOCK_ROWS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty)."""
    for part in slices(batch, column, rows):
        yield part, [t or "" for t in part.column(column).to_pylist()]


#: The multipliers of a public 64-bit finaliser.
MIX_FACTORS = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over unsigned integers."""
    x = x.copy()
    for factor in (*MIX_FACTORS, None):
        x ^= x >> np.uint64(33)
        if factor is not None:
            x *= factor
    return x
