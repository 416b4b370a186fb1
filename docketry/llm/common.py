"""Shared helpers: scratch tables in the cluster's shared folder, Arrow batch slicing, table reading."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.storage import scratch

#: Rows of an Arrow batch sent to Python; texts may be long, so batches stay small.
ARROW_ROWS = 512
#: Bytes of an Arrow batch sent to Python, about.
BATCH_BYTES = 16 << 20
#: Text bytes that one numpy pass works on at most (a longer single text is one pass of its own).
SLICE_BYTES = 1 << 20
#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Bits of a key filter (4 MiB, whatever the table's size) and of one of its rows.
FILTER_BITS, FILTER_ROW_BITS = 1 << 25, 1 << 15


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str, **options) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the tables that ``stored`` wrote for these frames; nothing reads them any more."""
    for df in frames:
        drop_folder(df.sparkSession, df.scratch_path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this library through Spark's file system layer."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of steps that are done; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers where the session leaves the size of Arrow batches open.

    One value for all operators, so that frames that run later run with the value they were made for.
    """
    for key, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))


@contextmanager
def batch_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Rows of an Arrow batch for the actions inside; the session's own value comes back afterwards."""
    values = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _filter_bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)).cast("long")


def key_filter(keys: DataFrame) -> DataFrame:
    """A filter over the one column of ``keys``: (filter_row, filter_bits), at most 1,024 rows of 4 KiB (stored)."""
    bit = _filter_bit(F.col(keys.columns[0]))
    rows = keys.select((bit / FILTER_ROW_BITS).cast("long").alias("filter_row"), (bit % FILTER_ROW_BITS).alias("bit"))
    return stored(rows.groupBy("filter_row").agg(F.bitmap_construct_agg("bit").alias("filter_bits")), "key-filter")


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """``rows`` with ``__maybe``: false only if ``key`` is certainly not among those of the filter ``keys``.

    The filter is broadcast: its size is fixed, so that large rows need not be shuffled to be ruled out.
    """
    small = F.broadcast(keys.select(F.col("filter_row").alias("__filter_row"), F.col("filter_bits").alias("__filter_bits")))
    bit = _filter_bit(key)
    at = bit % FILTER_ROW_BITS
    byte = F.conv(F.hex(F.substring(F.col("__filter_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(small, (bit / FILTER_ROW_BITS).cast("long") == F.col("__filter_row"), "left")
    held = F.col("__filter_row").isNotNull() & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return found.withColumn("__maybe", F.coalesce(held, F.lit(False))).drop("__filter_row", "__filter_bits")


def give_back() -> None:
    """Return freed memory to the system: Python workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array, each with at most ``max_bytes`` of text (or one row)."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(np.asarray(size).tolist()):
        if i > start and total + n > max_bytes:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(column):
        yield start, len(column)


def gathered(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about ``max_bytes``, for passes that do each different word once."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > max_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def word_count(text) -> F.Column:
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")
