"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder, by Spark's own reader (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: Column) -> Column:
    """A text with null as the empty string."""
    return F.coalesce(col, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: the session's `spark.checkpoint.dir`; only where that is unset
    (tests, one machine) a folder of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it from there; its files go when it is no longer used."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the files of shuffles and checkpoints removed that no frame refers to any more: Spark does so only when the driver
    collects its garbage, which may be much later than the next stage needs the disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@cache
def _libc() -> ctypes.CDLL | None:
    """The C library, told to map large arrays apart, so that they go back to the system as they are freed."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        return libc if hasattr(libc, "malloc_trim") else None
    except (OSError, AttributeError):  # another C library
        return None


def trim() -> None:
    """Give memory that this Python worker has freed back to the system; workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        trim()


def batch_count(df: DataFrame, text: str, batch_bytes: int) -> int:
    """Batches needed for about `batch_bytes` of text each (one scan that keeps two sums)."""
    size, rows = df.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    return max(1, math.ceil(((size or 0) + 64 * rows) / batch_bytes))


_libc()
