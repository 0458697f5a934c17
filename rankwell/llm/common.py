"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The only letters the contracts lower-case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Groups with over 1/HOT_PARTS of the rows number fewer than HOT_PARTS.
HOT_PARTS = 1000
#: Bytes of an Arrow batch in the tables that operators write.
ARROW_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a local
    session (as in tests) makes and sets a temporary folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="rankwell-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/rankwell-{uuid.uuid4().hex}/{name}"


@contextmanager
def small_batches(spark: SparkSession, most: int = ARROW_BYTES) -> Iterator[None]:
    """Arrow batches of at most ``most`` bytes (and one row) for what is run inside, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    asked = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if 0 < asked <= most:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation. Both sides
    of an Arrow function hold a batch and copies of it, so batches are kept small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rankwell_path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing will read again."""
    path = getattr(df, "_rankwell_path", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(os.path.dirname(path))
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return this process's free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow, after which its worker returns free memory to the system.

    Workers outlive their tasks, and what allocators keep adds up over the stages of a job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    ``lower`` and the A-Z rule agree on pure ASCII, where Spark has a fast path;
    other texts go through ``translate``.
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def id_hash(column: Column) -> Column:
    """crc32 of an id written as text (null as empty text)."""
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8"))


def told_by_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n: int) -> DataFrame:
    """``rows`` with the columns of their group (``groups``: one row per key, all keys present).

    Groups with over 1/HOT_PARTS of the n rows number fewer than HOT_PARTS and are
    broadcast, so the shuffled join deals with small groups only.
    """
    hot = groups.where(F.col(size) * HOT_PARTS > n)
    cold = groups.where(F.col(size) * HOT_PARTS <= n)
    marked = rows.join(F.broadcast(hot), keys, "left")
    others = [c for c in groups.columns if c not in keys]
    return marked.where(F.col(size).isNotNull()).unionByName(marked.where(F.col(size).isNull()).drop(*others).join(cold, keys))


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least n, and at least 1."""
    return 1 << max(0, int(-(-n // 1)) - 1).bit_length() if n > 1 else 1
