"""Result files and logs, and the folder for intermediate ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("json", "csv", "parquet", "orc")
#: Bytes of an Arrow batch in what runs under ``small_batches``.
ARROW_BYTES = 4 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names the folder. Only a local session may leave it unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rankwell-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, most: int = ARROW_BYTES) -> Iterator[None]:
    """Arrow batches of at most ``most`` bytes (or one row) for what is run inside, unless the session asks for less.

    Both sides of an Arrow function hold a batch and copies of it.
    """
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


def write_rows(df: DataFrame, path: str, kind: str = "json", mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` with one task per partition and return what can be read back, in the same schema."""
    if kind not in FORMATS:
        raise ValueError(f"{kind!r} is none of {', '.join(FORMATS)}")
    options = {"header": "true"} if kind == "csv" else {}
    df.write.format(kind).options(**options).mode(mode).save(path)
    return df.sparkSession.read.format(kind).options(**options).schema(df.schema).load(path)


def append_log(df: DataFrame, path: str) -> DataFrame:
    """Append rows to a log of JSON lines and return the whole log."""
    return write_rows(df, path, "json", "append")
