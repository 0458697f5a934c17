"""Ranks of rows in a seeded random order, within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import scratch

#: Rows that share the leading bits of their hash, and so a task, on average.
ROWS = 1024


def seeded_ranks(rows: DataFrame, key: list[str], seed: int, out: str, by: str | None = None) -> DataFrame:
    """``rows`` with ``out``: their place from 0 in a random order of their own, within ``by`` if given.

    The order is that of a hash of ``key`` (and of all columns where keys are equal). Rows fall into
    buckets by the leading bits of the hash; a bucket's rows are numbered where they are, after the rows of the
    buckets before it. So no group is ever in one task. ``rows`` should be stored: it is read twice.
    """
    bits = max(0, (rows.count() // ROWS).bit_length())
    mixed = rows.withColumn("_h", F.xxhash64(F.lit(seed), *key))
    mixed = mixed.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    group = [F.col(by)] if by else []
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    counts = mixed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", *rows.columns))
    keys = [counts["_b"] == F.col("m._b"), *([counts[by].eqNullSafe(F.col(f"m.{by}"))] if by else [])]
    numbered = mixed.withColumn("_place", place - 1).alias("m").join(counts, keys)
    return numbered.select(*(F.col(f"m.{c}") for c in rows.columns), (F.col("_before") + F.col("_place")).alias(out))


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
