"""Exact de-duplication behind a two-pass Bloom filter (native plans only).

Pass one sets two bits per row in a blocked Bloom filter that records which
cells were hit more than once. Pass two probes every row: a row with a cell that
no other row hit cannot be repeated, so it passes straight through. Only the
possibly repeated rows are shuffled and compared by SHA-256.

The filter takes two bytes per row. It is broadcast while that is within
``broadcast_bytes``; beyond it the narrow (id, digest) rows are joined with it
by block instead, and full rows still never move for the probe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, power_of_two, stored, told_by_group

#: bitmap_construct_agg works on blocks of this many bits.
BLOCK_BITS = 32768
BITS_PER_ROW = 16
BROADCAST_BYTES = 64 << 20


def _cells(digest: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The block and the two cells of a row's hash; blocks is a power of two."""
    h = F.xxhash64(digest)
    return (
        F.shiftright(h, 32).bitwiseAND(F.lit(blocks - 1)).cast("int"),
        h.bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int"),
        F.shiftright(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int"),
    )


def _bit(bits: Column, cell: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(cell, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, cell.bitwiseAND(F.lit(7))) == 1


def hit_cells(rows: DataFrame, blocks: int, least: int, digest: str = "digest") -> DataFrame:
    """A Bloom filter: per block a bitmap of the cells hit by ``least`` rows or more."""
    block, one, two = _cells(F.col(digest), blocks)
    cells = rows.select(block.alias("block"), F.explode(F.array(one, two)).alias("cell"))
    # partial sums go first, so a text that a third of the rows hold sends one row a task
    counted = cells.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least)
    return counted.groupBy("block").agg(F.bitmap_construct_agg("cell").alias("bits"))


def probed(rows: DataFrame, filter_: DataFrame, blocks: int, small: bool, digest: str = "digest") -> DataFrame:
    """``rows`` with a boolean ``possible``: may another row have the same digest?"""
    block, one, two = _cells(F.col(digest), blocks)
    marked = rows.withColumn("block", block)
    joined = marked.join(F.broadcast(filter_) if small else filter_.hint("merge"), "block", "left")
    hit = _bit(F.col("bits"), one) & _bit(F.col("bits"), two)
    return joined.withColumn("possible", F.coalesce(hit, F.lit(False))).drop("block", "bits")


def _groups(possible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows per (digest, id) with their number, and per digest the row that stays."""
    each = possible.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("copies"))
    return each, each.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One decision row per input row: id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest id stays (null ids are smallest; if
    all ids are null keep_id is null). Of rows equal in id and text exactly one
    is kept. An empty table gives no rows. Other columns are ignored.
    """
    rows = stored(docs.select(F.col(id_col).alias("id"), F.sha2(lower_ascii(F.col(text_col)), 256).alias("digest")), "digests")
    n = rows.count()
    blocks = power_of_two(n * BITS_PER_ROW / BLOCK_BITS)
    seen = probed(rows, hit_cells(rows, blocks, 2), blocks, blocks * BLOCK_BITS // 8 <= broadcast_bytes)
    alone = seen.where("NOT possible").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    each, groups = _groups(seen.where("possible"))
    each, groups = stored(each, "possible"), stored(groups, "groups")
    told = each.transform(told_by_group, groups, ["digest"], "group_size", n).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return alone.unionByName(told.select("id", "keep_id", "group_size", kept.alias("kept"), "digest"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see :func:`exact_duplicates`).

    Rows whose digest the filter shows to be unique are not shuffled.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(lower_ascii(F.col(text_col)), 256).alias("digest"))
    thin = stored(rows.select("id", "digest"), "digests")
    n = thin.count()
    blocks = power_of_two(n * BITS_PER_ROW / BLOCK_BITS)
    small = blocks * BLOCK_BITS // 8 <= broadcast_bytes
    cells = stored(hit_cells(thin, blocks, 2), "cells")
    _, groups = _groups(probed(thin, cells, blocks, small).where("possible"))
    keep = stored(groups.select("digest", F.col("keep_id").alias("id")), "keep")
    seen = probed(rows, cells, blocks, small)
    at = seen["digest"].eqNullSafe(keep["digest"]) & seen["id"].eqNullSafe(keep["id"])
    again = seen.where("possible").join(keep, at, "left_semi").dropDuplicates(["digest", "id"])
    return seen.where("NOT possible").select("row.*").unionByName(again.select("row.*"))
