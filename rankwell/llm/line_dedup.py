"""Lines that many documents share are kept where they come first.

Lines become hashes with their document and place; text does not move. The hashes are
range-partitioned with document and place as further keys, so that one line in a third
of all documents is spread over many sorted runs. Each run is read as a stream that
remembers one document, the first of the current hash. Only the first hash of a run can
have begun before it; those rows wait for the least of one row per run and end. What
comes back is a compressed bitmap of kept lines per document that loses any.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, power_of_two, stored
from .exact_dedup import BITS_PER_ROW, BLOCK_BITS, BROADCAST_BYTES, hit_cells, probed
from .ordering import changes

#: Characters that a line's key loses at both ends: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
#: Code points that a key needs.
LEAST = 10


def line_key(line: Column) -> Column:
    """What makes lines equal: without space at both ends, A-Z in lower case."""
    return lower_ascii(F.trim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    """The lines of a text as an array; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def packed(keep: np.ndarray) -> bytes:
    """A bitmap of kept lines: a zero byte and the bits, or the deflated bits if that is shorter (a one byte first)."""
    raw = np.packbits(keep).tobytes()
    small = zlib.compress(raw, 6, -15)
    return b"\x01" + small if len(small) < len(raw) else b"\x00" + raw


def unpacked(bitmap: bytes, n: int) -> np.ndarray:
    """The ``n`` booleans of a bitmap."""
    raw = zlib.decompress(bitmap[1:], -15) if bitmap[0] else bitmap[1:]
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows h1, h2, id, copy, place, lines in that order: the rows to drop, and what the run's ends leave open.

    kind 0: a row to drop. kind 1: a row of the run's first hash. kind 2: the first id of the
    run's first and last hash.
    """
    names = ["h1", "h2", "id", "copy", "place", "lines"]
    last = first_id = end = None
    opening = True

    def told(rows: pa.RecordBatch, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(rows), kind, np.int8))], [*names, "kind"])

    for batch in batches:
        if not batch.num_rows:
            continue
        hashes, ids = batch.columns[:2], batch.column(2)
        new = changes(hashes, last)
        if last is None:
            yield told(batch.slice(0, 1), 2)
        begun = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        # the first id of each row's hash: one of this batch, or what is carried over
        pool = ids if first_id is None else pa.concat_arrays([first_id, ids])
        firsts = pool.take(pa.array(begun if first_id is None else begun + 1))
        same = pc.or_(pc.fill_null(pc.equal(ids, firsts), False), pc.and_(pc.is_null(ids), pc.is_null(firsts)))
        repeated = ~same.to_numpy(zero_copy_only=False)
        later = np.cumsum(new) > (1 if last is None else 0)
        edge = np.logical_and(opening, ~later)
        opening = bool(edge[-1])
        if edge.any():
            yield told(batch.filter(pa.array(edge)), 1)
        if (gone := repeated & ~edge).any():
            yield told(batch.filter(pa.array(gone)), 0)
        if begun[-1] >= 0:
            end = batch.slice(int(begun[-1]), 1)
        first_id = firsts.slice(len(firsts) - 1)
        last = [h.slice(len(h) - 1) for h in hashes]
    if end is not None and not opening:
        yield told(end, 2)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, copy, lines, place of every line that goes: its key is in a smaller id. ``copy`` is a hash of the text."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("copy"), lines_of(F.col(text_col)).alias("_lines"))
    rows = rows.withColumn("lines", F.size("_lines"))  # before the lines are spread, so that no row carries them all
    rows = rows.select("id", "copy", "lines", F.posexplode("_lines").alias("place", "_line")).withColumn("_key", line_key(F.col("_line")))
    rows = rows.where(F.length("_key") >= LEAST)
    rows = rows.select(F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit("line"), "_key").alias("h2"), "id", "copy", "place", "lines")
    rows = stored(rows, "lines")
    sorted_ = rows.repartitionByRange("h1", "h2", "id", "place").sortWithinPartitions("h1", "h2", "id", "place")
    seen = stored(sorted_.mapInArrow(_first_seen, T.StructType([*rows.schema.fields, T.StructField("kind", T.ByteType())])), "seen")
    # two rows per run at most: a proven bound for the broadcast. A struct's least counts nulls as smallest
    firsts = seen.where("kind = 2").groupBy("h1", "h2").agg(F.min(F.struct("id")).alias("first"))
    late = seen.where("kind = 1").join(F.broadcast(firsts), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first.id")))
    kept = ["id", "copy", "lines", "place"]
    return seen.where("kind = 0").select(*kept).unionByName(late.select(*kept))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, n = [], []
        for lines, places in zip(batch.column("lines").to_pylist(), batch.column("places"), strict=True):
            keep = np.ones(lines, bool)
            keep[places.values.to_numpy(zero_copy_only=False)] = False
            out.append(packed(keep))
            n.append(lines - int(keep.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copy"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["id", "copy", "dropped", "bitmap"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, copy, dropped, bitmap: for each document that loses lines, which it keeps (see ``unpacked``).

    A line goes if its key has at least ten code points and is also in a document of a smaller
    id; the smallest keeps all its lines with it. A null id is the smallest. Rows of equal id are
    one document for this purpose, but each text has a bitmap of its own (``copy``). An empty
    table has none; null and empty texts lose nothing.
    """
    rows = repeated_lines(docs, id_col, text_col)
    places = rows.groupBy("id", "copy").agg(F.max("lines").alias("lines"), F.collect_set("place").alias("places"))
    schema = T.StructType([rows.schema["id"], rows.schema["copy"], T.StructField("dropped", T.LongType()), T.StructField("bitmap", T.BinaryType())])
    return places.mapInArrow(_bitmaps, schema)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, text, bitmap = batch.columns
        texts, n, dropped = [], [], []
        for t, b in zip(text.to_pylist(), bitmap.to_pylist(), strict=True):
            lines = (t or "").split("\n")
            kept = lines if b is None else [x for x, keep in zip(lines, unpacked(b, len(lines)).tolist(), strict=True) if keep]
            texts.append("\n".join(kept))
            n.append(len(lines))
            dropped.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays([row, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], ["row", "lines", "dropped", "kept_text"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """row (the columns ``carry``, or all), lines, dropped, kept_text for every row of ``docs``.

    A Bloom filter over the bitmaps' documents lets those that keep everything pass without a
    shuffle of their texts; the others are joined with their bitmaps. A text without any line
    left is empty. See :func:`keep_bitmaps` for nulls and repeated ids.
    """
    bitmaps = stored(keep_bitmaps(docs, id_col, text_col).withColumn("_at", F.xxhash64("id", "copy")), "bitmaps")
    blocks = power_of_two(bitmaps.count() * BITS_PER_ROW / BLOCK_BITS)
    cells = stored(hit_cells(bitmaps, blocks, 1, "_at"), "cells")
    copy = F.xxhash64(F.col(text_col))
    rows = docs.select(F.struct(*(carry or ["*"])).alias("row"), F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), copy.alias("_copy"))
    rows = probed(rows.withColumn("_at", F.xxhash64("_id", "_copy")), cells, blocks, blocks * BLOCK_BITS // 8 <= broadcast_bytes, "_at")
    lines = F.size(lines_of(F.col("_text"))).cast("long")
    whole = rows.where("NOT possible").select("row", lines.alias("lines"), F.lit(0).cast("long").alias("dropped"), F.coalesce("_text", F.lit("")).alias("kept_text"))
    at = rows["_id"].eqNullSafe(bitmaps["id"]) & (rows["_copy"] == bitmaps["copy"])
    met = rows.where("possible").join(bitmaps.select("id", "copy", "bitmap"), at, "left").select("row", "_text", "bitmap")
    return whole.unionByName(met.mapInArrow(_applied, whole.schema))
