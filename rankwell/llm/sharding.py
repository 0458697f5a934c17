"""Proportional stratified interleaving into shards (native plans only).

Rows of each source are shuffled by a seeded hash and ranked; the fractional rank
(rank + u) / (rows of the source) orders all rows, and cutting that order into
equal runs gives shards that hold every source in proportion. u, a hash of the source
in [0, 1), spreads the sources, so that very many small ones don't lie in one place.

Both rankings are distributed: rows fall into buckets of the sort key holding a few
hundred rows each, per-bucket counts are prefix-summed, and row_number works inside
a bucket. So a source with a third of the rows never meets in one task, and neither do
all the sources of one row. Only rows equal in id and text share a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import power_of_two, stored

ROWS_PER_BUCKET = 256
#: Steps of a source's offset within its first fractional rank.
SPREAD = 1 << 30
#: Buckets that are summed together first; a global sum then runs over these sums.
SPAN = 1024


def _offsets(counts: DataFrame, bucket: str, by: list[str]) -> DataFrame:
    """Rows before each bucket (``before``) within ``by``, from its ``rows``; two levels."""
    spans = counts.withColumn("span", F.col(bucket).bitwiseAND(F.lit(~(SPAN - 1))))
    within = Window.partitionBy(*by, "span").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = spans.groupBy(*by, "span").agg(F.sum("rows").alias("span_rows"))
    over = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("span_before", F.coalesce(F.sum("span_rows").over(over), F.lit(0)))
    inner = spans.withColumn("inner_before", F.coalesce(F.sum("rows").over(within), F.lit(0)))
    joined = inner.join(sums, [*by, "span"])
    return joined.select(*by, bucket, (F.col("span_before") + F.col("inner_before")).alias("before"))


def interleaved(docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows id, source, size, text_crc32, shard, slot; law: counts at most one apart.

    size is the UTF-8 bytes of the text (null: none) plus 1; a null text has the
    checksum of the empty text. A null source is a source of its own. Rows that are
    equal in id and text are interchangeable. An empty table gives no rows; other
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
    ).withColumn("stratum", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))))
    rows = stored(rows.withColumn("shuffled", F.xxhash64(F.lit(seed), "id", "text_crc32")), "rows")
    n = rows.count()
    bits = power_of_two(n / ROWS_PER_BUCKET).bit_length() - 1
    bucket = F.shiftrightunsigned("shuffled", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("bucket", bucket)

    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.groupBy("stratum").agg(F.sum("rows").alias("of"))
    place = Window.partitionBy("stratum", "bucket").orderBy("shuffled", "id", "text_crc32", "size")
    ranked = rows.withColumn("nth", F.row_number().over(place) - 1)
    ranked = ranked.join(_offsets(counts, "bucket", ["stratum"]), ["stratum", "bucket"]).join(totals, "stratum")
    offset = F.xxhash64(F.lit(seed), "stratum").bitwiseAND(F.lit(SPREAD - 1)).cast("double") / SPREAD
    fraction = (F.col("before") + F.col("nth") + offset) / F.col("of")
    ranked = ranked.select("id", "source", "size", "text_crc32", "stratum", "shuffled", fraction.alias("fraction"))
    ranked = stored(ranked.withColumn("bucket", F.floor(F.col("fraction") * (1 << bits)).cast("long")), "ranked")

    counts = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    place = Window.partitionBy("bucket").orderBy("fraction", "stratum", "shuffled", "id", "text_crc32", "size")
    placed = ranked.withColumn("nth", F.row_number().over(place) - 1).join(_offsets(counts, "bucket", []), "bucket")
    position = (F.col("before") + F.col("nth")).alias("position")
    placed = placed.select("id", "source", "size", "text_crc32", position).withColumn("shard", F.expr(f"CAST(position * {shards} DIV {max(n, 1)} AS INT)"))
    first = F.expr(f"(shard * CAST({n} AS BIGINT) + {shards - 1}) DIV {shards}")
    return placed.withColumn("slot", F.col("position") - first)
