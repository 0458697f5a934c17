"""Streaming counterparts of the stateful parts: usage counts, first sights within a time to live, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table (a folder or a single file) as a stream; the zoneless time becomes an instant, which watermarks need."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def usage_by_window(events: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Hits per user and window, with a watermark for late events."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every), "user_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), "user_id", "hits", "value")


def first_within(events: DataFrame, key: list[str], ttl: str = "300 seconds") -> DataFrame:
    """The first event of a key within the time to live; repeats are cache hits."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(key)


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run on what is there now and give the result as a table, stored beside the checkpoint under ``name``.

    Each micro-batch overwrites a folder of its own, so one that is repeated leaves the same rows; in complete mode
    the last batch is the result, else all are.
    """
    spark, path = stream.sparkSession, f"{checkpoint.rstrip('/')}-{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], stream.schema)
    found = spark.read.schema(stream.schema.add("batch", "long")).parquet(path)
    if mode == "complete":
        last = found.agg(F.max("batch")).first()[0]
        found = found.where(F.col("batch") == (-1 if last is None else last))
    return found.drop("batch")
