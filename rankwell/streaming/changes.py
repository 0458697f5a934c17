"""Changes of a collection from snapshot to snapshot, as a stream with a state per document.

Snapshots are files in a folder. A run takes in what it has not seen (``availableNow`` with a
checkpoint), compares each document with the digest in its state and writes what is new or
updated. The sink overwrites a micro-batch's own folder, so a batch that is repeated after a
failure leaves the same rows, and a run without new snapshots adds none.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.changes import content_digest

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def due(last: datetime.datetime | None, now: datetime.datetime, days: int = 7) -> bool:
    """Is it time for a run: never before, or at least so many whole days ago?"""
    return last is None or (now - last).days >= days


class _Versions(StatefulProcessor):
    """The digest and version of one document."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "digest string, version int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        digest, version = self.known.get() if self.known.exists() else (None, 0)
        out = []
        seen = sorted((n, d) for frame in rows for n, d in zip(frame["snapshot"], frame["digest"], strict=True))
        for snapshot, new in seen:
            if new != digest:
                out.append((key[0], int(snapshot), "updated" if version else "new", version + 1))
                digest, version = new, version + 1
        if out:
            self.known.update((digest, version))
            yield pd.DataFrame(out, columns=["_key", "snapshot", "change", "version"])

    def close(self) -> None:
        pass


@dataclass
class Watch:
    """A folder of snapshots, one of changes and a checkpoint, all shared; the key and the columns that are compared."""

    snapshots: str
    out: str
    checkpoint: str
    key: str
    compared: tuple[str, ...]

    def _known(self, spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def _numbers(self, spark: SparkSession) -> list[int]:
        """Snapshots there are; one folder each."""
        if not self._known(spark, self.snapshots):
            return []
        at = spark._jvm.org.apache.hadoop.fs.Path(self.snapshots)
        names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
        return sorted(int(n.removeprefix("snapshot=")) for n in names if n.startswith("snapshot="))

    def add(self, rows: DataFrame) -> int:
        """Store a snapshot (key and digest of every row whose key is not null; of equal keys one) and give its number, from 1 on."""
        number = max(self._numbers(rows.sparkSession), default=0) + 1
        thin = rows.select(F.col(self.key).alias("_key"), content_digest(rows, list(self.compared)).alias("digest")).where("_key IS NOT NULL")
        thin.groupBy("_key").agg(F.min("digest").alias("digest")).write.mode("overwrite").parquet(f"{self.snapshots}/snapshot={number}")
        return number

    def run(self, spark: SparkSession) -> None:
        """Take in the snapshots that have not been, and write their changes."""
        if not self._numbers(spark):
            return
        schema = spark.read.parquet(self.snapshots).schema
        stream = spark.readStream.schema(schema).parquet(self.snapshots)
        result = T.StructType([T.StructField("_key", schema["_key"].dataType), T.StructField("snapshot", T.IntegerType()), T.StructField("change", T.StringType()), T.StructField("version", T.IntegerType())])
        before = spark.conf.get(_PROVIDER)
        spark.conf.set(_PROVIDER, _ROCKS)  # the only store that keeps states of this kind
        try:
            found = stream.groupBy("_key").transformWithStateInPandas(_Versions(), result, "Append", "None")

            def write(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{self.out}/batch={number}")

            query = found.writeStream.outputMode("append").option("checkpointLocation", self.checkpoint).trigger(availableNow=True).foreachBatch(write).start()
            query.awaitTermination()
        finally:
            spark.conf.set(_PROVIDER, before)

    def changes(self, spark: SparkSession, snapshot: int) -> DataFrame:
        """key, change, version of a snapshot against the one before: new, updated (or back again with another text), or deleted (no version).

        A document that comes back as it was is no change. Deletions are told by comparing the two snapshots' keys; the
        state keeps what is gone.
        """
        name = F.col("_key").alias(self.key)
        stored = spark.read.parquet(self.snapshots)
        a, b = (stored.where(F.col("snapshot") == n).select("_key") for n in (snapshot - 1, snapshot))
        gone = a.join(b, "_key", "left_anti").select(name, F.lit("deleted").alias("change"), F.lit(None).cast("int").alias("version"))
        if not self._known(spark, self.out):
            return gone
        found = spark.read.parquet(self.out).where(F.col("snapshot") == snapshot)
        return found.select(name, "change", "version").unionByName(gone)
