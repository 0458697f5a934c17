"""Slots for the user's models: embedding, judging, moderation, summarising.

A slot is any batch function over texts. It runs as an Arrow-batched Pandas UDF over
distinct texts; a failing batch gives nulls, not a failed job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import kept


def hash_embedding(texts: list[str], size: int = 384) -> list[list[float]]:
    """Deterministic stand-in embedding: normal numbers seeded by the text's SHA-256, unit length."""
    out = []
    for t in texts:
        seed = int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:4], "little")
        v = np.random.RandomState(seed).standard_normal(size)
        out.append((v / np.linalg.norm(v)).tolist())
    return out


def slot(fn: Callable[[list], list], returns: str):
    """A column function that calls ``fn`` on lists of texts, null where it fails."""

    @F.pandas_udf(returns)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            try:
                yield pd.Series(fn(texts.tolist()), dtype=object)
            except Exception:  # the contract of optional slots: degrade, don't fail
                yield pd.Series([None] * len(texts), dtype=object)

    return call.asNondeterministic()


def with_slot(df: DataFrame, text: str, fn: Callable[[list], list], returns: str, out: str) -> DataFrame:
    """``df`` with ``out`` = fn(text), called once per distinct text."""
    once = df.select(text).where(F.col(text).isNotNull()).distinct()
    return df.join(once.withColumn(out, slot(fn, returns)(F.col(text))), text, "left")


@dataclass
class Memo:
    """Answers by the hash of their prompt, in a folder that outlives a run: hash, answer, attempts."""

    path: str
    schema: str = "hash string, answer string, attempts int"

    def table(self, spark: SparkSession) -> DataFrame:
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        rows.select("hash", "answer", "attempts").write.mode("append").parquet(self.path)


def asked(prompts: DataFrame, fn: Callable[[list[str], int], list[str]], attempt: int, batch: int) -> DataFrame:
    """hash, prompt, answer, error: ``fn(prompts, attempt)`` on at most ``batch`` prompts at a time; a failing call fails its batch only."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].copy()
                try:
                    answers, error = list(fn(part["prompt"].tolist(), attempt)), None
                    if len(answers) != len(part):
                        raise ValueError(f"{len(answers)} answers to {len(part)} prompts")
                except Exception as e:  # the contract of optional slots: degrade, don't fail
                    answers, error = [None] * len(part), f"{type(e).__name__}: {e}"[:200]
                part["answer"], part["error"] = pd.Series(answers, part.index, object), error
                yield part

    return prompts.select("hash", "prompt").mapInPandas(call, "hash string, prompt string, answer string, error string")


def answered(rows: DataFrame, prompt: str, fn: Callable[[list[str], int], list[str]], memo: Memo, rounds: int = 3, batch: int = 32) -> DataFrame:
    """``rows`` with answer and status (ok, attempts, error): each distinct prompt is answered once, now or in an earlier run.

    Prompts that the memo has are not asked again. What fails is asked again in at most ``rounds`` rounds; each
    round's answers are stored before the next, so a lost executor repeats one round's failed tasks only. A null
    answer is a failure. A prompt that is null has no answer and no attempt.
    """
    spark = rows.sparkSession
    keyed = rows.select(F.struct("*").alias("_row"), F.sha2(F.col(prompt), 256).alias("_hash"), F.col(prompt).alias("_prompt"))
    every = keyed.where("_prompt IS NOT NULL").select(F.col("_hash").alias("hash"), F.col("_prompt").alias("prompt")).dropDuplicates(["hash"])
    left = kept(every.join(memo.table(spark).select("hash"), "hash", "left_anti"), "prompts")
    failed = None
    for attempt in range(1, rounds + 1):
        if left.isEmpty():
            break
        told = kept(asked(left, fn, attempt, batch), "answers")
        memo.add(told.where("answer IS NOT NULL").withColumn("attempts", F.lit(attempt)))
        left = told.where("answer IS NULL").select("hash", "prompt")
        failed = told.where("answer IS NULL").select("hash", F.coalesce("error", F.lit("no answer")).alias("error"), F.lit(attempt).alias("tried"))
    known = memo.table(spark).groupBy("hash").agg(F.min(F.struct("attempts", "answer")).alias("_known"))  # once each, unless two runs met
    failed = failed if failed is not None else spark.createDataFrame([], "hash string, error string, tried int")
    failed = failed.select("hash", F.col("error").alias("_error"), F.col("tried").alias("_tried"))
    out = keyed.join(known.withColumnRenamed("hash", "_hash"), "_hash", "left").join(failed.withColumnRenamed("hash", "_hash"), "_hash", "left")
    tried = F.coalesce("_known.attempts", "_tried", F.lit(0)).alias("attempts")
    status = F.struct(F.col("_known").isNotNull().alias("ok"), tried, F.when(F.col("_known").isNull(), F.col("_error")).alias("error"))
    return out.select("_row.*", F.col("_known.answer").alias("answer"), status.alias("status"))


def insight(title, text, cases):
    """Deterministic explanation of last resort: title, up to three case names, the beginning of the text."""
    names = F.array_join(F.slice(F.coalesce(cases, F.array().cast("array<string>")), 1, 3), ", ")
    return F.concat_ws(" ", F.concat(title, F.lit(":")), F.substring(text, 1, 300), F.nullif(names, F.lit("")))


def looks_spanish(text):
    """Signs or common words of Spanish, for the automatic source language."""
    return text.rlike(r"(?iu)[ñ¿¡]|(?:^|[^\p{L}])(?:el|los|las|una|que|para|derechos|ley)(?:[^\p{L}]|$)")
