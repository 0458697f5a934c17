"""Routing and merging of scored candidates: zones, gap cut, best per key, top-k."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import probability_zone, score_zone


@dataclass(frozen=True)
class Thresholds:
    """Score thresholds; they depend on the scale of the scores."""

    low: float = 0.65
    verify: float = 0.70
    accept: float = 0.85
    gap: float = 0.20
    top_k: int = 20


def classified(rows: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return rows.withColumn("zone", score_zone(F.col("score"), t.low, t.verify, t.accept))


def by_probability(rows: DataFrame, low: float = 0.4, high: float = 0.6, p: str = "p") -> DataFrame:
    return rows.withColumn("zone", probability_zone(F.col(p), low, high))


def within_gap(rows: DataFrame, gap: float, by: str = "query_id", score: str = "score") -> DataFrame:
    """Rows at most ``gap`` below their query's best score."""
    top = F.max(score).over(Window.partitionBy(by))
    return rows.withColumn("__gap", F.round(top - F.col(score), 9)).where(F.col("__gap") <= gap).drop("__gap")


def keep_best(rows: DataFrame, key: list[str | Column], score: str = "score", order: tuple[str, ...] = ("source_ord", "ord")) -> DataFrame:
    """One row per key: the highest score, of equal ones the earliest."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), *order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_first(rows: DataFrame, key: list[str | Column], order: tuple[str, ...] = ("source_ord", "ord")) -> DataFrame:
    """One row per key: the first source's, even if another scores higher."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def applied(rows: DataFrame, t: Thresholds, review: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Classify, review what needs it, keep the best per document, cut by gap and top-k.

    Without ``review`` the rows that need it pass as they are.
    """
    zoned = classified(rows, t)
    asked = zoned.where("zone = 'needs_review'")
    merged = zoned.where("zone = 'accepted'").unionByName(review(asked) if review else asked)
    best = within_gap(keep_best(merged, ["query_id", "doc_id"], order=("ord",)), t.gap)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord", "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= t.top_k)


def keyword_union(semantic: DataFrame, keyword: DataFrame, keyword_score: float = 0.70, boost: float = 0.05) -> DataFrame:
    """Full outer union: keyword only scores ``keyword_score``, both score ``boost`` more, 1 at most."""
    s = semantic.select("query_id", "doc_id", F.col("score").alias("s"))
    k = keyword.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(True))
    score = F.when(F.col("s").isNull(), F.lit(keyword_score)).when(F.col("hit"), F.least(F.lit(1.0), F.col("s") + boost)).otherwise(F.col("s"))
    return s.join(k, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", score.alias("score"))


def gated(rows: DataFrame, search: float, verify: float, low: float, decay: float = 0.0, keyword_score: float = 0.70) -> DataFrame:
    """Keyword and alias gate over semantic, hit, bias: accept, verify or drop, with the total score.

    A near miss (at most 0.10 under ``low``) and a total of ``verify`` or more are verified.
    """
    total = F.when(F.col("hit"), F.greatest(F.col("semantic"), F.lit(keyword_score))).otherwise(F.col("semantic")) + F.coalesce("bias", F.lit(0.0))
    out = rows.withColumn("total", F.round(total, 6))
    accept = (F.col("total") >= search - decay) & (F.col("semantic") >= low)
    ask = ((F.col("semantic") >= low - 0.10) & (F.col("semantic") < low)) | (F.col("total") >= verify - decay)
    return out.withColumn("gate", F.when(accept, "accept").when(ask, "verify").otherwise("drop"))
