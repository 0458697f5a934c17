"""The retrieval pipeline over batches of queries: cache walk, search, triage, review, rephrase.

Every stage works on all queries at once; the rephrase loop runs at most
``max_rephrase`` + 1 times on the queries still without an answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import adjusted_by, parsed_score
from ..functions.text import normalised
from . import triage
from .search import vector_topk


@dataclass
class Stages:
    """The optional parts; each takes and gives columns or DataFrames."""

    moderate: Callable[[Column], Column] | None = None
    preprocess: Callable[[Column], Column] | None = None
    embed: Callable[[DataFrame], DataFrame] | None = None  # query_id, text -> query_id, embedding
    keyword: Callable[[DataFrame], DataFrame] | None = None  # query_id, text -> query_id, doc_id, score
    predict: Callable[[DataFrame], DataFrame] | None = None  # candidates -> with p
    judge: Callable[[DataFrame], DataFrame] | None = None  # candidates -> with answer
    rephrase: Callable[[DataFrame], DataFrame] | None = None  # query_id, text -> query_id, text


def cached_answers(queries: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers from the cache (query, doc_id, score, ord), as they were stored, and the queries without one."""
    q = queries.withColumn("__k", normalised(F.col("text")))
    c = cache.withColumn("__k", normalised(F.col("query"))).drop("query")
    hits = q.select("query_id", "__k").join(c, "__k").drop("__k")
    return hits, q.join(c.select("__k").distinct(), "__k", "left_anti").drop("__k")


def searched(queries: DataFrame, corpus: DataFrame, t: triage.Thresholds, s: Stages) -> DataFrame:
    """query_id, doc_id, score, rank for queries with ``text`` and ``embedding``."""
    found = vector_topk(corpus, queries, t.top_k).select("query_id", "doc_id", "score", "ord", F.lit(0).alias("source_ord"))
    if s.keyword:
        found = triage.keep_best(found.unionByName(s.keyword(queries).withColumn("source_ord", F.lit(1)).withColumn("ord", F.lit(0))), ["query_id", "doc_id"])

    def review(rows: DataFrame) -> DataFrame:
        sure = None
        if s.predict:
            zoned = triage.by_probability(s.predict(rows))
            sure = zoned.where("zone = 'accepted'").select(*rows.columns)
            rows = zoned.where("zone = 'needs_review'").select(*rows.columns)
        if s.judge:
            # behind a generator the reading of answers is not spelled out again in every use
            asked = s.judge(rows).withColumn("_read", F.explode(F.array(parsed_score(F.col("answer")))))
            rows = asked.withColumn("score", adjusted_by(F.col("score"), F.col("_read"))).where(F.col("score") >= t.accept).select(*rows.columns)
        elif s.predict:
            rows = rows.where(F.lit(False))  # nobody judges the uncertain ones
        return rows if sure is None else sure.unionByName(rows)

    return triage.applied(found.drop("source_ord"), t, review if s.predict or s.judge else None).select("query_id", "doc_id", "score", "rank")


def run(queries: DataFrame, corpus: DataFrame, t: triage.Thresholds = triage.Thresholds(), s: Stages = Stages(), cache: DataFrame | None = None, max_rephrase: int = 2) -> DataFrame:
    """query_id, doc_id, score, rank, attempt (-1: from the cache) for queries with query_id, text, embedding.

    Cached answers pass as they are, without triage or top-k.
    """
    if s.moderate:
        queries = queries.where(F.coalesce(s.moderate(F.col("text")), F.lit(True)))
    if s.preprocess:
        queries = queries.withColumn("text", s.preprocess(F.col("text")))
    out = None
    if cache is not None:
        hits, queries = cached_answers(queries, cache)
        out = hits.select("query_id", "doc_id", "score", F.col("ord").alias("rank"), F.lit(-1).alias("attempt"))
    for attempt in range(max_rephrase + 1):
        asked = s.embed(queries) if s.embed else queries
        found = searched(asked, corpus, t, s).withColumn("attempt", F.lit(attempt))
        out = found if out is None else out.unionByName(found)
        if not s.rephrase or attempt == max_rephrase:
            break
        left = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
        new = s.rephrase(left).select("query_id", F.col("text").alias("__new"))
        changed = left.join(new, "query_id").where("__new IS NOT NULL AND __new <> text")
        queries = changed.withColumn("text", F.col("__new")).drop("__new")
        if queries.isEmpty():
            break
    return out


def incremental(asked: DataFrame, searched_before: DataFrame, cached: DataFrame, search: Callable[[DataFrame], DataFrame], t: triage.Thresholds) -> DataFrame:
    """Light path over (query_id, doc_id) ranges: only documents not searched before are searched, then both parts are merged."""
    fresh = asked.join(searched_before, ["query_id", "doc_id"], "left_anti")
    both = cached.withColumn("source_ord", F.lit(0)).unionByName(search(fresh).withColumn("source_ord", F.lit(1)))
    kept = triage.keep_first(both, ["query_id", "doc_id"]).where(F.col("score") >= t.accept)
    return triage.within_gap(kept, t.gap)
