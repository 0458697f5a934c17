"""Audits over collections and query sets, and what is kept of a case search."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalised


def unexpected_arrays(df: DataFrame, issues: Mapping[str, str], keep: list[str]) -> DataFrame:
    """``keep`` and issue: one row for each array column of ``issues`` that is not empty. One pass; null counts as empty."""
    found = F.filter(F.array(*(F.when(F.size(c) > 0, F.lit(issue)) for c, issue in issues.items())), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(found).alias("issue"))


def query_profile(df: DataFrame, domain: str, expected: Column) -> DataFrame:
    """Queries of each domain, and how many of them have expected results (an array; null counts as empty)."""
    return df.groupBy(domain).agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.coalesce(F.size(expected) > 0, F.lit(False))).alias("with_expected"))


def call_stats(df: DataFrame, calls: str = "calls", candidates: str = "candidates", reranked: str = "reranked") -> DataFrame:
    """One row over all queries: model calls, how many queries need one, and the share of candidates that were judged."""
    n, some = F.count(F.lit(1)), F.count_if(F.col(calls) > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    share = lambda a, b, d: F.round(a / F.greatest(b, F.lit(1)), d)
    return df.agg(
        n.alias("queries"), total(calls).alias("total_llm_calls"), share(total(calls), n, 2).alias("avg_llm_calls_per_query"), some.alias("queries_with_llm_calls"), share(some, n, 3).alias("llm_call_frequency"),
        total(candidates).alias("total_candidates_evaluated"), total(reranked).alias("total_llm_rerank_calls"), share(total(reranked), total(candidates), 4).alias("llm_rerank_rate"),
    )


def case_pairs(results: DataFrame, searched: DataFrame, min_score: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """What a case search leaves behind: (query, doc_id) for all cases searched, and (query, doc_id, score) for confident results.

    Both inputs have query and doc_id, ``results`` also score. The range is kept even where
    nothing is confident; blank queries leave nothing.
    """
    asked = lambda df: df.withColumn("query", normalised(F.col("query"))).where("query <> ''")
    ranges = asked(searched).select("query", "doc_id").distinct()
    best = asked(results).where(F.col("score") >= min_score).groupBy("query", "doc_id").agg(F.max("score").alias("score"))
    return ranges, best
