"""Queries on model answers, bare ordinals, audits, call statistics, case pairs and result files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..operators import audits, lexicon
from ..sources.tables import table
from ..sources.writers import scratch, write_rows
from .retrieval import _SCORES, candidates


def verified_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in every form that is read, one form for each remainder of the key."""
    n = F.col("p_size")
    k = F.col("p_partkey") % 6
    answer = F.when(k == 0, F.concat(F.lit("Reasoning: clause 3.\nScore: "), n % 10)).when(k == 1, F.concat(F.lit("Clause 4, then "), n % 10, F.lit(" of them")))
    answer = answer.when(k == 2, F.concat(F.lit("score:  "), F.element_at(F.array(*map(F.lit, answers.DIGITS)), (n % 10 + 1).cast("int")))).when(k == 3, F.concat(F.lit("Score: "), n)).when(k == 4, "")
    return table(spark, sf, "part").select("p_partkey", answers.verified_score(answer).alias("score"))


def corrected_queries(spark, sf):
    k = F.col("p_partkey") % 6
    answer = F.when(k == 0, F.concat(F.lit(" Corrected: "), "p_name")).when(k == 1, F.concat(F.lit("grammar fixed - "), "p_name")).when(k == 2, "I'm sorry, I can't help with that").when(k == 3, "  ").when(k == 4, "Fixed:")
    return table(spark, sf, "part").select("p_partkey", answers.corrected_query(F.col("p_type"), answer).alias("query"))


def topic_gate(spark, sf):
    """Queries that the answer keeps, and those that go to general information."""
    k = F.col("p_partkey") % 7
    answer = F.when(k == 0, " Yes.").when(k == 1, "NO").when(k == 2, "").when(k == 3, "yes, it is").when(k == 4, "...").when(k == 5, F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.when(answers.on_topic(answer), "search").otherwise("general").alias("route"))


def bare_amendments(spark, sf):
    """Bare ordinals as titles of the dictionary, which holds a part of the amendments."""
    p = table(spark, sf, "part")
    k, n = F.col("p_partkey") % 5, F.col("p_size")
    word = F.get(F.array(*map(F.lit, lexicon.ORDINALS)), (n - 1).cast("int"))
    asked = F.when(k == 0, n.cast("string")).when(k == 1, F.concat(F.lit("The "), F.translate(word, "-", " "))).when(k == 2, F.initcap(word)).when(k == 3, F.concat(n, F.lit("th amendment"))).otherwise(F.concat(F.lit(" "), n, F.lit("th ")))
    titles = p.where("p_size <= 24").select(F.concat(F.col("p_size"), F.when(F.col("p_size").isin(1, 21), "st").when(F.col("p_size").isin(2, 22), "nd").when(F.col("p_size").isin(3, 23), "rd").otherwise("th"), F.lit(" Amendment")).alias("title")).distinct()
    return lexicon.bare_amendments(p.select("p_partkey", asked.alias("text")), titles, "text").select("p_partkey", "title")


def wrong_arrays(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>")).alias("clauses"), F.when(F.col("p_partkey") % 5 == 0, F.array("p_brand")).alias("keywords"))
    return audits.unexpected_arrays(p, {"clauses": "has clauses", "keywords": "has keywords"}, ["p_partkey"])


def query_profile(spark, sf):
    """Labelled and other documents by language; those of good quality have an expected result."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return audits.query_profile(d, "lang", F.when(F.col("quality") == 1, F.array("doc_id")))


def call_stats(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("calls"), F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("event_type") == "purchase").alias("reranked"))
    return audits.call_stats(e)


def case_pairs(spark, sf):
    """What each query searched and what it found with a score of at least 0.3; every other query is asked in another spelling."""
    name = F.concat(F.when(F.col("ord") % 2 == 0, "Query ").otherwise(" query  "), F.col("query_id"))
    rows = candidates(spark, sf).select(name.alias("query"), "doc_id", "score")
    ranges, best = audits.case_pairs(rows, rows, 0.3)
    return ranges.join(best, ["query", "doc_id"], "left").groupBy("query").agg(F.count(F.lit(1)).alias("searched"), F.count("score").alias("kept"), F.max("score").alias("best"))


def written_results(spark, sf):
    """Results written as JSON lines and read again."""
    return write_rows(candidates(spark, sf).where("score >= 0.2"), scratch(spark, "results"), "json")


_TAIL = "CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END"

ORACLE_SQL = {
    "verified_scores": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 6 IN (0, 1, 2) THEN p_size % 10 WHEN p_partkey % 6 = 3 AND p_size < 10 THEN p_size ELSE 5 END AS INT) AS score FROM part",
    "corrected_queries": "SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1) THEN trim(p_name) ELSE p_type END AS query FROM part",
    "topic_gate": "SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 2, 3, 6) OR (p_partkey % 7 = 5 AND regexp_matches(upper(p_type), '^YES( |$)')) THEN 'search' ELSE 'general' END AS route FROM part",
    "bare_amendments": f"SELECT p_partkey, CASE WHEN p_partkey % 5 <> 3 AND p_size BETWEEN 1 AND 24 AND p_size IN (SELECT p_size FROM part) THEN p_size || {_TAIL} || ' Amendment' END AS title FROM part",
    "wrong_arrays": "SELECT p_partkey, 'has clauses' AS issue FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'has keywords' FROM part WHERE p_partkey % 5 = 0",
    "query_profile": "SELECT lang, count(*) AS queries, count(*) FILTER (quality = 1) AS with_expected FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "call_stats": """WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS calls, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS reranked FROM events GROUP BY 1)
        SELECT count(*) AS queries, sum(calls)::BIGINT AS total_llm_calls, round(sum(calls) / count(*)::DOUBLE, 2) AS avg_llm_calls_per_query, count(*) FILTER (calls > 0) AS queries_with_llm_calls, round(count(*) FILTER (calls > 0) / count(*)::DOUBLE, 3) AS llm_call_frequency,
        sum(n)::BIGINT AS total_candidates_evaluated, sum(reranked)::BIGINT AS total_llm_rerank_calls, round(sum(reranked) / sum(n)::DOUBLE, 4) AS llm_rerank_rate FROM e""",
    "case_pairs": f"WITH {_SCORES} SELECT 'query ' || query_id AS query, count(*) AS searched, count(*) FILTER (score >= 0.3) AS kept, max(score) FILTER (score >= 0.3) AS best FROM c GROUP BY 1",
    "written_results": f"WITH {_SCORES} SELECT query_id, doc_id, score, ord FROM c WHERE score >= 0.2",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
