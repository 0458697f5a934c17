"""The fifteen features of the best candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import NAMES, Domain, featured, vectors
from ..sources.tables import table
from .retrieval import _SCORES, _queries, _vectors, candidates

DOMAIN = Domain(3, {"title": "title", "article": "article", "section": "section"}, {"src1": 0.1, "src2": -0.05})


def _candidates(spark, sf) -> DataFrame:
    """Ten best vectors per query with their documents: the source is the title, the first line the text, further lines are children of every third."""
    d, v = table(spark, sf, "documents"), _vectors(spark, sf).select("doc_id", "embedding")
    lines = F.split("text", "\n", -1)
    docs = d.select("doc_id", F.col("source").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("article"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("n_chars").cast("string")).alias("section"), F.get(lines, F.lit(0)).alias("text"), F.when(F.col("doc_id") % 3 == 0, F.slice(lines, 2, 1 << 20)).alias("nested"))
    asked = d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", "source", F.array_join(F.slice(F.split("text", " ", -1), 1, 6), " ")).alias("query"), F.when(F.col("doc_id") % 100 == 0, F.array(F.lit("nothing"), F.upper("source"))).alias("keywords"), F.array(F.lit("src1"), F.col("source")).alias("aliases"))
    q = _queries(spark, sf).select("query_id", F.col("embedding").alias("query_embedding"))
    return candidates(spark, sf).select("query_id", "doc_id", "score").join(docs, "doc_id").join(v, "doc_id").join(asked, "query_id").join(q, "query_id")


def ranked_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = featured(_candidates(spark, sf), DOMAIN)
    return rows.select("query_id", "doc_id", *(F.round(n, 6).alias(n) for n in NAMES))


def feature_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The features as one vector, summed up with weights from 1 to 15."""
    rows = vectors(featured(_candidates(spark, sf), DOMAIN))
    weighted = F.aggregate(F.transform("vector", lambda x, i: F.round(x, 6) * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("query_id", "doc_id", F.size("vector").cast("long").alias("size"), F.round(weighted, 3).alias("weighted"))


QUERIES = {"ranked_features": ranked_features, "feature_vectors": feature_vectors}

_WORDS = r"'[\p{L}\p{N}_]+'"
_MEETS = "list_filter({names}, lambda m: contains(t, m) OR contains(m, t))[1]"
_FEATURES = f"""{_SCORES}, d AS (SELECT doc_id, source AS title, CASE WHEN doc_id % 2 = 0 THEN lang END AS article, CASE WHEN doc_id % 5 = 0 THEN '' ELSE n_chars::VARCHAR END AS section, string_split(text, chr(10)) AS lines, text FROM documents),
    a AS (SELECT doc_id AS query_id, concat_ws(' ', source, array_to_string(string_split(text, ' ')[1:6], ' ')) AS query, CASE WHEN doc_id % 100 = 0 THEN ['nothing', lower(source)] ELSE []::VARCHAR[] END AS kw, ['src1', lower(source)] AS al FROM documents WHERE doc_id % 50 = 0),
    r AS (SELECT c.query_id, c.doc_id, c.score, d.*  EXCLUDE (doc_id), a.* EXCLUDE (query_id), lower(title) AS t, trim(CASE WHEN c.doc_id % 3 = 0 THEN concat_ws(' ', lines[1], nullif(array_to_string(lines[2:], ' '), '')) ELSE lines[1] END) AS whole,
          list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS cos FROM c JOIN d USING (doc_id) JOIN a USING (query_id) JOIN embeddings x ON x.vec_id = c.query_id JOIN embeddings y ON y.vec_id = c.doc_id),
    w AS (SELECT *, regexp_extract_all(lower(query), {_WORDS}) AS q, regexp_extract_all(lower(whole), {_WORDS}) AS dw, regexp_extract_all(t, {_WORDS}) AS tw FROM r),
    m AS (SELECT *, {_MEETS.format(names="kw")} AS k1, {_MEETS.format(names="al")} AS a1 FROM w),
    f AS (SELECT query_id, doc_id, score AS semantic_score, coalesce(list_sum(list_transform(q, lambda x: len(list_filter(dw, lambda y: y = x)) * 2.5 / (len(list_filter(dw, lambda y: y = x)) + 1.5 * (0.25 + 0.75 * len(dw) / 2000.0)))), 0)::DOUBLE AS bm25_score,
        list_contains(al, t)::INT::DOUBLE AS alias_match, list_contains(kw, t)::INT::DOUBLE AS keyword_match, 3::DOUBLE AS domain_type, ln(1 + length(whole)) AS document_length, length(query)::DOUBLE AS query_length,
        (1 + (article IS NOT NULL)::INT + (section <> '')::INT)::DOUBLE AS section_depth, greatest(-1, least(1, cos))::DOUBLE AS embedding_cosine_similarity,
        CASE WHEN k1 = t THEN 2 WHEN k1 IS NOT NULL THEN 1 WHEN a1 = t THEN 2 WHEN a1 IS NOT NULL THEN 1 ELSE list_has_any(q, tw)::INT END::DOUBLE AS match_type,
        max(score) OVER (PARTITION BY query_id) - score AS score_gap_from_top, CASE WHEN whole = '' OR len(q) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(q), list_distinct(dw))) / len(list_distinct(q))::DOUBLE END AS query_term_coverage,
        CASE WHEN len(q) = 0 OR len(tw) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(q), list_distinct(tw))) / len(list_distinct(q || tw))::DOUBLE END AS title_similarity,
        (doc_id % 3 = 0 AND len(lines) > 1)::INT::DOUBLE AS has_nested_content, CASE title WHEN 'src1' THEN 0.1::DOUBLE WHEN 'src2' THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END AS bias_adjustment FROM m)"""
ORACLE_SQL = {
    "ranked_features": f"WITH {_FEATURES} SELECT query_id, doc_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in NAMES) + " FROM f",
    "feature_vectors": f"WITH {_FEATURES} SELECT query_id, doc_id, 15::BIGINT AS size, round(" + " + ".join(f"round({n}, 6) * {i}" for i, n in enumerate(NAMES, 1)) + ", 3) AS weighted FROM f",
}
