"""Further queries: projections of the document model, stored queries, labels, judgements and costs of runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vectors import cosine
from ..operators import changes, lexicon, reranker, search, slots, triage
from ..sources.tables import table
from .corpus import _BM25, _COV, _JAC, _PAIRS, _docs, _pairs
from .retrieval import _KEYWORD, _SCORES, EVERY, _keyword, _queries, _vectors, candidates


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Title and text of an item, each with its fallbacks."""
    p = table(spark, sf, "part")
    title = F.coalesce(*(text.blank_to_null(c) for c in (F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")))), F.lit("(untitled)"))
    body = text.first_text(F.when(F.col("p_partkey") % 5 == 0, F.lit("  ")).otherwise(F.col("p_type")), F.col("p_brand"))
    return p.select("p_partkey", title.alias("title"), body.alias("body"))


def embed_texts(spark, sf):
    """Labelled concatenation for embedding, leaving out what is missing."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.concat_ws(" ", F.concat(F.lit("Article "), "r_name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Chapter "), "n_name")), F.concat(F.lit("Section "), F.col("n_nationkey"))).alias("embed_text"))


def previews(spark, sf):
    return _docs(spark, sf).select("doc_id", F.substring("text", 1, 80).alias("preview"))


def title_lookup(spark, sf):
    """Wanted titles in the caller's order, the newest part of each."""
    wanted = table(spark, sf, "part").select(F.upper("p_type").alias("title"), F.col("p_partkey").alias("ord"))
    return search.lookup_newest(table(spark, sf, "part"), wanted, "p_type", "p_partkey").select("p_type", "p_partkey", "ord")


def allowed_titles(spark, sf):
    allowed = table(spark, sf, "part").where("p_partkey % 40 = 0").select(F.upper("p_type").alias("p_type"))
    return search.restricted(table(spark, sf, "part").select("p_partkey", "p_type"), allowed, "p_type")


def expected_titles(spark, sf):
    """How many expected titles exist, per group."""
    have = table(spark, sf, "part").where("p_partkey % 3 = 0").select("p_type").distinct().withColumn("found", F.lit(True))
    asked = table(spark, sf, "part").select("p_brand", "p_type").distinct().join(have, "p_type", "left")
    return asked.groupBy("p_brand").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("found")).alias("present"))


def judged_candidates(spark, sf):
    c = candidates(spark, sf).withColumn("title", F.concat(F.lit("Doc "), "doc_id"))
    j = c.where("doc_id % 4 = 0").select("query_id", F.upper("title").alias("title"), F.when(F.col("doc_id") % 8 == 0, 0.9).otherwise(0.2).alias("score"))
    return reranker.judgement_rows(c, j).select("query_id", "doc_id", "label")


def title_labels(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", reranker.relevance_label(F.col("p_type"), F.concat(F.upper("p_type"), F.when(F.col("p_partkey") % 2 == 0, " more").otherwise(""))).alias("longer"), reranker.relevance_label(F.col("p_type"), F.col("p_brand")).alias("other"))


def feature_merge(spark, sf):
    """Old and new feature rows by query and title; the new ones win."""
    f = candidates(spark, sf).select("query_id", "doc_id", F.lit("old").alias("version"))
    return reranker.merged_features(f, f.where("doc_id % 2 = 0").withColumn("version", F.lit("new")), ["query_id", "doc_id"])


def cached_query_match(spark, sf):
    """The most similar stored query of at least 0.2, for each query; all vectors that do not ask are stored."""
    stored = _vectors(spark, sf).where(F.col("doc_id") % EVERY != 0)
    return search.vector_topk(stored, _queries(spark, sf), 1).where("score >= 0.2").select("query_id", F.col("doc_id").alias("cached_id"), "score")


def confident_results(spark, sf):
    """Results of at least 0.3 of queries that have none stored."""
    have = _queries(spark, sf).where("query_id % 3 = 0").select("query_id")
    return candidates(spark, sf).where("score >= 0.3").join(have, "query_id", "left_anti").select("query_id", "doc_id", "score")


def reference_sets(spark, sf):
    """Each customer's set of order priorities: adding one again changes nothing."""
    o = table(spark, sf, "orders")
    twice = o.unionByName(o.where("o_orderkey % 2 = 0"))
    return twice.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("refs"))


def case_gate(spark, sf):
    """Direct hits, a band that is judged, and what passes with the judge's bonus."""
    s = F.col("score")
    zone = F.when(s >= 0.30, "direct").when((s >= 0.20) & (F.round(s + 0.10 + 0.05, 6) >= 0.37), "judged_in").when(s >= 0.20, "judged_out").otherwise("out")
    return candidates(spark, sf).select("query_id", "doc_id", zone.alias("zone"))


def run_costs(spark, sf):
    """Calls per user and day; a run without embedding, chat and moderation calls was answered from the cache."""
    e = table(spark, sf, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    out = e.agg(F.count_if(F.col("event_type") == "purchase").alias("embed"), F.count_if(F.col("event_type") == "click").alias("chat"), F.count_if(F.col("event_type") == "login").alias("moderation"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("cache_hit", (F.col("embed") + F.col("chat") + F.col("moderation")) == 0)


def faithfulness(spark, sf):
    """Verdicts per source: how many, what share is faithful, mean score."""
    d = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("rate"))


def alias_hits(spark, sf):
    """The 100 best aliases (all vectors that do not ask) of a query with a cosine of at least 0.25."""
    a = _vectors(spark, sf).where(F.col("doc_id") % EVERY != 0)
    return search.vector_topk(a, _queries(spark, sf), 100).where("score >= 0.25").select("query_id", "doc_id", "score")


def self_similarity(spark, sf):
    """Cosine of each vector with the next one, as a column expression."""
    v = _vectors(spark, sf).select("doc_id", "embedding")
    nxt = v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "doc_id").select("doc_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def features15(spark, sf):
    """All fifteen features of query and document, in their fixed order."""
    rows = _pairs(spark, sf).select("query_id", "doc_id", "source", "q", "d", "title", "bm25", "matched")
    v = _vectors(spark, sf).select("doc_id", "embedding")
    rows = rows.join(v, "doc_id", "left").join(v.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("qe")), "query_id", "left")
    w = Window.partitionBy("query_id")
    score = F.round(F.col("bm25") / (F.lit(1.0) + F.col("bm25")), 6)
    rows = rows.withColumn("semantic", score).withColumn("title_text", F.array_join("title", " ")).withColumn("query_text", F.array_join("q", " "))
    kind = lexicon.match_kind(F.col("query_text"), F.col("title_text"))
    exact = (F.lower("query_text") == F.lower("title_text")).cast("int")
    return rows.select(
        "query_id", "doc_id", F.col("semantic").alias("semantic_score"), F.round("bm25", 6).alias("bm25_score"), exact.alias("alias_match"), exact.alias("keyword_match"), F.lit(0.0).alias("domain_bias"),
        F.round(F.log1p(F.length(F.array_join("d", " "))), 6).alias("document_length"), F.size(F.array_distinct("q")).cast("long").alias("query_length"), F.lit(2).alias("section_depth"),
        F.round(cosine(F.col("qe"), F.col("embedding")), 6).alias("embedding_cosine"), kind.alias("match_type"), F.round(F.max("semantic").over(w) - F.col("semantic"), 6).alias("score_gap"),
        F.round(F.col("matched") / F.size(F.array_distinct("q")), 6).alias("term_coverage"), F.round(text.jaccard(F.col("q"), F.col("title")), 6).alias("title_similarity"), (F.size("d") > 100).cast("int").alias("has_nested"), F.lit(0).alias("bias_flag"),
    )


def insight_texts(spark, sf):
    """Spanish text where there is one, else the English, in index order."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("es "), "event_type")).alias("es"), F.col("event_type").alias("en"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select("user_id", F.row_number().over(w).alias("index"), F.coalesce("es", "en").alias("shown"))


def spanish_queries(spark, sf):
    return _docs(spark, sf).select("doc_id", slots.looks_spanish(F.col("text")).alias("spanish"))


def union_of_lists(spark, sf):
    """Cached and new results, the first per normalised title."""
    c = candidates(spark, sf).select("query_id", "doc_id", "score", "ord", F.concat(F.lit(" Doc  "), F.col("doc_id") % 50).alias("title"))
    k = _keyword(spark, sf).select("query_id", "doc_id", F.lit(0.5).alias("score"), F.col("doc_id").cast("int").alias("ord"), F.concat(F.lit("doc "), F.col("doc_id") % 50).alias("title"))
    rows = c.withColumn("source_ord", F.lit(0)).unionByName(k.withColumn("source_ord", F.lit(1))).withColumn("t", text.normalised(F.col("title")))
    return triage.keep_first(rows, ["query_id", "t"]).select("query_id", "t", "doc_id")


def search_range(spark, sf):
    """What is asked for, was searched before, or dropped out since: keys of two months."""
    o = table(spark, sf, "orders")
    month = lambda m: o.where(f"month(o_orderdate) = {m}").select("o_custkey")
    return changes.split_sets(month(1), month(2), "o_custkey")


_LETTERS = r"(?i)[ñ¿¡]|(?:^|[^\p{L}])(?:el|los|las|una|que|para|derechos|ley)(?:[^\p{L}]|$)"
_MATCH = "CASE WHEN qt = '' OR tt = '' THEN 0 WHEN qt = tt THEN 2 WHEN contains(qt, tt) OR contains(tt, qt) OR list_has_any(q, title) THEN 1 ELSE 0 END"

ORACLE_SQL = {
    "payloads": "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_name END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END, '(untitled)') AS title, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_type END AS body FROM part",
    "embed_texts": "SELECT n_nationkey, concat_ws(' ', 'Article ' || r_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Chapter ' || n_name END, 'Section ' || n_nationkey) AS embed_text FROM nation JOIN region ON n_regionkey = r_regionkey",
    "previews": "SELECT doc_id, substring(text, 1, 80) AS preview FROM documents",
    "title_lookup": "WITH w AS (SELECT upper(p_type) AS t, min(p_partkey) AS ord FROM part GROUP BY 1) SELECT p_type, max(p_partkey) AS p_partkey, any_value(ord) AS ord FROM part JOIN w ON t = upper(p_type) GROUP BY 1",
    "allowed_titles": "SELECT p_partkey, p_type FROM part WHERE lower(p_type) IN (SELECT lower(p_type) FROM part WHERE p_partkey % 40 = 0)",
    "expected_titles": "SELECT p_brand, count(*) AS expected, count(h.t) AS present FROM (SELECT DISTINCT p_brand, p_type FROM part) a LEFT JOIN (SELECT DISTINCT p_type AS t FROM part WHERE p_partkey % 3 = 0) h ON h.t = a.p_type GROUP BY 1",
    "judged_candidates": f"WITH {_SCORES} SELECT query_id, doc_id, CAST(doc_id % 8 = 0 AS INT) AS label FROM c WHERE doc_id % 4 = 0 OR ord <= 5",
    "title_labels": "SELECT p_partkey, 1 AS longer, CAST(starts_with(lower(p_type), lower(p_brand)) OR starts_with(lower(p_brand), lower(p_type)) AS INT) AS other FROM part",
    "feature_merge": f"WITH {_SCORES} SELECT query_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM c",
    "cached_query_match": f"WITH {_SCORES} SELECT query_id, cached_id, score FROM (SELECT query_id, doc_id AS cached_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM pairs WHERE doc_id % {EVERY} <> 0) WHERE n = 1 AND score >= 0.2",
    "confident_results": f"WITH {_SCORES} SELECT query_id, doc_id, score FROM c WHERE score >= 0.3 AND query_id % 3 <> 0",
    "reference_sets": "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS refs FROM orders GROUP BY 1",
    "case_gate": f"WITH {_SCORES} SELECT query_id, doc_id, CASE WHEN score >= 0.30 THEN 'direct' WHEN score >= 0.20 AND round(score + 0.15, 6) >= 0.37 THEN 'judged_in' WHEN score >= 0.20 THEN 'judged_out' ELSE 'out' END AS zone FROM c",
    "run_costs": "WITH e AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (event_type = 'purchase') AS embed, count(*) FILTER (event_type = 'click') AS chat, count(*) FILTER (event_type = 'login') AS moderation, count(*) AS n FROM events GROUP BY 1, 2) SELECT *, embed + chat + moderation = 0 AS cache_hit FROM e",
    "faithfulness": "SELECT source, count(*) AS n, round(avg(quality::DOUBLE), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "alias_hits": f"WITH {_SCORES} SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM pairs WHERE doc_id % {EVERY} <> 0) WHERE n <= 100 AND score >= 0.25",
    "self_similarity": "SELECT a.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "features15": f"""WITH {_PAIRS}, b AS (SELECT *, {_BM25} AS bm, array_to_string(q, ' ') AS qt, array_to_string(title, ' ') AS tt FROM p), s AS (SELECT *, round(bm / (1 + bm), 6) AS sem FROM b)
        SELECT query_id, doc_id, sem AS semantic_score, round(bm, 6) AS bm25_score, CAST(qt = tt AS INT) AS alias_match, CAST(qt = tt AS INT) AS keyword_match, 0.0::DOUBLE AS domain_bias, round(ln(1 + length(array_to_string(d, ' '))), 6) AS document_length, len(list_distinct(q)) AS query_length, 2 AS section_depth,
        coalesce(round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6), 0) AS embedding_cosine, {_MATCH} AS match_type, round(max(sem) OVER (PARTITION BY query_id) - sem, 6) AS score_gap, round({_COV}, 6) AS term_coverage, round({_JAC}, 6) AS title_similarity, CAST(len(d) > 100 AS INT) AS has_nested, 0 AS bias_flag
        FROM s LEFT JOIN embeddings x ON x.vec_id = query_id LEFT JOIN embeddings y ON y.vec_id = doc_id""",
    "insight_texts": "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS index, CASE WHEN event_id % 4 = 0 THEN 'es ' || event_type ELSE event_type END AS shown FROM events",
    "spanish_queries": f"SELECT doc_id, regexp_matches(text, '{_LETTERS}') AS spanish FROM documents",
    "union_of_lists": f"""WITH {_SCORES}, {_KEYWORD}, u AS (SELECT query_id, doc_id, ord, 0 AS so FROM c UNION ALL SELECT query_id, doc_id, doc_id::INT, 1 FROM k)
        SELECT query_id, t, doc_id FROM (SELECT query_id, 'doc ' || (doc_id % 50) AS t, doc_id, row_number() OVER (PARTITION BY query_id, doc_id % 50 ORDER BY so, ord) AS n FROM u) WHERE n = 1""",
    "search_range": "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE month(o_orderdate) = 1), b AS (SELECT DISTINCT o_custkey FROM orders WHERE month(o_orderdate) = 2) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'new' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'existing' END AS state FROM a FULL JOIN b ON a.o_custkey = b.o_custkey",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
