"""Queries of the pipeline, model slots, reranker and streams; SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import adjusted
from ..operators import pipeline, reranker, slots, triage
from ..sources.tables import table
from ..sources.writers import scratch
from ..streaming import changes as change_stream
from ..streaming import events as streams
from .retrieval import _SCORES, EVERY, LIMITS, _queries, _vectors

_FEATURES = ["log_chars", "lines", "letters", "digits"]


def _batch(spark, sf):
    return _queries(spark, sf).withColumn("text", F.concat(F.lit("Query "), F.col("query_id"))).drop("query_label")


def _judged(rows: DataFrame) -> DataFrame:
    """A stand-in judge: document id modulo 10 as its score."""
    return rows.withColumn("answer", F.concat(F.lit('{"score": '), F.col("doc_id") % 10, F.lit("}")))


def pipeline_run(spark: SparkSession, sf: str) -> DataFrame:
    """Search, zones and a judge for the band between; nothing cached."""
    return pipeline.run(_batch(spark, sf), _vectors(spark, sf), LIMITS, pipeline.Stages(judge=_judged), max_rephrase=0)


def pipeline_cached(spark, sf):
    """Every second query is answered by the cache, as stored."""
    b = _batch(spark, sf)
    cache = b.where(F.col("query_id") % (2 * EVERY) == 0).select(F.upper("text").alias("query"), (F.col("query_id") + 1000).alias("doc_id"), F.lit(1.0).alias("score"), F.lit(1).alias("ord"))
    return pipeline.run(b, _vectors(spark, sf), LIMITS, cache=cache, max_rephrase=0)


def pipeline_production(spark, sf):
    """The whole route: moderation, preparation, keyword hits, a model's zones and a judge for what the model leaves open."""
    stages = pipeline.Stages(
        moderate=lambda text: ~text.rlike("50$"),
        preprocess=F.lower,
        keyword=lambda q: q.select("query_id", (F.regexp_extract("text", "^query ([0-9]+)$", 1).cast("long") + 7).alias("doc_id"), F.lit(0.25).alias("score")),
        predict=lambda rows: rows.withColumn("p", F.pmod(F.col("query_id") * 31 + F.col("doc_id") * 17, F.lit(101)) / 100.0),
        judge=_judged,
    )
    return pipeline.run(_batch(spark, sf), _vectors(spark, sf), LIMITS, stages, max_rephrase=0)


def light_path(spark, sf):
    """Documents below 250 were searched before; their cached results are merged with the new ones."""
    v, q = _vectors(spark, sf), _batch(spark, sf)
    found = pipeline.vector_topk(v, q, 40).select("query_id", "doc_id", "score", "ord")
    asked = found.select("query_id", "doc_id")
    t = triage.Thresholds(low=0.1, verify=0.15, accept=0.2, gap=0.1)
    out = pipeline.incremental(asked, asked.where("doc_id < 250"), found.where("doc_id < 250"), lambda fresh: found.join(fresh, ["query_id", "doc_id"]), t)
    return out.select("query_id", "doc_id", "score")


def _rows(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("double")
    return d.select("doc_id", F.col("quality").cast("double").alias("label"), F.log1p(F.length("text")).alias("log_chars"), count("\n").alias("lines"), (count("[a-z]") / F.length("text")).alias("letters"), count("[0-9]").alias("digits"))


def mlp_rerank(spark, sf):
    rows = reranker.kept(reranker.folds(_rows(spark, sf), "label", "doc_id"), "labelled")
    model = reranker.fit(rows.where("fold <> 0"), _FEATURES, hidden=(16, 8))
    out = triage.by_probability(reranker.scored(rows, model, _FEATURES))
    return out.select("doc_id", "label", F.round("p", 6).alias("p"), "zone", (F.col("fold") == 0).alias("held_out"))


def reranker_metrics(spark, sf):
    rows = reranker.kept(reranker.folds(_rows(spark, sf), "label", "doc_id"), "labelled")
    model = reranker.fit(rows.where("fold <> 0"), _FEATURES, kind="logistic")
    return reranker.classifier_metrics(reranker.scored(rows.where("fold = 0"), model, _FEATURES))


def stratified_folds(spark, sf):
    """Labelled documents, dealt into five folds."""
    rows = reranker.stratified_folds(_rows(spark, sf).select("doc_id", "label"), "label", "doc_id")
    return rows.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def oof_calibration(spark, sf):
    """Out-of-fold probabilities of a label by text features, before and after calibration."""
    rows = reranker.stratified_folds(_rows(spark, sf), "label", "doc_id")
    rows = reranker.cross_calibrated(reranker.out_of_fold(rows, _FEATURES, kind="logistic"))
    return rows.select("doc_id", "label", "fold", F.round("p", 6).alias("p"), F.round("calibrated", 6).alias("calibrated"))


def feature_importance(spark, sf):
    rows = reranker.kept(_rows(spark, sf), "labelled")
    model = reranker.fit(rows, _FEATURES, kind="logistic")
    return reranker.importances(rows, model, _FEATURES, "doc_id")


def _rated(prompts: list[str], attempt: int) -> list[str]:
    """A stand-in judge that rates a page by its lines and is down for every third of its batches at first."""
    if attempt == 1 and len(prompts[0]) % 3 == 0:
        raise TimeoutError("busy")
    return [f"Score: {min(9, p.count(chr(10)))}" for p in prompts]


def verified_with_memo(spark, sf):
    """Every document's text is rated; failed batches are asked again, and equal texts once."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = slots.answered(docs, "text", _rated, slots.Memo(scratch(spark, "memo")), batch=8)
    return out.select("doc_id", F.round(adjusted(F.lit(0.5), F.col("answer")), 6).alias("score"), F.col("status.ok").alias("ok"))


def hash_embed(spark, sf):
    q = table(spark, sf, "benchmark")
    out = slots.with_slot(q, "text", slots.hash_embedding, "array<double>", "embedding")
    return out.select("item_id", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


def llm_verify_slot(spark, sf):
    """A judge that scores by length, and fails on empty batches."""
    q = table(spark, sf, "benchmark")
    return slots.with_slot(q, "text", lambda ts: [f"Score: {len(t) % 10}" for t in ts], "string", "answer").select("item_id", "answer")


def insights(spark, sf):
    d = table(spark, sf, "benchmark")
    return d.select("item_id", slots.insight(F.concat(F.lit("Item "), "item_id"), F.col("text"), F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D"))).alias("insight"))


def weekly_changes(spark, sf):
    """Two snapshots of the documents, a week apart, each taken in by a run of the stream; what the second one changed."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    new = d.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.concat(F.lit(" "), "text")))
    watch = change_stream.Watch(scratch(spark, "snapshots"), scratch(spark, "changes"), scratch(spark, "checkpoint"), "doc_id", ("text", "lang"))
    for snapshot in (d.where("doc_id % 5 <> 0"), new):
        watch.add(snapshot)
        watch.run(spark)
    return watch.changes(spark, 2).select("doc_id", "change")


def streaming_usage(spark, sf):
    path = f"{sf}/events.parquet"
    stream = streams.event_stream(spark, path, spark.read.parquet(path).schema)
    return streams.drained(streams.usage_by_window(stream), f"usage_{uuid.uuid4().hex}", "complete", scratch(spark, "usage")).select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "hits", F.round("value", 4).alias("value"))


_Z = f"CASE WHEN score < {LIMITS.low} THEN 'rejected' WHEN score >= {LIMITS.accept} THEN 'accepted' WHEN score >= {LIMITS.verify} THEN 'needs_review' ELSE 'rejected' END"
_FIVE = "c5 AS (SELECT * FROM c WHERE ord <= 5)"
_CUT = f"""g AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM r), o AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, doc_id) AS INT) AS rank FROM g WHERE round(top - score, 9) <= {LIMITS.gap})"""

ORACLE_SQL = {
    "pipeline_run": f"""WITH {_SCORES}, {_FIVE}, z AS (SELECT *, {_Z} AS zone FROM c5), r AS (SELECT query_id, doc_id, ord, score FROM z WHERE zone = 'accepted' UNION ALL
        SELECT * FROM (SELECT query_id, doc_id, ord, least(score * (0.5::DOUBLE + (doc_id % 10) / 9.0::DOUBLE), 1.0::DOUBLE) AS score FROM z WHERE zone = 'needs_review') WHERE score >= {LIMITS.accept}), {_CUT}
        SELECT query_id, doc_id, score, rank, 0 AS attempt FROM o WHERE rank <= {LIMITS.top_k}""",
    "pipeline_production": f"""WITH {_SCORES}, {_FIVE}, k AS (SELECT query_id, doc_id, score, ord FROM c5 WHERE query_id % 100 <> 50 UNION ALL SELECT vec_id, vec_id + 7, 0.25::DOUBLE, 0 FROM embeddings WHERE vec_id % {EVERY} = 0 AND vec_id % 100 <> 50),
        b AS (SELECT query_id, doc_id, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, ord DESC) AS n FROM k) WHERE n = 1),
        z AS (SELECT *, {_Z} AS zone, ((query_id * 31 + doc_id * 17) % 101) / 100.0::DOUBLE AS p FROM b),
        r AS (SELECT query_id, doc_id, ord, score FROM z WHERE zone = 'accepted' OR zone = 'needs_review' AND p >= 0.6 UNION ALL
        SELECT * FROM (SELECT query_id, doc_id, ord, least(score * (0.5::DOUBLE + (doc_id % 10) / 9.0::DOUBLE), 1.0::DOUBLE) AS score FROM z WHERE zone = 'needs_review' AND p >= 0.4 AND p < 0.6) WHERE score >= {LIMITS.accept}), {_CUT}
        SELECT query_id, doc_id, score, rank, 0 AS attempt FROM o WHERE rank <= {LIMITS.top_k}""",
    "pipeline_cached": f"""WITH {_SCORES}, {_FIVE}, r AS (SELECT query_id, doc_id, ord, score FROM c5 WHERE score >= {LIMITS.verify} AND query_id % {2 * EVERY} <> 0), {_CUT}
        SELECT query_id, doc_id, score, rank, 0 AS attempt FROM o WHERE rank <= {LIMITS.top_k} UNION ALL SELECT vec_id, vec_id + 1000, 1.0::DOUBLE, 1, -1 FROM embeddings WHERE vec_id % {2 * EVERY} = 0""",
    "light_path": f"""WITH {_SCORES}, t AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM pairs) WHERE n <= 40 AND score >= 0.2)
        SELECT query_id, doc_id, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM t) WHERE round(top - score, 9) <= 0.1""",
    "insights": "SELECT item_id, concat_ws(' ', 'Item ' || item_id || ':', substring(text, 1, 300), 'A, B, C') AS insight FROM benchmark",
    "streaming_usage": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, user_id, count(*) AS hits, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "stratified_folds": "SELECT label, fold, count(*) AS n FROM (SELECT quality::DOUBLE AS label, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS INT) AS fold FROM labels JOIN documents USING (doc_id)) GROUP BY label, fold",
    "verified_with_memo": "SELECT doc_id, CASE WHEN text IS NULL THEN 0.5 ELSE round(least(0.5::DOUBLE * (0.5::DOUBLE + least(9, length(text) - length(replace(text, chr(10), ''))) / 9.0::DOUBLE), 1), 6) END AS score, text IS NOT NULL AS ok FROM documents",
    "weekly_changes": """WITH a AS (SELECT doc_id, trim(text) AS t, lang FROM documents WHERE doc_id % 5 <> 0),
        b AS (SELECT doc_id, trim(CASE WHEN doc_id % 3 = 0 THEN text || ' more' ELSE ' ' || text END) AS t, lang FROM documents WHERE doc_id % 7 <> 0)
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'updated' END AS change
        FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.t IS DISTINCT FROM b.t OR a.lang IS DISTINCT FROM b.lang""",
    "llm_verify_slot": "SELECT item_id, 'Score: ' || (length(text) % 10) AS answer FROM benchmark",
    "hash_embed": "SELECT item_id, 384 AS size, 1.0::DOUBLE AS norm FROM benchmark",
}
_NO_SQL = ("mlp_rerank", "reranker_metrics", "oof_calibration", "feature_importance")
QUERIES = {name: globals()[name] for name in (*ORACLE_SQL, *_NO_SQL)}
