"""Queries of search, triage and evaluation over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import confident
from ..functions.vectors import biased, blend, normalised_search_score
from ..operators import evaluation as ev
from ..operators import search, triage
from ..sources.tables import table

#: Query vectors are those whose id this divides, so their number grows with the table.
EVERY = 50
LIMITS = triage.Thresholds(low=0.15, verify=0.20, accept=0.30, gap=0.20, top_k=5)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _queries(spark, sf):
    return _vectors(spark, sf).where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def candidates(spark, sf, k: int = 10) -> DataFrame:
    return search.vector_topk(_vectors(spark, sf), _queries(spark, sf), k)


def _keyword(spark, sf):
    """Stand-in keyword hits: vectors that share the query's label, every seventh of them."""
    docs = _vectors(spark, sf).where(F.col("doc_id") % 7 == 0).select("doc_id", "label")
    q = _queries(spark, sf).select("query_id", F.col("query_label").alias("label"))
    return docs.join(q, "label").where("doc_id <> query_id").select("query_id", "doc_id")


def _probability(df: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model's probability."""
    return df.withColumn("p", F.pmod(F.col("query_id") * 31 + F.col("doc_id") * 17, F.lit(101)) / 100.0)


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf)


def vector_topk_filtered(spark, sf):
    return search.vector_topk(_vectors(spark, sf).where("label IN (1, 3, 5)"), _queries(spark, sf), 10)


def child_doc_merge(spark, sf):
    """Labels are documents: every fifth vector is the document's own, the others are its children."""
    v, q = _vectors(spark, sf), _queries(spark, sf)
    own = search.vector_topk(v.where("doc_id % 5 = 0"), q, 40).join(v.select("doc_id", "label"), "doc_id")
    own = own.groupBy("query_id", F.col("label").cast("long").alias("doc_id")).agg(F.max("score").alias("score"))
    kids = search.vector_topk(v.where("doc_id % 5 <> 0"), q, 10).join(v.select("doc_id", "label"), "doc_id")
    kids = kids.select("query_id", F.col("label").cast("long").alias("doc_id"), "score")
    return search.merge_children(own, kids, 5).select("query_id", "doc_id", "doc_score", "child_score", "score", "ord")


def triage_zones(spark, sf):
    return triage.classified(candidates(spark, sf), LIMITS)


def zone_counts(spark, sf):
    return triage_zones(spark, sf).groupBy("query_id", "zone").agg(F.count(F.lit(1)).alias("n"))


def prob_zones(spark, sf):
    rows = triage.by_probability(_probability(candidates(spark, sf)))
    return rows.select("query_id", "doc_id", "p", "zone", confident(F.col("p")).alias("confident"))


def gap_filter(spark, sf):
    return triage.within_gap(candidates(spark, sf), 0.05)


def score_gap_from_top(spark, sf):
    top = F.max("score").over(Window.partitionBy("query_id"))
    return candidates(spark, sf).select("query_id", "doc_id", F.round(top - F.col("score"), 6).alias("gap"), (F.col("ord") - 1).alias("score_rank"))


def triage_apply(spark, sf):
    """The whole chain with a review that adds 0.1."""
    return triage.applied(candidates(spark, sf), LIMITS, lambda d: d.withColumn("score", F.round(F.col("score") + 0.1, 6))).select("query_id", "doc_id", "score", "zone", "rank")


def _two_lists(spark, sf):
    a = candidates(spark, sf).select("query_id", "doc_id", "score", F.lit(0).alias("source_ord"), "ord")
    w = Window.partitionBy("query_id").orderBy("doc_id")
    b = _keyword(spark, sf).select("query_id", "doc_id", F.lit(0.3).alias("score"), F.lit(1).alias("source_ord"), F.row_number().over(w).alias("ord"))
    return a.unionByName(b)


def dedupe_keep_best(spark, sf):
    return triage.keep_best(_two_lists(spark, sf), ["query_id", "doc_id"])


def combine_first_seen(spark, sf):
    return triage.keep_first(_two_lists(spark, sf), ["query_id", "doc_id"])


def keyword_union_boost(spark, sf):
    out = triage.keyword_union(candidates(spark, sf), _keyword(spark, sf))
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def keyword_alias_gate(spark, sf):
    hits = _keyword(spark, sf).withColumn("hit", F.lit(True))
    rows = candidates(spark, sf).join(hits, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.col("score").alias("semantic"), F.coalesce("hit", F.lit(False)).alias("hit"), F.when(F.col("doc_id") % 3 == 0, 0.02).alias("bias"))
    return triage.gated(rows, search=0.30, verify=0.25, low=0.20, keyword_score=0.28).select("query_id", "doc_id", "total", "gate")


def bias_clamp(spark, sf):
    rows = candidates(spark, sf)
    return rows.select("query_id", "doc_id", F.round(biased(F.col("score"), F.when(F.col("doc_id") % 2 == 0, 0.9)), 6).alias("score"))


def search_score_scale(spark, sf):
    rows = table(spark, sf, "events").select("event_id", normalised_search_score(F.when(F.col("event_id") % 11 != 0, F.col("value"))).alias("score"))
    return rows.withColumn("score", F.round("score", 6))


def _judged(spark, sf):
    v, q = _vectors(spark, sf).select("doc_id", "label"), _queries(spark, sf).select("query_id", F.col("query_label").alias("label"))
    return ev.judged_by_class(candidates(spark, sf), v, q)


def ranking_metrics(spark, sf):
    out = ev.ranking_metrics(_judged(spark, sf))
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def metrics_by_group(spark, sf):
    per = ev.ranking_metrics(_judged(spark, sf)).join(_queries(spark, sf).select("query_id", F.col("query_label").alias("domain")), "query_id")
    cells = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("rr", "p_at_5", "recall_at_10", "ndcg_at_10")]
    return per.rollup("domain").agg(*cells, F.count(F.lit(1)).alias("n"))


def ablation(spark, sf):
    """Seven strategies over the same candidates: how many results and judgements each query takes."""
    rows = _probability(candidates(spark, sf)).withColumn("blend", F.round(blend(F.col("score"), F.col("p")), 6))
    s, p, t = F.col("score"), F.col("p"), LIMITS
    keep = {
        1: (F.lit(True), F.lit(False)),
        2: (F.lit(True), F.lit(False)),
        3: (s >= t.verify, (s >= t.verify) & (s < t.accept)),
        4: (p >= 0.4, F.lit(False)),
        5: (p >= 0.4, (p >= 0.4) & (p < 0.6)),
        6: (s >= t.accept, F.lit(False)),
        7: ((p >= 0.6) | (s >= t.accept) | ((p >= 0.4) & (s >= t.verify)), ~((p >= 0.6) | (s >= t.accept)) & (p >= 0.4) & (s >= t.verify)),
    }
    found = None
    for k, (kept, asked) in keep.items():
        each = rows.groupBy("query_id").agg(F.count_if(kept).alias("kept"), F.count_if(asked).alias("llm_calls"), F.count(F.lit(1)).alias("n"))
        results = F.when((F.col("kept") == 0) & F.lit(k in (4, 5, 7)), F.least(F.lit(5), F.col("n"))).otherwise(F.col("kept"))
        part = each.select(F.lit(k).alias("strategy"), "query_id", results.cast("long").alias("results"), "llm_calls")
        found = part if found is None else found.unionByName(part)
    return found


def ablation_blend_rank(spark, sf):
    rows = _probability(candidates(spark, sf)).withColumn("blend", F.round(blend(F.col("score"), F.col("p")), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("blend"), "doc_id")
    return rows.select("query_id", "doc_id", "blend", F.row_number().over(w).alias("rank"))


def brier_ece(spark, sf):
    rows = table(spark, sf, "labels").select((F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("p"), F.col("quality").cast("double").alias("y"))
    out = ev.calibration(rows)
    return out.select(F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"), "n")


def threshold_grid(spark, sf):
    rows = table(spark, sf, "labels").select((F.col("doc_id") % 4).alias("domain"), (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("p"), F.col("quality").alias("y"))
    return ev.threshold_grid(rows)


def latency_percentiles(spark, sf):
    out = ev.percentiles(table(spark, sf, "events"), "value", ["event_type"])
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def _kind():
    """A stand-in kind of call for each event."""
    k = F.pmod("event_id", F.lit(3))
    return F.when(k == 0, "embed").when(k == 1, "rerank").otherwise("summary")


def cost_summary(spark, sf):
    calls = table(spark, sf, "events").groupBy("user_id", _kind().alias("kind")).agg(F.count(F.lit(1)).alias("calls"))
    each = calls.withColumn("usd", ev.call_cost(F.col("kind"), F.col("calls")))
    return each.groupBy("user_id").agg(F.sum("calls").alias("calls"), F.sum(F.when(F.col("kind") == "rerank", F.col("calls")).otherwise(0)).alias("reranks"), F.round(F.sum("usd"), 6).alias("usd"))


def cost_projection(spark, sf):
    per = table(spark, sf, "events").select(_kind().alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("calls"))
    total = per.agg((F.sum(ev.call_cost(F.col("kind"), F.col("calls"))) / F.sum("calls")).alias("each"))
    return total.select(F.explode(F.array(*map(F.lit, (1000, 10000, 100000)))).alias("volume"), "each").select("volume", F.round(F.col("volume") * F.col("each") * 30, 4).alias("monthly_usd"))


def cache_hit_rate(spark, sf):
    e = table(spark, sf, "events").withColumn("kind", _kind())
    per = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("event_type") == "view").alias("hits"))
    return per.withColumn("hit_rate", F.round(F.try_divide("hits", "queries"), 6))


_SCORES = f"""q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe, label AS query_label FROM embeddings WHERE vec_id % {EVERY} = 0),
 pairs AS (SELECT query_id, vec_id AS doc_id, label, query_label, round(list_cosine_similarity(qe, embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> query_id),
 c AS (SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS ord FROM pairs) WHERE ord <= 10)"""
_KEYWORD = "k AS (SELECT query_id, doc_id FROM pairs WHERE doc_id % 7 = 0 AND label = query_label)"
_P = "pr AS (SELECT *, ((query_id * 31 + doc_id * 17) % 101) / 100.0::DOUBLE AS p FROM c)"
_ZONE = f"CASE WHEN score < {LIMITS.low} THEN 'rejected' WHEN score >= {LIMITS.accept} THEN 'accepted' WHEN score >= {LIMITS.verify} THEN 'needs_review' ELSE 'rejected' END"
_CUTS = (1, 3, 5, 10)
_METRICS = """j AS (SELECT c.query_id, c.ord, CAST(p.label = p.query_label AS INT) AS rel FROM c JOIN pairs p USING (query_id, doc_id)),
 n AS (SELECT q.query_id, any_value(q.query_label) AS domain, count(p.doc_id) FILTER (p.label = p.query_label) AS n_rel FROM q LEFT JOIN pairs p USING (query_id) GROUP BY 1),
 ideal AS (SELECT n_rel, k, sum(1 / log2(i + 1)) AS best FROM (SELECT DISTINCT n_rel FROM n), (VALUES (1), (3), (5), (10)) v(k), range(1, 11) r(i) WHERE i <= least(k, greatest(n_rel, 1)) GROUP BY 1, 2),
 m AS (SELECT query_id, domain, n_rel, coalesce(max(CASE WHEN rel = 1 THEN 1.0::DOUBLE / ord END), 0) AS rr, """ + ", ".join(
    f"sum(CASE WHEN ord <= {k} THEN rel ELSE 0 END) / {k}::DOUBLE AS p_at_{k}, CASE WHEN n_rel = 0 THEN 1 ELSE sum(CASE WHEN ord <= {k} THEN rel ELSE 0 END) / n_rel::DOUBLE END AS recall_at_{k}, CASE WHEN n_rel = 0 THEN 0 ELSE sum(CASE WHEN ord <= {k} THEN rel / log2(ord + 1) ELSE 0 END) / (SELECT best FROM ideal i WHERE i.n_rel = n.n_rel AND i.k = {k}) END AS ndcg_at_{k}" for k in _CUTS
) + " FROM n JOIN j USING (query_id) GROUP BY query_id, domain, n_rel)"
_KIND_SQL = "CASE event_id % 3 WHEN 0 THEN 'embed' WHEN 1 THEN 'rerank' ELSE 'summary' END"
_USD = "CASE kind WHEN 'embed' THEN calls * 0.00000768::DOUBLE WHEN 'rerank' THEN calls * 0.00175::DOUBLE ELSE calls * 0.00675::DOUBLE END"
_LISTS = f"""{_SCORES}, {_KEYWORD}, u AS (SELECT query_id, doc_id, score, 0 AS source_ord, ord FROM c UNION ALL
 SELECT query_id, doc_id, 0.3::DOUBLE, 1, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INT) FROM k)"""


def _topk_sql(where: str, k: int) -> str:
    return f"SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS ord FROM pairs WHERE {where}) WHERE ord <= {k}"


_STRATEGIES = {
    1: ("true", "false"), 2: ("true", "false"), 3: ("score >= 0.20", "score >= 0.20 AND score < 0.30"), 4: ("p >= 0.4", "false"), 5: ("p >= 0.4", "p >= 0.4 AND p < 0.6"),
    6: ("score >= 0.30", "false"), 7: ("p >= 0.6 OR score >= 0.30 OR (p >= 0.4 AND score >= 0.20)", "NOT (p >= 0.6 OR score >= 0.30) AND p >= 0.4 AND score >= 0.20"),
}

ORACLE_SQL = {
    "vector_topk": f"WITH {_SCORES} SELECT * FROM c",
    "vector_topk_filtered": f"WITH {_SCORES} {_topk_sql('label IN (1, 3, 5)', 10)}",
    "child_doc_merge": f"""WITH {_SCORES}, own AS ({_topk_sql('doc_id % 5 = 0', 40)}), kids AS ({_topk_sql('doc_id % 5 <> 0', 10)}),
        o AS (SELECT own.query_id, label::BIGINT AS doc_id, max(own.score) AS doc_score FROM own JOIN pairs USING (query_id, doc_id) GROUP BY 1, 2),
        s AS (SELECT kids.query_id, label::BIGINT AS doc_id, max(kids.score) AS child_score FROM kids JOIN pairs USING (query_id, doc_id) GROUP BY 1, 2),
        b AS (SELECT query_id, doc_id, doc_score, child_score, coalesce(child_score, doc_score) AS score FROM o FULL JOIN s USING (query_id, doc_id))
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS ord FROM b) WHERE ord <= 5""",
    "triage_zones": f"WITH {_SCORES} SELECT *, {_ZONE} AS zone FROM c",
    "zone_counts": f"WITH {_SCORES} SELECT query_id, {_ZONE} AS zone, count(*) AS n FROM c GROUP BY ALL",
    "prob_zones": f"WITH {_SCORES}, {_P} SELECT query_id, doc_id, p, CASE WHEN p >= 0.6 THEN 'accepted' WHEN p < 0.4 THEN 'rejected' ELSE 'needs_review' END AS zone, p <= 0.4 OR p >= 0.6 AS confident FROM pr",
    "gap_filter": f"WITH {_SCORES} SELECT query_id, doc_id, score, ord FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM c) WHERE round(top - score, 9) <= 0.05",
    "score_gap_from_top": f"WITH {_SCORES} SELECT query_id, doc_id, round(max(score) OVER (PARTITION BY query_id) - score, 6) AS gap, ord - 1 AS score_rank FROM c",
    "triage_apply": f"""WITH {_SCORES}, z AS (SELECT *, {_ZONE} AS zone FROM c), r AS (SELECT query_id, doc_id, ord, zone, CASE WHEN zone = 'accepted' THEN score ELSE round(score + 0.1, 6) END AS score FROM z WHERE zone <> 'rejected'),
        g AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM r)
        SELECT * FROM (SELECT query_id, doc_id, score, zone, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, doc_id) AS INT) AS rank FROM g WHERE round(top - score, 9) <= {LIMITS.gap}) WHERE rank <= {LIMITS.top_k}""",
    "dedupe_keep_best": f"WITH {_LISTS} SELECT query_id, doc_id, score, source_ord, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, source_ord, ord) AS n FROM u) WHERE n = 1",
    "combine_first_seen": f"WITH {_LISTS} SELECT query_id, doc_id, score, source_ord, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY source_ord, ord) AS n FROM u) WHERE n = 1",
    "keyword_union_boost": f"WITH {_SCORES}, {_KEYWORD} SELECT query_id, doc_id, round(CASE WHEN c.score IS NULL THEN 0.70::DOUBLE WHEN k.query_id IS NOT NULL THEN least(1.0::DOUBLE, c.score + 0.05) ELSE c.score END, 6) AS score FROM c FULL JOIN k USING (query_id, doc_id)",
    "keyword_alias_gate": f"""WITH {_SCORES}, {_KEYWORD}, t AS (SELECT query_id, doc_id, c.score AS semantic, round((CASE WHEN k.doc_id IS NOT NULL THEN greatest(c.score, 0.28) ELSE c.score END) + (CASE WHEN c.doc_id % 3 = 0 THEN 0.02 ELSE 0 END), 6) AS total FROM c LEFT JOIN k USING (query_id, doc_id))
        SELECT query_id, doc_id, total, CASE WHEN total >= 0.30 AND semantic >= 0.20 THEN 'accept' WHEN (semantic >= 0.10 AND semantic < 0.20) OR total >= 0.25 THEN 'verify' ELSE 'drop' END AS gate FROM t""",
    "bias_clamp": f"WITH {_SCORES} SELECT query_id, doc_id, round(greatest(0, least(1, score + CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0 END)), 6)::DOUBLE AS score FROM c",
    "search_score_scale": "SELECT event_id, round(CASE WHEN event_id % 11 = 0 THEN 0.5 WHEN value > 1 THEN least(value / 10, 1) ELSE value END, 6) AS score FROM events",
    "ranking_metrics": f"WITH {_SCORES}, {_METRICS} SELECT query_id, round(rr, 6) AS rr, " + ", ".join(f"round({m}_at_{k}, 6) AS {m}_at_{k}" for k in _CUTS for m in ("p", "recall", "ndcg")) + " FROM m",
    "metrics_by_group": f"WITH {_SCORES}, {_METRICS} SELECT domain, round(avg(rr), 6) AS mean_rr, round(avg(p_at_5), 6) AS mean_p_at_5, round(avg(recall_at_10), 6) AS mean_recall_at_10, round(avg(ndcg_at_10), 6) AS mean_ndcg_at_10, count(*) AS n FROM m GROUP BY ROLLUP (domain)",
    "ablation": f"WITH {_SCORES}, {_P} " + " UNION ALL ".join(f"SELECT {k} AS strategy, query_id, CASE WHEN count(*) FILTER ({a}) = 0 AND {str(k in (4, 5, 7)).lower()} THEN least(5, count(*)) ELSE count(*) FILTER ({a}) END AS results, count(*) FILTER ({b}) AS llm_calls FROM pr GROUP BY query_id" for k, (a, b) in _STRATEGIES.items()),
    "ablation_blend_rank": f"WITH {_SCORES}, {_P}, b AS (SELECT query_id, doc_id, round(0.4 * score + 0.6 * p, 6) AS blend FROM pr) SELECT query_id, doc_id, blend, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, doc_id) AS INT) AS rank FROM b",
    "brier_ece": "WITH r AS (SELECT ((doc_id * 37) % 101) / 100.0::DOUBLE AS p, quality::DOUBLE AS y FROM labels), b AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum(pow(p - y, 2)) AS sq FROM r GROUP BY 1) SELECT round(sum(sq) / sum(n), 6) AS brier, round(sum(abs(sy - sp)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b",
    "threshold_grid": """WITH r AS (SELECT doc_id % 4 AS domain, ((doc_id * 37) % 101) / 100.0::DOUBLE AS p, quality AS y FROM labels),
        g AS (SELECT i * 7 + j AS cell, round(0.20 + 0.05 * i, 2)::DOUBLE AS low, round(0.50 + 0.05 * j, 2)::DOUBLE AS high FROM range(6) a(i), range(7) b(j)),
        s AS (SELECT domain, cell, low, high, count(*) AS total, count(*) FILTER (p >= high OR p < low) AS sure, count(*) FILTER ((p >= high AND y = 1) OR (p < low AND y = 0)) AS ok FROM r, g GROUP BY ALL HAVING count(*) >= 10),
        q AS (SELECT domain, cell, low, high, round(0.7 * (CASE WHEN sure > 0 THEN ok / sure::DOUBLE ELSE 0 END) + 0.3 * sure / total::DOUBLE, 9) AS quality FROM s)
        SELECT domain, low, high, quality FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY quality DESC, cell) AS n FROM q) WHERE n = 1""",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY 1",
    "cost_summary": f"WITH k AS (SELECT user_id, {_KIND_SQL} AS kind, count(*) AS calls FROM events GROUP BY ALL) SELECT user_id, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(CASE WHEN kind = 'rerank' THEN calls ELSE 0 END) AS BIGINT) AS reranks, round(sum({_USD}), 6) AS usd FROM k GROUP BY 1",
    "cost_projection": f"WITH k AS (SELECT {_KIND_SQL} AS kind, count(*) AS calls FROM events GROUP BY 1), t AS (SELECT sum({_USD}) / sum(calls) AS each FROM k) SELECT v AS volume, round(v * each * 30, 4) AS monthly_usd FROM t, (VALUES (1000), (10000), (100000)) x(v)",
    "cache_hit_rate": "SELECT user_id, count(*) AS queries, count(*) FILTER (event_type = 'view') AS hits, round(count(*) FILTER (event_type = 'view') / count(*)::DOUBLE, 6) AS hit_rate FROM events GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
