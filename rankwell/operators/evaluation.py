"""Ranking quality, calibration, cost and latency as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prices in USD per million tokens (input, output) and tokens per call.
PRICES = {"embed": (0.06, 0.0), "small": (0.15, 0.60), "large": (2.50, 10.00), "reason": (1.10, 4.40)}
CALL_TOKENS = {"embed": (128, 0), "rerank": (500, 50), "summary": (1500, 300)}


def judged(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """ranked (query_id, doc_id, ord) with rel 0/1 and n_rel; queries with relevant documents but no result are kept."""
    counts = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    hits = relevant.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    rows = ranked.select("query_id", "doc_id", "ord").join(hits, ["query_id", "doc_id"], "left")
    return rows.withColumn("rel", F.coalesce("hit", F.lit(0))).drop("hit").join(counts, "query_id", "full_outer")


def judged_by_class(ranked: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """:func:`judged` where the documents of a query's own class are relevant, the query itself aside.

    docs: doc_id, label. queries: query_id, label. Relevant documents are counted per class and looked up for the ranked rows
    only; pairs of a class are never made.
    """
    sizes = docs.groupBy("label").agg(F.count(F.lit(1)).alias("held"))
    own = queries.join(docs.select(F.col("doc_id").alias("query_id"), F.col("label").alias("as_doc")), "query_id", "left")
    counts = own.join(sizes, "label", "left").select("query_id", F.col("label").alias("asked"), (F.coalesce("held", F.lit(0)) - F.coalesce(F.col("as_doc") == F.col("label"), F.lit(False)).cast("int")).alias("n_rel"))
    rows = ranked.select("query_id", "doc_id", "ord").join(docs.select("doc_id", "label"), "doc_id", "left")
    rows = rows.join(counts, "query_id", "full_outer").where("doc_id IS NOT NULL OR n_rel > 0")
    rel = F.coalesce((F.col("label") == F.col("asked")) & (F.col("doc_id") != F.col("query_id")), F.lit(False)).cast("int")
    return rows.select("query_id", "doc_id", "ord", rel.alias("rel"), "n_rel")


def ranking_metrics(rows: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query: reciprocal rank, and precision, recall and NDCG at the cuts.

    Precision divides by the cut, not by what was returned; without relevant documents
    recall is 1 and NDCG 0.
    """
    rel, n = F.coalesce("rel", F.lit(0)), F.coalesce(F.first("n_rel"), F.lit(0))
    out = [F.coalesce(F.max(F.when(rel == 1, 1.0 / F.col("ord"))), F.lit(0.0)).alias("rr")]
    for k in cuts:
        inside = F.coalesce(F.sum(F.when((F.col("ord") <= k), rel).otherwise(0)), F.lit(0))
        gain = F.coalesce(F.sum(F.when((F.col("ord") <= k), rel / F.log2(F.col("ord") + 1)).otherwise(0.0)), F.lit(0.0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n.cast("int"), F.lit(k)))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
        out.append((inside / F.lit(float(k))).alias(f"p_at_{k}"))
        out.append(F.when(n == 0, F.lit(1.0)).otherwise(inside / n).alias(f"recall_at_{k}"))
        out.append(F.when(n == 0, F.lit(0.0)).otherwise(gain / ideal).alias(f"ndcg_at_{k}"))
    return rows.groupBy("query_id").agg(*out)


def call_cost(kind: Column, calls: Column) -> Column:
    """USD of so many calls of a kind; embed at embedding price, summaries and reranks at the large model's."""
    total = F.lit(0.0)
    for name, (tokens_in, tokens_out) in CALL_TOKENS.items():
        price_in, price_out = PRICES["embed" if name == "embed" else "large"]
        total = F.when(kind == name, calls * F.lit((tokens_in * price_in + tokens_out * price_out) / 1e6)).otherwise(total)
    return total


def percentiles(rows: DataFrame, value: str, by: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact linearly interpolated percentiles, mean, least and most."""
    exact = [F.percentile(value, F.lit(p)).alias(f"p{round(p * 100)}") for p in shares]
    return rows.groupBy(*by).agg(*exact, F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def calibration(rows: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over equal bins; the last bin holds 1.0 as well."""
    each = rows.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int"))
    per = each.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("sq"))
    total = F.sum("n")
    return per.agg((F.sum("sq") / total).alias("brier"), (F.sum(F.abs(F.col("sy") - F.col("sp"))) / total).alias("ece"), total.alias("n"))


def threshold_grid(rows: DataFrame, p: str = "p", y: str = "y", by: str = "domain", least: int = 10) -> DataFrame:
    """Per group the low/high thresholds of best 0.7 * accuracy + 0.3 * coverage; the first of equal ones.

    The grid has 42 cells, which are an array literal: rows are first summed per distinct
    probability, and only those sums are spread over the cells.
    """
    pairs = [(round(0.20 + 0.05 * i, 2), round(0.50 + 0.05 * j, 2)) for i in range(6) for j in range(7)]
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("cell"), F.lit(low).alias("low"), F.lit(high).alias("high")) for k, (low, high) in enumerate(pairs))))
    steps = rows.groupBy(by, p).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    sized = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= least)
    right = F.when(F.col(p) >= F.col("high"), F.col("pos")).when(F.col(p) < F.col("low"), F.col("n") - F.col("pos")).otherwise(0)
    sure = F.when((F.col(p) >= F.col("high")) | (F.col(p) < F.col("low")), F.col("n")).otherwise(0)
    scored = steps.withColumn("c", grid).select(by, p, "n", "pos", "c.*").groupBy(by, "cell", "low", "high").agg(F.sum(right).alias("right"), F.sum(sure).alias("sure")).join(sized, by)
    accuracy = F.when(F.col("sure") > 0, F.col("right") / F.col("sure")).otherwise(0.0)
    scored = scored.withColumn("quality", F.round(0.7 * accuracy + 0.3 * F.col("sure") / F.col("total"), 9))
    w = Window.partitionBy(by).orderBy(F.desc("quality"), "cell")
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(by, "low", "high", "quality")
