"""Retrieval: exact vector search, parent-child merging and full-text scores for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens
from .vector_index import CELLS, best_pairs, block_topk, result_schema, units

#: Queries in one broadcast; larger sets of queries are not broadcast.
QUERY_BLOCK = 4096
#: Scores are compared at this many decimals, so that ties do not hang on the last bit.
DECIMALS = 6


def best_first(k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id"):
    """A transform that keeps the k best rows of each query with their 1-based ``ord``."""

    def cut(df: DataFrame) -> DataFrame:
        w = Window.partitionBy(by).orderBy(F.desc(score), tie)
        return df.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k)

    return cut


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, decimals: int = DECIMALS) -> DataFrame:
    """query_id, doc_id, score, ord: the k corpus vectors of highest cosine for each query.

    corpus: doc_id, embedding. queries: query_id, embedding. Up to ``QUERY_BLOCK`` queries are broadcast: each
    Arrow batch of the corpus is multiplied with them and gives its own k best. More queries meet the corpus in
    blocks (:func:`.vector_index.block_topk`). Either way what is shuffled is k rows per query and batch, never a row
    per pair. Ids are of any type; those of the corpus are distinct.
    Null ids, null vectors and those of another size or with a null in them are left out.
    """
    spark, schema = corpus.sparkSession, result_schema(corpus, queries)
    asked = queries.select("query_id", "embedding").where("embedding IS NOT NULL").limit(QUERY_BLOCK + 1).collect()
    if not asked:
        return spark.createDataFrame([], schema).transform(best_first(k))
    if len(asked) > QUERY_BLOCK:
        return block_topk(corpus, queries, k, exclude_self, decimals)
    shared = spark.sparkContext.broadcast(([r[0] for r in asked], units(np.array([list(r[1]) for r in asked], np.float64))))
    query_type = to_arrow_type(queries.schema["query_id"].dataType)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        names = pa.array(names, query_type)
        for whole in batches:
            # a batch of very wide vectors is taken in parts
            rows = max(1, CELLS // max(1, q.shape[1]))
            for at in range(0, whole.num_rows, rows):
                ids, found = whole.slice(at, rows).columns
                fits = pc.and_(ids.is_valid(), pc.fill_null(pc.equal(pc.list_value_length(found), q.shape[1]), False))
                ids, found = ids.filter(fits), found.filter(fits)
                m = np.asarray(pc.list_flatten(found).to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), q.shape[1])
                sound = np.isfinite(m).all(1)
                ids, m = ids.filter(pa.array(sound)), m[sound]
                if len(ids):
                    for best in best_pairs(names, q, ids, units(m), k, exclude_self, decimals):
                        yield pa.RecordBatch.from_arrays(best, schema.names)

    return corpus.select("doc_id", "embedding").mapInArrow(score, schema).transform(best_first(k))


def merge_children(docs: DataFrame, children: DataFrame, k: int) -> DataFrame:
    """Document hits and child hits on one list: a document with a child hit takes the child's score, even if it is lower."""
    best = children.groupBy("query_id", "doc_id").agg(F.max("score").alias("child_score"))
    both = docs.select("query_id", "doc_id", F.col("score").alias("doc_score")).join(best, ["query_id", "doc_id"], "full_outer")
    return both.withColumn("score", F.coalesce("child_score", "doc_score")).transform(best_first(k))


def fulltext_scores(queries: DataFrame, docs: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """query_id, doc_id, score, ord: weighted counts of the queries' distinct tokens in the documents' fields.

    An inverted-index join on tokens; a token's rows are pre-aggregated per document, and
    adaptive execution splits the tokens that very many documents hold.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    wanted = asked.select("token").distinct()
    # tokens that nobody asks for are left out before they are counted
    fields = [docs.select("doc_id", F.explode(tokens(F.col(f))).alias("token"), F.lit(float(w)).alias("w")).join(wanted, "token", "left_semi") for f, w in weights.items()]
    counted = fields[0]
    for other in fields[1:]:
        counted = counted.unionByName(other)
    counted = counted.groupBy("doc_id", "token").agg(F.sum("w").alias("w"))
    # queries are the small side, but their size is theirs to prove: the optimizer picks broadcast by size
    return counted.join(asked, "token").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), DECIMALS).alias("score")).transform(best_first(k))


def term_matches(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, average: float = 2000.0) -> DataFrame:
    """query_id, doc_id, bm25, matched: each pair that shares a token, its term-frequency relevance and its number of shared distinct tokens.

    queries: query_id, q; docs: doc_id, d (token arrays, distinct ids). Tokens that nobody asks
    for never leave their task, and the others are counted per document before they are joined.
    """
    asked = queries.select("query_id", F.explode("q").alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("wanted"))
    held = docs.select("doc_id", F.size("d").alias("length"), F.explode("d").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    held = held.groupBy("doc_id", "length", "token").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average))
    return held.join(asked, "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("wanted") * part).alias("bm25"), F.count(F.lit(1)).alias("matched"))


def restricted(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the caller's list, compared without case."""
    names = allowed.select(F.lower(key).alias("__k")).distinct()
    return rows.join(names, F.lower(rows[key]) == names["__k"], "left_semi")


def lookup_newest(rows: DataFrame, wanted: DataFrame, title: str, newest: str) -> DataFrame:
    """For each wanted title (columns title, ord) the newest row whose title is equal but for case and spacing."""
    key = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    w = Window.partitionBy("__k").orderBy(F.desc(newest))
    found = rows.withColumn("__k", key(F.col(title))).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    asked = wanted.select(key(F.col("title")).alias("__k"), "ord").groupBy("__k").agg(F.min("ord").alias("ord"))
    return found.join(asked, "__k").drop("__k")
