"""The fifteen features of a query and a candidate document, for ranked candidates only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bm25, coverage, jaccard, tokens
from ..functions.vectors import cosine

# The features in the order that models expect, and the levels whose presence is counted.
NAMES = ("semantic_score", "bm25_score", "alias_match", "keyword_match", "domain_type", "document_length", "query_length", "section_depth", "embedding_cosine_similarity", "match_type", "score_gap_from_top", "query_term_coverage", "title_similarity", "has_nested_content", "bias_adjustment")
LEVELS = ("title", "article", "chapter", "subchapter", "part", "section")


@dataclass(frozen=True)
class Domain:
    """A collection's number, the columns of its levels (those that it has) and what is added to a title's scores."""

    number: int = 0
    levels: dict[str, str] = field(default_factory=lambda: {x: x for x in LEVELS})
    bias: dict[str, float] = field(default_factory=dict)


def match_type(title: Column, query_words: Column, keywords: Column, aliases: Column) -> Column:
    """2 if the first keyword that meets the title is the title, 1 if it is part of it or holds it; else the same by
    aliases; else 1 for a word in common and 0 for none. A blank title is met by nothing."""
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))

    def first(names: Column) -> Column:
        low = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda m: F.lower(m))
        hit = F.get(F.filter(low, lambda m: F.contains(t, m) | F.contains(m, t)), F.lit(0))
        return F.when(hit == t, 2).when(hit.isNotNull(), 1)

    shared = F.arrays_overlap(query_words, tokens(t)).cast("int")
    return F.when(t == "", 0).otherwise(F.coalesce(first(keywords), first(aliases), shared, F.lit(0)))


def flagged(title: Column, names: Column) -> Column:
    """1 if the title is one of the names, case aside."""
    t = F.lower(title)
    low = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda m: F.lower(m))
    return F.coalesce(F.array_contains(low, t) & (t != ""), F.lit(False)).cast("int")


def featured(rows: DataFrame, domain: Domain = Domain()) -> DataFrame:
    """query_id, doc_id and the fifteen features (NAMES, in order) of every row, 0 where something is missing.

    rows: query_id, doc_id, score, query (text), query_embedding, embedding, title, text, nested (texts of children, or
    null), keywords and aliases (titles that the query names), and the domain's levels. Rows are ranked candidates: the gap is
    taken from the best of those given.
    """
    # one column after the other: what several features use is computed once
    text = F.coalesce("text", F.lit(""))
    parts = F.filter(F.coalesce("nested", F.array().cast("array<string>")), lambda t: t.isNotNull())
    out = rows.withColumn("_query", F.coalesce("query", F.lit(""))).withColumn("_full", F.trim(F.concat_ws(" ", text, F.nullif(F.array_join(parts, " "), F.lit("")))))
    out = out.withColumn("_q", tokens(F.col("_query"))).withColumn("_d", tokens(F.col("_full")))
    levels = [F.col(c).cast("string") for name, c in domain.levels.items() if name in LEVELS]
    depth = sum((F.coalesce(c != "", F.lit(False)).cast("int") for c in levels), F.lit(0))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    pairs = [x for t, b in sorted(domain.bias.items()) for x in (F.lit(t), F.lit(float(b)))]
    bias = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("title")), F.lit(0.0)) if pairs else F.lit(0.0)
    cells = {
        "semantic_score": score,
        "bm25_score": bm25(F.col("_q"), F.col("_d")),
        "alias_match": flagged(F.col("title"), F.col("aliases")),
        "keyword_match": flagged(F.col("title"), F.col("keywords")),
        "domain_type": F.lit(domain.number),
        "document_length": F.log1p(F.length("_full")),
        "query_length": F.length("_query"),
        "section_depth": depth,
        "embedding_cosine_similarity": cosine(F.col("query_embedding"), F.col("embedding")),
        "match_type": match_type(F.col("title"), F.col("_q"), F.col("keywords"), F.col("aliases")),
        "score_gap_from_top": F.max(score).over(Window.partitionBy("query_id")) - score,
        "query_term_coverage": F.when(F.col("_full") == "", F.lit(0.0)).otherwise(coverage(F.col("_q"), F.col("_d"))),
        "title_similarity": jaccard(F.col("_q"), tokens(F.col("title"))),
        "has_nested_content": F.coalesce(F.size("nested") > 0, F.lit(False)).cast("int"),
        "bias_adjustment": bias,
    }
    return out.select("query_id", "doc_id", *(cells[name].cast("double").alias(name) for name in NAMES))


def vectors(rows: DataFrame) -> DataFrame:
    """query_id, doc_id, vector: the features as an array in their order, missing ones 0."""
    return rows.select("query_id", "doc_id", F.array(*(F.coalesce(name, F.lit(0.0)) for name in NAMES)).alias("vector"))
