"""Queries of the stored indexes: vectors in lists, weighted fields by block maxima, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text_index, vector_index
from ..operators.vector_index import Collection
from ..sources.tables import table
from .retrieval import _queries, _vectors

#: Weights of the fields, and what stands in for them in ``documents``.
FIELDS = {"title": 3.0, "article": 2.0, "section": 2.0, "summary": 1.0, "text": 0.5}
CASES = {"title": 2.0, "summary": 1.0}
K, LIMIT = 10, 5


def _collections(spark, sf) -> dict[str, Collection]:
    """Three collections of the vectors by remainder: main with children (a label's vectors are its children) and a bias, cases, and asked queries; a fourth is not configured."""
    v = _vectors(spark, sf)
    main = v.where("doc_id % 3 = 0")
    bias = main.where("doc_id % 4 = 0").select("doc_id", F.lit(0.05).alias("bias"))
    children = v.where("doc_id % 3 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("child_id"), "embedding")
    return {"main": Collection(main.select("doc_id", "embedding"), children, bias), "cases": Collection(v.where("doc_id % 3 = 2").select("doc_id", "embedding")), "queries": Collection(v.where(F.col("doc_id") % 50 == 0).select("doc_id", "embedding")), "absent": Collection()}


def collection_search(spark: SparkSession, sf: str) -> DataFrame:
    """All three collections through blocks, which is exact."""
    return vector_index.search_collections(_collections(spark, sf), _queries(spark, sf).select("query_id", "embedding"), K, K, vector_index.block_topk)


def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors by the index, with as many lists as a sample of the queries needs."""
    q = _queries(spark, sf).select("query_id", "embedding")
    index = vector_index.build_index(_vectors(spark, sf).select("doc_id", "embedding"))
    return vector_index.index_topk(index, q, K, vector_index.probes_for(index, q, K))


def indexed_search_all_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors by the index with all lists probed, which is exact."""
    index = vector_index.build_index(_vectors(spark, sf).select("doc_id", "embedding"))
    return vector_index.index_topk(index, _queries(spark, sf).select("query_id", "embedding"), K, len(index.centres))


def _pages(spark, sf):
    """Titles of pages are queries: every fiftieth page asks."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").where("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), title.alias("text"))


def _five(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("article"), F.col("lang").alias("section"), F.substring("text", 1, 200).alias("summary"), "text")


def five_field_search(spark: SparkSession, sf: str) -> DataFrame:
    index = text_index.build_text_index(_five(spark, sf), FIELDS)
    return text_index.scaled(text_index.text_topk(index, _pages(spark, sf), K))


def case_search(spark: SparkSession, sf: str) -> DataFrame:
    """Cases by title and summary; the caller allows the titles of documents with an even id."""
    docs = _five(spark, sf)
    index = text_index.build_text_index(docs, CASES)
    return text_index.search_allowed(index, _pages(spark, sf), docs, docs.where("doc_id % 2 = 0").select("title"), LIMIT)


QUERIES = {
    "collection_search": collection_search,
    "indexed_search": indexed_search,
    "indexed_search_all_lists": indexed_search_all_lists,
    "five_field_search": five_field_search,
    "case_search": case_search,
}

_SIMILAR = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0),
 s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(qe, embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> query_id)"""


def _best(rows: str, k: int, by: str = "query_id") -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS INT) AS ord FROM ({rows}) QUALIFY ord <= {k}"


def _fields_sql(weights: dict[str, float]) -> str:
    column = {"title": r"split_part(text, chr(10), 1)", "article": "source", "section": "lang", "summary": "substr(text, 1, 200)", "text": "text"}
    fields = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {w}::DOUBLE AS w, regexp_extract_all(lower(coalesce({column[f]}, '')), '[\\p{{L}}\\p{{N}}_]+') AS words FROM documents" for f, w in weights.items())
    return f"""f AS ({fields}), st AS (SELECT field, count(*) AS n, avg(len(words)) AS mean FROM f GROUP BY field),
        c AS (SELECT doc_id, field, w, token, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, field, w, unnest(words) AS token, len(words) AS length FROM f) GROUP BY ALL),
        df AS (SELECT field, token, count(*) AS df FROM c GROUP BY ALL),
        q AS (SELECT DISTINCT page_id AS query_id, unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM pages WHERE page_id % 50 = 0),
        h AS (SELECT query_id, doc_id, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {text_index.K1 + 1} / (tf + {text_index.K1} * (1 - {text_index.B} + {text_index.B} * length / mean))), 6) AS score
              FROM q JOIN c USING (token) JOIN df USING (field, token) JOIN st USING (field) GROUP BY query_id, doc_id)"""


ORACLE_SQL = {
    "collection_search": f"""WITH {_SIMILAR}, own AS ({_best("SELECT * FROM s WHERE doc_id % 3 = 0", K)}), kids AS ({_best("SELECT * FROM s WHERE doc_id % 3 = 1", K)}),
        m AS (SELECT coalesce(own.query_id, k.query_id) AS query_id, coalesce(own.doc_id, k.doc_id) AS doc_id, coalesce(k.score, own.score) AS score
              FROM own FULL JOIN (SELECT query_id, doc_id - 1 AS doc_id, max(score) AS score FROM kids GROUP BY ALL) k ON k.query_id = own.query_id AND k.doc_id = own.doc_id),
        u AS (SELECT 'main' AS collection, query_id, doc_id, round(greatest(0, least(1, score + CASE WHEN doc_id % 12 = 0 THEN 0.05 ELSE 0 END)), 6)::DOUBLE AS score FROM m
              UNION ALL SELECT 'cases', query_id, doc_id, score FROM s WHERE doc_id % 3 = 2 UNION ALL SELECT 'queries', query_id, doc_id, score FROM s WHERE doc_id % 50 = 0)
        {_best("SELECT * FROM u", K, "collection, query_id")}""",
    "indexed_search_all_lists": f"WITH {_SIMILAR} {_best('SELECT * FROM s', K)}",
    "five_field_search": f"""WITH {_fields_sql(FIELDS)}, b AS ({_best("SELECT * FROM h WHERE score > 0", K)}), r AS (SELECT query_id, doc_id, ord AS raw, round(CASE WHEN score > 1 THEN least(score / 10, 1) ELSE score END, 6) AS score FROM b)
        SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, raw) AS INT) AS ord FROM r""",
    "case_search": f"""WITH {_fields_sql(CASES)}, b AS ({_best("SELECT * FROM h WHERE score > 0", 2 * LIMIT)}), d AS (SELECT doc_id, lower(trim(split_part(text, chr(10), 1))) AS k FROM documents)
        {_best("SELECT query_id, b.doc_id, score FROM b JOIN d ON d.doc_id = b.doc_id WHERE k <> '' AND k IN (SELECT k FROM d WHERE doc_id % 2 = 0)", LIMIT)}""",
}
