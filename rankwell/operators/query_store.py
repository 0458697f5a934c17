"""What is stored with a query: results of any of five forms, and insights at their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, normalised, strip

CASES = "array<struct<case_id: string, case: string, from_ref: string>>"


def _read(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _id(v: Column, path: str) -> Column:
    """An id as text: plain, or an object id (``{"$oid": ...}``)."""
    return F.nullif(F.coalesce(_read(v, f"{path}['$oid']"), F.when(~F.startswith(F.schema_of_variant(F.coalesce(_read(v, path, "variant"), F.parse_json(F.lit("null")))), F.lit("OBJECT")), _read(v, path))), F.lit(""))


def coerced(rows: DataFrame, result: str) -> DataFrame:
    """``rows`` with knowledge_id, title, cases and score of the JSON in ``result``, which is left out.

    Forms: [document, score], [id, score], document, id (``{"$oid": ...}``) and a bare title. A document's title is the first
    of title, article, section, summary and text that is not blank. Of its cases those stay that come from that
    title or say nothing of it; a bare case only if it is the title. Anything else is null.
    """
    kept = [c for c in rows.columns if c != result]
    out = rows.select(*kept, F.try_parse_json(F.col(result)).alias("_v"))
    out = out.withColumn("_pair", F.startswith(F.schema_of_variant("_v"), F.lit("ARRAY")))
    out = out.withColumn("_d", F.when(F.col("_pair"), _read(F.col("_v"), "$[0]", "variant")).otherwise(F.col("_v")))
    kind, d = F.schema_of_variant("_d"), F.col("_d")
    out = out.withColumn("_object", F.startswith(kind, F.lit("OBJECT")) & _read(d, "$['$oid']").isNull()).withColumn("_bare", F.when((kind == "STRING") & ~F.col("_pair"), _read(d, "$")))
    titles = [blank_to_null(_read(d, f"$.{x}")) for x in ("title", "article", "section", "summary", "text")]
    out = out.withColumn("title", F.when(F.col("_object"), F.coalesce(*titles)).otherwise(F.nullif(F.col("_bare"), F.lit(""))))
    score = F.when(F.col("_pair"), _read(F.col("_v"), "$[1]", "double")).when(F.col("_object"), _read(d, "$.score", "double"))
    own = F.when(F.col("_object"), _id(d, "$._id")).otherwise(_read(d, "$['$oid']"))

    def case(c: Column) -> Column:
        bare, source = F.when(F.schema_of_variant(c) == "STRING", _read(c, "$")), blank_to_null(_read(c, "$.from_ref"))
        row = F.struct(_id(c, "$._id").alias("case_id"), F.coalesce(_read(c, "$.case"), bare).alias("case"), source.alias("from_ref"))
        fits = F.when(bare.isNotNull(), strip(bare) == F.col("title")).otherwise(source.isNull() | (source == F.col("title")))
        return F.when(fits & (row["case_id"].isNotNull() | row["case"].isNotNull() | source.isNotNull()), row)

    cases = F.array_compact(F.transform(_read(d, "$.cases", "array<variant>"), case))
    cases = F.when(F.col("_object") & F.col("title").isNotNull() & (F.size(cases) > 0), cases)
    return out.select(*kept, own.alias("knowledge_id"), "title", cases.cast(CASES).alias("cases"), score.alias("score"))


def results_appended(stored: DataFrame, new: DataFrame) -> DataFrame:
    """query, knowledge_id, collection_key, title, cases, score, ord: stored results with new ones behind them.

    Queries are the same but for case and space. A result with an id is stored once per collection; one without an id (a title) is
    stored once per title. What was there first stays; places count from 0.
    """
    cells = ["knowledge_id", "collection_key", "title", "cases", "score"]
    rows = stored.select("query", *cells, "ord", F.lit(0).alias("_new")).unionByName(new.select("query", *cells, "ord", F.lit(1).alias("_new")))
    rows = rows.withColumn("query", normalised(F.col("query"))).withColumn("_key", F.coalesce(F.concat(F.lit("i"), "knowledge_id"), F.concat(F.lit("t"), "title"), F.lit("")))
    w = Window.partitionBy("query", "_key", F.when(F.col("knowledge_id").isNotNull(), F.col("collection_key"))).orderBy("_new", "ord")
    place = Window.partitionBy("query").orderBy("_new", "ord")
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return rows.withColumn("_place", F.row_number().over(place) - 1).select("query", *cells, F.col("_place").alias("ord"))


def insights_saved(insights: DataFrame, results: DataFrame) -> DataFrame:
    """query, index, text_en, text_es, text_norm: the last insight at each place of a query's results.

    insights: query, index, text, language, text_en, text_es, at (and id for ties). results: query, n (how many are
    stored). Indexes beyond the results are left out, and so are negative ones; a query without stored results has no bounds.
    A language's own text stands in where the insight is in that language.
    """
    rows = insights.join(results.select("query", "n"), "query", "left").where("index >= 0 AND (n IS NULL OR index < n)")
    w = Window.partitionBy("query", "index").orderBy(F.desc("at"), F.desc("id"))
    last = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    of = lambda code: F.coalesce(blank_to_null(F.col(f"text_{code}")), F.when(F.col("language") == code, strip(F.coalesce("text", F.lit(""))))).alias(f"text_{code}")
    return last.select("query", "index", of("en"), of("es"), normalised(F.coalesce("text", F.lit(""))).alias("text_norm"))
