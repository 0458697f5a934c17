"""Queries of stored edges, logs, files and grouped or repaired records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cited_regulations, clause_number, repaired_clauses
from ..operators.documents import DocumentConfig, ancestors_of_path, grouped_sections
from ..operators.graph import linked
from ..operators.query_store import coerced, insights_saved, results_appended
from ..sources.tables import question_csv, table
from ..sources.writers import append_log, scratch, write_rows


def rephrase_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer points to the next one; each third is linked anew, some of them to themselves."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("src"))
    new = c.where("src % 3 = 0").select("src", (F.col("src") + (F.col("src") % 2) * 5).alias("dst"))
    return linked(c.select("src", (F.col("src") + 1).alias("dst")), new)


def question_file(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with quotes, commas and line ends, written to a file and read from it."""
    p = table(spark, sf, "part")
    question = F.concat("p_name", F.lit(', "'), "p_type", F.lit('"'))
    related = F.concat("p_brand", F.lit(" , ,"), "p_type")
    path = scratch(spark, "questions")
    p.select(question.alias("question"), F.col("p_size").alias("level"), related.alias("related")).write.csv(path, header=True, quote='"', escape='"')
    return question_csv(spark, path).select("question", "level", F.array_join("topics", "|").alias("topics"))


def appended_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Two days of events, appended to one log, which comes back whole."""
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    path = scratch(spark, "log")
    append_log(e.where("event_id % 2 = 0"), path)
    return append_log(e.where("event_id % 2 = 1"), path)


def orc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier rows through a columnar file of another kind."""
    return write_rows(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), scratch(spark, "orc"), "orc")


def order_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of equal orders as one record with its sections in the order of their numbers."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.array(F.struct(F.concat(F.lit("No "), F.col("l_linenumber").cast("string")).alias("number"), F.col("l_partkey").cast("string").alias("text"))).alias("sections"))
    rows = grouped_sections(lines, ["l_orderkey"], "l_returnflag", "sections")
    return rows.select("l_orderkey", F.col("l_returnflag").alias("flag"), F.array_join(F.transform("sections", lambda s: F.concat(s["number"], F.lit(":"), s["text"])), "|").alias("sections"))


def clause_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents and pages' menu words as clauses, without blank ones and menus, at most 100 characters each."""
    d = table(spark, sf, "documents")
    clauses = F.concat(F.array(F.lit(" Home "), F.lit("NEXT")), F.split("text", "\n", -1))
    fixed = repaired_clauses(F.transform(clauses, lambda t: F.struct(t.alias("text"))), most=100)
    return d.select("doc_id", F.size(fixed).cast("long").alias("n"), F.sha2(F.array_join(F.transform(fixed, lambda c: c["text"]), "\n"), 256).alias("clauses_sha256"))


def part_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Depth, path, ancestors and bias of parts in the hierarchy of brand, type and size."""
    p = table(spark, sf, "part").withColumn("p_type", F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")))
    config = DocumentConfig(hierarchy=("p_brand", "p_type", "p_size"), bias={"Brand#1": 0.1, "Brand#2": -0.05})
    path = config.path(p)
    return p.select("p_partkey", config.depth(p).alias("depth"), path.alias("path"), F.array_join(ancestors_of_path(F.concat(path, F.lit(" / / x"))), "|").alias("ancestors"), config.bias_of(F.col("p_brand")).alias("bias"))


def _results(spark, sf) -> DataFrame:
    """A result of one of five forms per document."""
    k, key = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    title = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    cases = F.array(F.struct(key.alias("_id"), F.lit("A v. B").alias("case"), F.concat(F.lit(" "), "source", F.lit(" ")).alias("from_ref")), F.struct(F.lit(None).cast("string").alias("_id"), F.lit("C v. D").alias("case"), F.lit("other").alias("from_ref")), F.struct(F.lit(None).cast("string").alias("_id"), F.lit("E v. F").alias("case"), F.lit(None).cast("string").alias("from_ref")))
    doc = F.struct(key.alias("_id"), title.alias("title"), F.lit(" ").alias("article"), F.col("lang").alias("section"), F.when(F.col("doc_id") % 2 == 0, cases).alias("cases"))
    made = F.to_json(doc)
    oid = F.concat(F.lit('{"$oid": "x'), key, F.lit('"}'))
    pair = lambda x: F.concat(F.lit("["), x, F.lit(", 0.5]"))
    json = F.when(k == 0, pair(made)).when(k == 1, pair(oid)).when(k == 2, made).when(k == 3, oid).otherwise(F.concat(F.lit('"'), "source", F.lit('"')))
    return table(spark, sf, "documents").select("doc_id", "lang", json.alias("json"))


def coerced_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = coerced(_results(spark, sf), "json")
    named = F.array_join(F.transform("cases", lambda c: F.concat_ws("/", F.coalesce(c["case_id"], F.lit("-")), c["case"], F.coalesce(c["from_ref"], F.lit("-")))), "|")
    return rows.select("doc_id", "knowledge_id", "title", named.alias("cases"), "score")


def appended_query_results(spark: SparkSession, sf: str) -> DataFrame:
    """A query per language; half of the results are stored, and all come again."""
    rows = coerced(_results(spark, sf), "json").select(F.col("lang").alias("query"), "knowledge_id", F.lit("set").alias("collection_key"), "title", "cases", "score", F.col("doc_id").alias("ord"))
    new = rows.withColumn("query", F.concat(F.lit(" "), F.upper("query")))
    out = results_appended(rows.where("ord % 2 = 0"), new)
    return out.select("query", F.coalesce("knowledge_id", F.lit("-")).alias("knowledge_id"), "title", F.col("ord").cast("long").alias("ord"))


def bounded_insights(spark: SparkSession, sf: str) -> DataFrame:
    """Events are insights at places from 0 to 6 of a user's results; users have fewer results than that, and some none stored."""
    e = table(spark, sf, "events")
    lang = F.when(F.col("event_id") % 3 == 0, "es").otherwise("en")
    rows = e.select(F.col("user_id").cast("string").alias("query"), (F.col("event_id") % 8 - 1).cast("int").alias("index"), F.concat(F.lit(" "), F.upper("event_type")).alias("text"), lang.alias("language"), F.lit(None).cast("string").alias("text_en"), F.when(F.col("event_id") % 5 == 0, "hola ").alias("text_es"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    results = e.where("user_id % 4 <> 0").select(F.col("user_id").cast("string").alias("query"), (F.col("user_id") % 5).alias("n")).distinct()
    return insights_saved(rows, results)


def regulation_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citations with and without titles, some of one section, put behind every part's name."""
    p = table(spark, sf, "part")
    n = F.col("p_partkey") % 7
    text = F.concat("p_name", F.lit(" See 8 CFR 216."), n.cast("string"), F.lit("(a)(5), cfr 274a."), (n + 1).cast("string"), F.lit(".2; 9 CFR 216."), (F.col("p_partkey") % 3).cast("string"), F.lit(" and CFR 216."), n.cast("string"), F.lit(" or CFR 1."), n.cast("string"))
    return p.select("p_partkey", F.array_join(cited_regulations(text), "|").alias("citations"))


def clause_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    made = F.element_at(F.array(F.concat(F.lit("(("), F.char(k % 26 + 97), F.lit("))")), F.concat(F.lit("§ "), (k % 90).cast("string")), F.concat(F.lit(" ("), (k % 9).cast("string"), F.upper(F.char(k % 26 + 97))), F.lit("(iv)"), F.lit("§§ "), F.upper(F.char(k % 26 + 97)), F.lit("a-b")), (k % 7 + 1).cast("int"))
    return p.select("p_partkey", clause_number(made).alias("clause"))


QUERIES = {f.__name__: f for f in (rephrase_links, question_file, appended_logs, orc_round_trip, order_sections, clause_repair, part_paths, coerced_results, appended_query_results, bounded_insights, regulation_citations, clause_labels)}

_PATH = "concat_ws(' / ', p_brand, CASE WHEN p_partkey % 4 <> 0 THEN p_type END, p_size::VARCHAR)"
_COERCED = """c AS (SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'x' || doc_id WHEN 2 THEN doc_id::VARCHAR WHEN 3 THEN 'x' || doc_id END AS knowledge_id,
        CASE WHEN doc_id % 5 IN (0, 2) THEN CASE WHEN doc_id % 3 <> 0 THEN source ELSE lang END WHEN doc_id % 5 = 4 THEN source END AS title,
        CASE WHEN doc_id % 5 IN (0, 2) AND doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 <> 0 THEN doc_id || '/A v. B/' || source || '|' ELSE '' END || '-/E v. F/-' END AS cases,
        CASE WHEN doc_id % 5 < 2 THEN 0.5::DOUBLE END AS score FROM documents)"""
ORACLE_SQL = {
    "coerced_results": f"WITH {_COERCED} SELECT doc_id, knowledge_id, title, cases, score FROM c",
    "appended_query_results": f"""WITH {_COERCED}, u AS (SELECT lang AS query, knowledge_id, title, doc_id AS ord, 0 AS later FROM c WHERE doc_id % 2 = 0 UNION ALL SELECT lang, knowledge_id, title, doc_id, 1 FROM c),
        f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query, coalesce('i' || knowledge_id, 't' || title) ORDER BY later, ord) = 1)
        SELECT query, coalesce(knowledge_id, '-') AS knowledge_id, title, row_number() OVER (PARTITION BY query ORDER BY later, ord) - 1 AS ord FROM f""",
    "bounded_insights": """WITH e AS (SELECT user_id::VARCHAR AS query, CAST(event_id % 8 - 1 AS INT) AS index, user_id, event_id, ts, event_type FROM events),
        l AS (SELECT * FROM e WHERE index >= 0 AND (user_id % 4 = 0 OR index < user_id % 5) QUALIFY row_number() OVER (PARTITION BY query, index ORDER BY ts DESC, event_id DESC) = 1)
        SELECT query, index, CASE WHEN event_id % 3 <> 0 THEN upper(event_type) END AS text_en, CASE WHEN event_id % 5 = 0 THEN 'hola' WHEN event_id % 3 = 0 THEN upper(event_type) END AS text_es, event_type AS text_norm FROM l""",
    "regulation_citations": """WITH t AS (SELECT p_partkey, p_partkey % 7 AS n, p_partkey % 3 AS m FROM part)
        SELECT p_partkey, array_to_string(list_sort(list_distinct([CASE WHEN n = m THEN '9' ELSE '8' END || ' CFR 216.' || n, '9 CFR 216.' || m, 'CFR 274a.' || (n + 1) || '.2', 'CFR 1.' || n])), '|') AS citations FROM t""",
    "clause_labels": """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '(' || (p_partkey % 26 + 1) || ')' WHEN 1 THEN '(' || p_partkey % 90 || ')' WHEN 2 THEN '(' || p_partkey % 9 || chr((p_partkey % 26 + 97)::INT) || ')'
        WHEN 5 THEN '(' || (p_partkey % 26 + 1) || ')' ELSE 'main' END AS clause FROM part""",
    "rephrase_links": "SELECT c_custkey AS src, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN c_custkey + 5 ELSE c_custkey + 1 END AS dst FROM customer",
    "question_file": "SELECT p_name || ', \"' || p_type || '\"' AS question, p_size AS level, p_brand || '|' || p_type AS topics FROM part",
    "appended_logs": "SELECT event_id, user_id, value FROM events",
    "orc_round_trip": "SELECT s_suppkey, s_nationkey FROM supplier",
    "order_sections": "SELECT l_orderkey, min(l_returnflag) AS flag, string_agg('No ' || l_linenumber || ':' || l_partkey, '|' ORDER BY l_linenumber, l_partkey::VARCHAR) AS sections FROM lineitem GROUP BY l_orderkey",
    "clause_repair": """WITH c AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) <> '' AND NOT regexp_matches(x, '(?i)^\\s*(?:home|next|previous|back to top|skip to content|search|menu)\\s*$')), lambda x: substr(x, 1, 100)) AS c FROM documents)
        SELECT doc_id, len(c)::BIGINT AS n, sha256(array_to_string(c, chr(10))) AS clauses_sha256 FROM c""",
    "part_paths": f"""SELECT p_partkey, CAST(3 - (p_partkey % 4 = 0)::INT AS INT) AS depth, {_PATH} AS path, replace({_PATH}, ' / ', '|') || '|x' AS ancestors,
        CASE p_brand WHEN 'Brand#1' THEN 0.1::DOUBLE WHEN 'Brand#2' THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END AS bias FROM part""",
}
