"""Sources: columnar tables, nested JSON, XML, CSV and HTML pages as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def knowledge_json(spark: SparkSession, path: str, arrays: tuple[str, ...] = ("articles", "documents", "titles", "regulations")) -> DataFrame:
    """Rows topic, doc (JSON text) from ``{"data": {topic: {array: [doc]}}}`` files.

    Topics are not known in advance, so the file is read as text and opened as maps.
    """
    raw = spark.read.text(path, wholetext=True)
    topics = raw.select(F.explode(F.from_json("value", "struct<data: map<string, map<string, array<string>>>>")["data"]).alias("topic", "body"))
    found = F.coalesce(*(F.try_element_at("body", F.lit(a)) for a in arrays))
    return topics.select("topic", F.explode(found).alias("doc"))


def cases_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows category, case, summary, references from ``{"cases": {category: [case]}}``; a bare string is a case name."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "struct<cases: map<string, array<string>>>")["cases"]).alias("category", "items"))
    rows = rows.select("category", F.explode("items").alias("item"))
    parsed = F.from_json("item", "struct<case: string, summary: string, references: array<string>>")
    return rows.select("category", F.coalesce(parsed["case"], F.col("item")).alias("case"), parsed["summary"].alias("summary"), F.coalesce(parsed["references"], F.array().cast("array<string>")).alias("references"))


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """One row per ``row_tag`` element."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def question_csv(spark: SparkSession, path: str) -> DataFrame:
    """Question, case level and topics of a quoted CSV with a header."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', schema="question string, level int, related string")
    topics = F.filter(F.transform(F.split("related", ","), lambda t: F.trim(t)), lambda t: t != "")
    return rows.select("question", "level", topics.alias("topics"))


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """The source that stands in where none is configured: no rows."""
    return spark.createDataFrame([], schema)


_BLOCKS = r"(?is)<(script|style|nav|header|footer|aside|noscript)\b[^>]*>.*?</\1\s*>"


def html_text(html):
    """Text of a page: scripts, styles, navigation, comments and tags go, five entities are resolved, space collapses."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, _BLOCKS, " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))
