"""Queries of dictionary matching and masking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.personal import masked_personal
from ..functions.text import roman
from ..operators import term_scan
from ..operators.lexicon import ORDINALS, ordinal
from ..sources.tables import table

def _statutes(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Titles and articles with sections that stand in for a collection of statutes, from ``part``."""
    p = table(spark, sf, "part")
    number = F.col("p_size")
    endings = F.element_at(F.array(*(F.lit(ordinal(k)) for k in range(1, 51))), number)
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat(endings, F.lit(" Amendment"))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", number.cast("string")))
    return p.select(title.alias("title")).distinct(), p.where("p_partkey % 2 = 0").select(F.concat(F.lit("Article "), roman(number)).alias("article"), F.concat(F.lit("Section "), (F.col("p_partkey") % 9 + 1).cast("string")).alias("section"))


def _asked(spark, sf) -> DataFrame:
    """Four kinds of questions, made from the columns of every part."""
    p = table(spark, sf, "part")
    n, key = F.col("p_size").cast("string"), F.col("p_partkey")
    word = F.element_at(F.array(*map(F.lit, ORDINALS[:20])), F.col("p_size") % 20 + 1)
    kinds = (
        F.concat(F.lit("Is "), "p_name", F.lit(" in article "), n, F.lit(" section "), (key % 12).cast("string"), F.lit(" and section 3 or section 3?")),
        F.concat(F.lit("the "), n, F.lit("th")),
        F.concat("p_name", F.lit(" Twenty one, under the "), word, F.lit(" amendment; article "), F.lower(roman(F.col("p_size"))), F.lit(" section 2")),
        F.concat(F.lit("Article "), word, F.lit(" § 2, s§ 4 "), "p_name", F.lit(" "), n),
    )
    text = kinds[3]
    for k in (2, 1, 0):
        text = F.when(key % 4 == k, kinds[k]).otherwise(text)
    return p.select(key.alias("query_id"), text.alias("text"))


def textual_labels(spark: SparkSession, sf: str) -> DataFrame:
    return term_scan.find_textual(_asked(spark, sf), *_statutes(spark, sf))


def personal_masked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", masked_personal(F.col("text")).alias("masked"))


QUERIES = {"textual_labels": textual_labels, "personal_masked": personal_masked}

_W = r"[\p{L}\p{N}_]"


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v) + "'" for v in values) + "]"


def _labels_sql() -> str:
    ends = _list(ordinal(k) for k in range(1, 51))
    romans = "['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX','XXI','XXII','XXIII','XXIV','XXV','XXVI','XXVII','XXVIII','XXIX','XXX','XXXI','XXXII','XXXIII','XXXIV','XXXV','XXXVI','XXXVII','XXXVIII','XXXIX','XL','XLI','XLII','XLIII','XLIV','XLV','XLVI','XLVII','XLVIII','XLIX','L']"
    words, cut = _list(ORDINALS[:20]), rf"'{_W}+|[^\p{{L}}\p{{N}}_]+'"
    word = f"{words}[p_size % 20 + 1]"
    pairs = ", ".join(f"('{w}', '{n}')" for w, n in term_scan.PAIRS)
    bare = _list([*(str(k) for k in range(1, 51)), *(ordinal(k) for k in range(1, 51))])
    return f"""
        WITH p AS (SELECT *, {ends}[p_size] AS nth, {romans}[p_size] AS rom FROM part),
        titles AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN nth || ' Amendment' WHEN 1 THEN p_name ELSE p_name || ' ' || p_size END AS title FROM p),
        articles AS (SELECT DISTINCT 'Article ' || rom AS article, 'Section ' || (p_partkey % 9 + 1) AS section FROM p WHERE p_partkey % 2 = 0),
        asked AS (SELECT p_partkey AS query_id, lower(CASE p_partkey % 4 WHEN 0 THEN 'Is ' || p_name || ' in article ' || p_size || ' section ' || p_partkey % 12 || ' and section 3 or section 3?'
                    WHEN 1 THEN 'the ' || nth WHEN 2 THEN p_name || ' Twenty one, under the ' || {word} || ' amendment; article ' || lower(rom) || ' section 2'
                    ELSE 'Article ' || {word} || ' § 2, s§ 4 ' || p_name || ' ' || p_size END) AS t FROM p),
        own AS (SELECT DISTINCT term, chr(1) || array_to_string(regexp_extract_all(lower(term), {cut}), chr(1)) || chr(1) AS own FROM (SELECT title AS term FROM titles UNION ALL SELECT article FROM articles)),
        pairs AS (SELECT chr(1) || replace(w, ' ', chr(1) || ' ' || chr(1)) || chr(1) AS word, chr(1) || n || chr(1) AS number FROM (VALUES {pairs}) v(w, n)),
        f AS (SELECT term, own AS form FROM own UNION
              SELECT term, CASE WHEN contains(own, number) THEN replace(own, number, word) ELSE replace(own, word, number) END FROM own, pairs WHERE contains(own, number) OR contains(own, word)),
        q AS (SELECT query_id, t, chr(1) || array_to_string(regexp_extract_all(t, {cut}), chr(1)) || chr(1) AS pieces FROM asked),
        guess AS (SELECT query_id, title AS term, 0 AS way FROM asked JOIN titles ON lower(title) = regexp_replace(t, '^the ', '') || ' amendment' WHERE list_contains({bare}, regexp_replace(t, '^the ', ''))),
        hits AS (SELECT query_id, term, 1 AS way FROM q JOIN f ON contains(q.pieces, f.form)),
        c AS (SELECT query_id, regexp_extract(t, '\\barticle\\s+([ivxlcdm]+|[0-9]+|{"|".join(ORDINALS[:20])})\\b', 1) AS token, list_distinct(regexp_extract_all(t, '\\bsection\\s*([0-9]+)\\b|{_W}§\\s*([0-9]+)\\b', 1) || regexp_extract_all(t, '{_W}§\\s*([0-9]+)\\b', 1)) AS secs FROM asked),
        n AS (SELECT *, coalesce(try_cast(token AS INT), nullif(list_position({words}, token), 0)) AS k FROM c WHERE token <> ''),
        a AS (SELECT query_id, article, unnest(secs) AS sec FROM n JOIN (SELECT DISTINCT article FROM articles) d ON lower(article) = 'article ' || CASE WHEN k IS NULL THEN token ELSE lower({romans}[k]) END),
        v AS (SELECT a.query_id, a.article, 'Section ' || sec AS section FROM a WHERE sec <> '' AND EXISTS (SELECT 1 FROM articles x WHERE x.article = a.article AND x.section = 'Section ' || sec)),
        u AS (SELECT * FROM guess UNION ALL SELECT * FROM hits UNION ALL SELECT query_id, unnest([article, section, article || ' ' || section]), 2 FROM v)
        SELECT query_id, term, ['guess', 'term', 'section'][min(way) + 1] AS kind FROM u GROUP BY query_id, term"""


#: One rule after the other, which is the same where no two spans overlap.
_MASKED = "text"
for _pattern, _by in (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "an email"),
    (r"\+?\d[\d \t().-]{6,}\d", "a phone number"),
    (r"(?i)\b\d{1,6}[ \t-]+[A-Za-z0-9.# \t-]{1,80}?,[ \t]*([A-Za-z .''-]{1,40}?),[ \t]*([A-Z]{2}\b|[A-Za-z .''-]{1,30})(?:[ \t]+\d{5}(?:-\d{4})?)?\b", r"\2 \1"),
    (r"(?i)\b\d{1,6}[ \t]+[A-Za-z0-9 .''#-]{1,60}?[ \t](?:street|st|avenue|ave|boulevard|blvd|road|rd|lane|ln|drive|dr|way|place|pl)\b", "a location"),
):
    _MASKED = f"regexp_replace({_MASKED}, '{_pattern}', '{_by}', 'g')"

ORACLE_SQL = {"textual_labels": _labels_sql(), "personal_masked": f"SELECT doc_id, {_MASKED} AS masked FROM documents"}
