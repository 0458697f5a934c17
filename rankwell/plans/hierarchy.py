"""Queries of records of nine shapes, with their SQL. The records are JSON texts made of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shapes import SHAPES, hierarchies
from ..sources.tables import table


def _records(spark, sf, name: str) -> DataFrame:
    """doc_id, json: by doc_id modulo 4 a record has children, a flat text, only a title, or children and a text."""
    d = table(spark, sf, "documents")
    n = lambda k: (F.col("doc_id") % k).cast("string")
    kind, lines = F.col("doc_id") % 4, F.split("text", "\n", -1)
    title = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("§ 7.1 "), "lang", F.lit(" <b>"), "source", F.lit("</b>.")))
    child = lambda x, i: F.struct((i * 10).alias("number"), F.when(i % 2 == 0, F.concat(F.lit("T "), i.cast("string"))).alias("title"), F.when(x != "", x).alias("text"))
    children = F.when(kind.isin(0, 3), F.transform(lines, child))
    section = F.concat(F.lit("§ "), n(9), F.lit("."), n(4))
    own = {"article": F.concat(F.lit("Title "), n(50)), "part": F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Part "), n(7), F.lit("A"))), "chapter": F.concat(F.lit("Chapter "), n(5)), "date": n(28), "agency": F.col("source"), "references": F.array(F.concat(F.lit("8 CFR "), n(11)), F.lit("x"))}
    places = {"regulations": ("sections", section), "statutes": ("section", None)}
    at, labelled = places.get(name, ("clauses", section))
    cells = [c.alias(k) for k, c in own.items()] + [title.alias("title"), F.when(kind.isin(1, 3), F.col("text")).alias("text"), children.alias(at)]
    if labelled is not None:
        cells.append(labelled.alias("section"))
    return d.select("doc_id", F.to_json(F.struct(*cells)).alias("json"))


def _shape(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        shape = SHAPES[name]
        rows = hierarchies(_records(spark, sf, name), "json", shape)
        joined = F.array_join(F.transform("children", lambda c: F.concat(F.coalesce(c["number"], F.lit("-")), F.lit("|"), c["title"], F.lit("|"), c["text"])), "\n")
        labels = F.concat_ws("/", *(F.coalesce(F.col(c), F.lit("-")) for c in (*shape.fields, *shape.numbers)))
        text = F.sha2("text", 256) if shape.flat else F.lit("")
        return rows.select("doc_id", "title", labels.alias("labels"), F.size("children").cast("long").alias("n_children"), F.sha2(joined, 256).alias("children_sha256"), text.alias("text_sha256"))

    return query


QUERIES = {f"hierarchy_{name}": _shape(name) for name in SHAPES}


def _sql(name: str) -> str:
    base = """d AS (SELECT doc_id, text, source, doc_id % 4 IN (0, 3) AS listed, doc_id % 4 IN (1, 3) AS flat, 'Title ' || doc_id % 50 AS article, CASE WHEN doc_id % 3 <> 0 THEN 'Part ' || doc_id % 7 || 'A' END AS part,
        'Chapter ' || doc_id % 5 AS chapter, '§ ' || doc_id % 9 || '.' || doc_id % 4 AS section, (doc_id % 28)::VARCHAR AS date, CASE WHEN doc_id % 5 <> 0 THEN {title} ELSE '' END AS t, string_split(text, chr(10)) AS lines FROM documents)"""
    title = {
        "constitution": "'§ 7.1 ' || lang || ' ' || source || '.'", "regulations": "lang || ' <b>' || source || '</b>'", "regulation_updates": "lang || ' <b>' || source || '</b>'",
    }.get(name, "'§ 7.1 ' || lang || ' <b>' || source || '</b>.'")
    clean = (lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]', '', 'g'), '\\s+', ' ', 'g'))") if name == "constitution" else lambda x: x
    number = "(i)::VARCHAR" if name in ("regulations", "statutes") else "((i - 1) * 10)::VARCHAR"
    own_title = "CASE WHEN i % 2 = 1 THEN 'T ' || (i - 1) ELSE '' END"
    solid = name.startswith("regulation")
    keep = f"WHERE ({own_title}) <> '' OR lines[i] <> ''" if solid else ""
    lent = "CASE WHEN len(lines) = 1 AND ct = '' THEN t ELSE ct END" if name == "statutes" else "ct"
    listed = f"(SELECT coalesce(string_agg(num || '|' || {lent} || '|' || x, chr(10) ORDER BY i), '') FROM (SELECT i, {number} AS num, {own_title} AS ct, {clean('lines[i]')} AS x FROM range(1, len(lines) + 1) r(i) {keep}))"
    counted = f"(SELECT count(*) FROM range(1, len(lines) + 1) r(i) {keep})"
    body = clean("text")
    if name in ("guidance", "manual"):
        single, ones = "''", "0"
    elif solid:
        single, ones = f"CASE WHEN flat AND text <> '' THEN '1||' || {body} WHEN t <> '' THEN '1|' || t || '|' ELSE '' END", "CASE WHEN flat AND text <> '' OR t <> '' THEN 1 ELSE 0 END"
    else:
        single, ones = f"CASE WHEN flat AND {body} <> '' THEN '1|' || t || '|' || {body} ELSE '' END", f"CASE WHEN flat AND {body} <> '' THEN 1 ELSE 0 END"
    labels = {
        "constitution": "article || '/' || section", "annotated_law": "article || '/' || section", "register": "article || '/' || section || '/' || date || '/-/-/' || source", "state_codes": "'-/-/' || coalesce(part, '-') || '/' || chapter || '/' || section",
        "guidance": "date || '/' || source", "manual": "date || '/8 CFR ' || doc_id % 11", "statutes": "article || '/' || chapter || '/' || CASE WHEN listed THEN '0' ELSE '-' END",
        "regulations": "article || '/' || coalesce(part, '-') || '/' || chapter || '/-/' || section || '/' || doc_id % 50 || '/' || coalesce(doc_id % 7 || 'A', '-') || '/' || doc_id % 9 || '.' || doc_id % 4",
        "regulation_updates": "article || '/' || coalesce(part, '-') || '/' || chapter || '/' || section || '/' || doc_id % 50 || '/' || coalesce(doc_id % 7 || 'A', '-') || '/' || doc_id % 9 || '.' || doc_id % 4",
    }[name]
    if solid:
        labels = labels.replace("coalesce(doc_id % 7 || 'A', '-')", "CASE WHEN part IS NULL THEN '-' ELSE doc_id % 7 || 'A' END")
        shown = "CASE WHEN t <> '' THEN t ELSE 'Title ' || doc_id % 50 || coalesce(' ' || part, '') || ' Section ' || doc_id % 9 || '.' || doc_id % 4 END"
    elif name == "statutes":
        shown = "CASE WHEN t <> '' THEN t WHEN listed THEN 'T 0' ELSE '' END"
    else:
        shown = "t"
    texts = "''"
    if name in ("guidance", "manual"):
        texts = "sha256(regexp_replace(array_to_string(list_filter((CASE WHEN listed THEN lines ELSE [] END) || [CASE WHEN flat THEN text ELSE '' END], lambda x: x <> ''), ' '), '^\\s+|\\s+$', '', 'g'))"
    return f"""WITH {base.format(title=title)}
        SELECT doc_id, {shown} AS title, {labels} AS labels, CASE WHEN listed THEN {counted} ELSE {ones} END::BIGINT AS n_children,
               sha256(CASE WHEN listed THEN {listed} ELSE {single} END) AS children_sha256, {texts} AS text_sha256 FROM d"""


ORACLE_SQL = {f"hierarchy_{name}": _sql(name) for name in SHAPES}
