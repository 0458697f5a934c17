"""Unlike JSON records as one hierarchy: fields, a title and numbered children, by declared paths.

A record is parsed once into a variant, and everything is read from it by path, so a collection
needs a :class:`Shape` and no code. Paths that are missing or hold something else are null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..sources.writers import scratch

CHILDREN = "array<struct<number: string, title: string, text: string>>"


def plain(text: Column) -> Column:
    return text


def untagged(text: Column) -> Column:
    """Without tags and emoji, white space collapsed."""
    out = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", "")
    return strip(F.regexp_replace(out, r"\s+", " "))


def unnumbered(text: Column) -> Column:
    """A heading without its section sign and number, its final full stop and outer space."""
    return F.regexp_replace(strip(F.regexp_replace(text, r"^\s*§+\s*[0-9][0-9A-Za-z.\-]*\s*", "")), r"\.$", "")


@dataclass(frozen=True)
class Shape:
    """How a collection's records become hierarchies.

    fields: output column -> path. children: paths of lists, the first list that is not empty counts. numbers: output
    column -> (field, pattern with one group). wrap: how a flat text becomes the only child: under the record's title
    ("title"), without one ("untitled") or not at all (""). heading: a record with nothing but a title has it as its only
    child. renumber: children count from 1 on. solid: children without title and text go. lend: an only child
    without a title takes the record's. labels: what a missing title is put together from, as (label, column). borrow: a
    missing title is the first child's. flat: all texts as one column. clean: what is done to every text,
    and headings: to every title.
    """

    fields: dict[str, str] = field(default_factory=dict)
    children: tuple[str, ...] = ("$.clauses",)
    numbers: dict[str, tuple[str, str]] = field(default_factory=dict)
    wrap: str = "title"
    heading: bool = False
    renumber: bool = False
    solid: bool = False
    lend: bool = False
    labels: tuple[tuple[str, str], ...] = ()
    borrow: bool = False
    flat: bool = False
    clean: object = plain
    headings: object = plain


def _paths(*names: str) -> dict[str, str]:
    return {n: f"$.{n}" for n in names}


_CODE_NUMBERS = {"article_number": ("article", r"([0-9]+)"), "part_number": ("part", r"([0-9]+[A-Za-z]?)"), "section_number": ("section", r"([0-9]+(?:\.[0-9A-Za-z]+)*)")}
_CODE_LABELS = (("Title", "article_number"), ("Part", "part_number"), ("Section", "section_number"))
#: The nine collections.
SHAPES = {
    "constitution": Shape(_paths("article", "section"), clean=untagged, headings=untagged),
    "annotated_law": Shape(_paths("article", "section")),
    "register": Shape(_paths("article", "section", "date", "volume", "number", "agency")),
    "state_codes": Shape(_paths("code", "division", "part", "chapter", "section")),
    "guidance": Shape(_paths("date", "agency"), wrap="", flat=True),
    "manual": Shape({**_paths("date"), "reference": "$.references[0]"}, wrap="", flat=True),
    "regulations": Shape(_paths("article", "part", "chapter", "subchapter", "section"), ("$.sections", "$.clauses"), _CODE_NUMBERS, "untitled", True, True, True, labels=_CODE_LABELS, headings=unnumbered),
    "regulation_updates": Shape(_paths("article", "part", "chapter", "section"), ("$.clauses",), _CODE_NUMBERS, "untitled", True, False, True, labels=_CODE_LABELS, headings=unnumbered),
    "statutes": Shape({**_paths("article", "chapter"), "section": "$.section[0].number"}, ("$.section", "$.clauses"), renumber=True, lend=True, borrow=True, headings=strip),
}


def hierarchies(rows: DataFrame, json: str, shape: Shape) -> DataFrame:
    """``rows`` without the column ``json`` (text or a variant) and with the shape's fields and numbers, title, children and (if flat) text.

    Text that is no JSON object gives nulls and no children. A child may be a bare text. A missing text or title
    of a child is empty; a field that is missing is null.
    """
    read = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    doc = F.col("_v")
    kept = [c for c in rows.columns if c != json]
    parsed = F.col(json) if rows.schema[json].dataType == T.VariantType() else F.try_parse_json(F.col(json))
    out = rows.select(*kept, parsed.alias("_v"))
    lists = [read(doc, path, "array<variant>") for path in shape.children]
    found = F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists))
    text = shape.clean(F.coalesce(read(doc, "$.text"), F.lit("")))
    title = shape.headings(F.coalesce(read(doc, "$.title"), F.lit("")))
    out = out.select(*kept, *(read(doc, path).alias(name) for name, path in shape.fields.items()), title.alias("_title"), text.alias("_text"), found.alias("_found"))
    for name, (source, pattern) in shape.numbers.items():
        out = out.withColumn(name, F.nullif(F.regexp_extract(source, pattern, 1), F.lit("")))

    def child(c: Column, i: Column) -> Column:
        bare = F.when(F.schema_of_variant(c) == "STRING", read(c, "$"))
        number = (i + 1).cast("string") if shape.renumber else read(c, "$.number")
        return F.struct(number.alias("number"), shape.headings(F.coalesce(read(c, "$.title"), F.lit(""))).alias("title"), shape.clean(F.coalesce(read(c, "$.text"), bare, F.lit(""))).alias("text"))

    out = out.withColumn("_children", F.transform("_found", child))
    if shape.solid:
        out = out.withColumn("_children", F.filter("_children", lambda c: (c["title"] != "") | (c["text"] != "")))
    only = lambda title, text: F.array(F.struct(F.lit("1").alias("number"), title.alias("title"), text.alias("text")))
    if shape.lend:
        lent = F.transform("_children", lambda c: F.struct(c["number"].alias("number"), F.when(c["title"] == "", F.col("_title")).otherwise(c["title"]).alias("title"), c["text"].alias("text")))
        out = out.withColumn("_children", F.when(F.size("_children") == 1, lent).otherwise(F.col("_children")))
    none, made = F.array().cast(CHILDREN), F.col("_children")
    if shape.wrap:
        wrapped = F.when(F.col("_text") != "", only(F.col("_title") if shape.wrap == "title" else F.lit(""), F.col("_text")))
        made = F.when(F.col("_found").isNotNull(), made).otherwise(wrapped)
    if shape.heading:
        made = F.when(F.col("_found").isNull() & (F.col("_text") == "") & (F.col("_title") != ""), only(F.col("_title"), F.lit(""))).otherwise(made)
    out = out.withColumn("children", F.coalesce(made, none).cast(CHILDREN))
    titles = [F.nullif(F.col("_title"), F.lit(""))]
    if shape.labels:
        titles.append(F.nullif(F.concat_ws(" ", *(F.concat(F.lit(f"{label} "), name) for label, name in shape.labels)), F.lit("")))
    if shape.borrow:
        titles.append(F.get("children", F.lit(0))["title"])
    result = [*kept, *shape.fields, *shape.numbers, F.coalesce(*titles, F.lit("")).alias("title"), "children"]
    if shape.flat:
        texts = F.concat(F.transform("children", lambda c: c["text"]), F.array("_text"))
        result.append(strip(F.array_join(F.filter(texts, lambda t: t != ""), " ")).alias("text"))
    return out.select(*result)


def stored_variants(rows: DataFrame, json: str) -> DataFrame:
    """``rows`` with ``json`` as a variant, written once, so that several shapes read it without parsing it again."""
    path = scratch(rows.sparkSession, "variants")
    rows.withColumn(json, F.try_parse_json(F.col(json))).write.parquet(path)
    return rows.sparkSession.read.parquet(path)
