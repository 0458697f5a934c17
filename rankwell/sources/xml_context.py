"""Sections of XML files with the headings they stand under, split by element and not by file.

Files are read in pieces that begin with ``<DIV``, so the reader splits one file over many
tasks at any byte and no task holds more than an element's own text. What a piece passes on
to those after it (the headings that are open when it ends) is folded in two steps: within
each split, and then over one row per split. Only rows and splits are sorted, never a file
as a whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# What the levels of the format are.
CHAPTER, SUBCHAPTER, PART, SECTION = 3, 4, 5, 8
_ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&sect;", "§"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
_SIGNS = (("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("…", "..."))


def plain(markup: Column) -> Column:
    """Text of a piece of markup: tags go, entities and typographic signs become plain, white space collapses."""
    out = F.regexp_replace(markup, r"<[^>]*>", "")
    for old, new in (*_ENTITIES, *_SIGNS):
        out = F.replace(out, F.lit(old), F.lit(new))
    return strip(F.regexp_replace(out, r"[\s    ]+", " "))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """One row per DIV element: file, split and nth (its place), level, number (attribute N), head, paragraphs, closes (the lowest level that ends in it, or null)."""
    raw = spark.read.option("lineSep", "<DIV").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), "value")
    body = F.regexp_extract("value", r"(?s)^[0-9][^>]*>(.*)$", 1)
    closes = F.array_min(F.transform(F.regexp_extract_all("value", F.lit(r"</DIV([0-9])\s*>"), F.lit(1)), lambda d: d.cast("int")))
    texts = F.transform(F.regexp_extract_all("body", F.lit(r"(?s)<P(?:\s[^>]*)?>(.*?)</P\s*>"), F.lit(1)), plain)
    rows = raw.where(r"value RLIKE '^[0-9][^>]*>'").withColumn("body", body)
    return rows.select(
        "file", "split", "nth", F.substring("value", 1, 1).cast("int").alias("level"), F.nullif(F.regexp_extract("value", r'^[0-9][^>]*?\sN="([^"]*)"', 1), F.lit("")).alias("number"),
        plain(F.regexp_extract("body", r"(?s)<HEAD(?:\s[^>]*)?>(.*?)</HEAD\s*>", 1)).alias("head"), F.filter(texts, lambda t: t != "").alias("paragraphs"), closes.alias("closes"),
    )


def inherited(rows: DataFrame, levels: dict[int, str]) -> DataFrame:
    """``rows`` of :func:`elements` with a column per level: the head and place of the element of that level that is open before the row.

    The columns (named by ``levels``) are structs head, number, at; null where no such element is open. An element ends by
    its own end or by the beginning of one of its level or above.
    """
    place = F.struct("split", "nth").alias("at")

    def after(k: int) -> Column:
        """What the row leaves open: a struct with the element, one with nulls if it ends it, or null if it changes nothing."""
        ends = (F.col("level") < k) | (F.col("closes") <= k)
        opens = (F.col("level") == k) & (F.col("closes").isNull() | (F.col("closes") > k))
        none = F.struct(F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("struct<split: long, nth: long>").alias("at"))
        return F.when(opens, F.struct("head", "number", place)).when(ends | (F.col("level") == k), none)

    within = Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.last(after(k), ignorenulls=True).over(within).alias(name) for k, name in levels.items()]
    local = rows.select("*", *whole)
    # what each split leaves open: one row per split, so a window over a file's splits is small
    ends = rows.select("file", "split", "nth", *(after(k).alias(name) for k, name in levels.items())).groupBy("file", "split")
    ends = ends.agg(*(F.max_by(F.when(F.col(name).isNotNull(), F.col(name)), F.when(F.col(name).isNotNull(), F.col("nth"))).alias(name) for name in levels.values()))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "split", *(F.last(name, ignorenulls=True).over(before).alias(f"_{name}") for name in levels.values()))
    joined = local.join(ends, ["file", "split"])
    for name in levels.values():
        known = F.coalesce(name, f"_{name}")
        joined = joined.withColumn(name, F.when(known["at"].isNotNull(), known)).drop(f"_{name}")
    return joined


def sections(spark: SparkSession, path: str) -> DataFrame:
    """file, chapter, subchapter, part, section, title, text of every section element in the files at ``path``.

    Chapter and subchapter are the headings above the section, part its number ("PART 12a ..." is 12A; null without one). The
    text is all paragraphs in the section and in what is nested in it, in order, with blank lines between. A heading
    loses its leading section sign and number. Sections with neither heading nor paragraph are left out.
    """
    levels = {CHAPTER: "chapter", SUBCHAPTER: "subchapter", PART: "part", SECTION: "inside"}
    rows = inherited(elements(spark, path), levels)
    own = F.when(F.col("level") == SECTION, F.struct("split", "nth")).when(F.col("level") > SECTION, F.col("inside.at"))
    rows = rows.withColumn("at", own).where("at IS NOT NULL")
    first = F.col("level") == SECTION
    pick = lambda c: F.max(F.when(first, c))
    # a section's pieces are its own text; grouping them needs no more than the section
    held = F.array_sort(F.collect_list(F.struct("split", "nth", "paragraphs")))
    whole = rows.groupBy("file", "at").agg(held.alias("held"), pick(F.col("chapter.head")).alias("chapter"), pick(F.col("subchapter.head")).alias("subchapter"), pick(F.col("part.head")).alias("part"), pick(F.col("number")).alias("number"), pick(F.col("head")).alias("head"))
    text = F.array_join(F.flatten(F.transform("held", lambda h: h["paragraphs"])), "\n\n")
    title = strip(F.regexp_replace("head", r"^§+\s*[0-9A-Za-z.\-]+\s*", ""))
    part = F.nullif(F.upper(F.regexp_extract("part", r"(?i)PART\s+([0-9]+[A-Za-z]?)", 1)), F.lit(""))
    out = whole.select("file", "at", "chapter", "subchapter", part.alias("part"), F.regexp_replace("number", r"^§+\s*", "").alias("section"), title.alias("title"), text.alias("text"))
    return out.where("title <> '' OR text <> ''").drop("at")
