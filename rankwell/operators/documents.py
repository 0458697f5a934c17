"""The document model: fields, children, hierarchy, ingest and audits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, first_text, strip


@dataclass(frozen=True)
class DocumentConfig:
    """Which columns hold what; generates column expressions for the columns that a table has."""

    id_field: str = "id"
    title_field: str = "title"
    parent_field: str = "parent_id"
    text_fields: tuple[str, ...] = ("text", "summary", "body")
    children_fields: tuple[str, ...] = ("clauses", "sections")
    hierarchy: tuple[str, ...] = ("title", "chapter", "article", "part", "section")
    bias: dict[str, float] = field(default_factory=dict)

    def _present(self, df: DataFrame, names: tuple[str, ...]) -> list[Column]:
        return [F.col(n) for n in names if n in df.columns]

    def mapping(self) -> dict[str, object]:
        """Field names by role; the hierarchy without the title."""
        return {"id": self.id_field, "title": self.title_field, "parent": self.parent_field, "text": self.text_fields, "children": self.children_fields, "hierarchy": tuple(h for h in self.hierarchy if h != self.title_field)}

    def text(self, df: DataFrame) -> Column:
        return first_text(*(c.cast("string") for c in self._present(df, self.text_fields)))

    def levels(self, df: DataFrame) -> Column:
        """Values of the hierarchy from the top down, without blanks, nulls and zeros."""
        cells = [blank_to_null(c.cast("string")) for c in self._present(df, self.hierarchy)]
        return F.filter(F.array(*cells), lambda x: x.isNotNull() & (x != "0")) if cells else F.array().cast("array<string>")

    def depth(self, df: DataFrame) -> Column:
        return F.size(self.levels(df))

    def path(self, df: DataFrame) -> Column:
        return F.array_join(self.levels(df), " / ")

    def bias_of(self, title: Column) -> Column:
        if not self.bias:
            return F.lit(0.0)
        pairs = [x for t, b in sorted(self.bias.items()) for x in (F.lit(t), F.lit(float(b)))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), title), F.lit(0.0))


def child_texts(children: Column) -> Column:
    """Non-blank texts of an array of structs with ``text``."""
    texts = F.filter(F.transform(children, lambda c: strip(c["text"])), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(texts, F.array().cast("array<string>"))


def full_text(text: Column, children: Column) -> Column:
    """The text and the children's texts joined by spaces."""
    return F.concat_ws(" ", blank_to_null(text), F.nullif(F.array_join(child_texts(children), " "), F.lit("")))


def ancestors_of_path(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, "/"), lambda x: F.trim(x)), lambda x: x != "")


def wrapped_children(children: Column, text: Column, title: Column) -> Column:
    """Children numbered 1 to n; a flat text becomes a single child, no text none."""
    own = F.transform(children, lambda c, i: F.struct((i + 1).alias("number"), c["title"].alias("title"), c["text"].alias("text")))
    single = F.array(F.struct(F.lit(1).alias("number"), title.alias("title"), text.alias("text")))
    return F.when(F.coalesce(F.size(children), F.lit(0)) > 0, own).when(blank_to_null(text).isNotNull(), single).otherwise(F.slice(single, 1, 0))


def ingested(df: DataFrame, config: DocumentConfig) -> DataFrame:
    """Rows id, title, content, depth, path, embed_text, status: ok, or skipped without any text and title."""
    title = F.coalesce(strip(F.col(config.title_field).cast("string")), F.lit(""))
    content, path = config.text(df), config.path(df)
    status = F.when((content == "") & (title == ""), "skipped").otherwise("ok")
    embed = F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(F.array_join(config.levels(df), " "), F.lit("")), F.nullif(content, F.lit("")))
    return df.select(F.col(config.id_field).alias("id"), title.alias("title"), content.alias("content"), config.depth(df).alias("depth"), path.alias("path"), embed.alias("embed_text"), status.alias("status"))


def insert_absent(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not there yet."""
    return new.join(existing.select(key).distinct(), key, "left_anti")


def with_ancestors(nodes: DataFrame, most: int = 5) -> DataFrame:
    """id and ``ancestors``, root first: parents followed up to ``most`` steps, never in a circle.

    A bounded number of equi-joins on the parent; nodes: id, parent_id.
    """
    up = nodes.select(F.col("id").alias("__id"), F.col("parent_id").alias("__next"))
    out = nodes.select("id", F.col("parent_id").alias("next"), F.array().cast(f"array<{nodes.schema['id'].dataType.simpleString()}>").alias("ancestors"))
    for _ in range(most):
        found = out.join(up, out["next"] == up["__id"], "left")
        good = F.col("__id").isNotNull() & ~F.array_contains("ancestors", F.col("__id")) & (F.col("__id") != F.col("id"))
        out = found.select("id", F.when(good, F.col("__next")).alias("next"), F.when(good, F.concat(F.array("__id"), "ancestors")).otherwise(F.col("ancestors")).alias("ancestors"))
    return out.select("id", "ancestors")


def duplicate_groups(df: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """Keys with more than one row, how many, and the least id.

    Texts of the key are grouped by their SHA-256 and told by one row of the group, so that only those that are asked for move.
    """
    texts = [k for k in key if df.schema[k].dataType == T.StringType()]
    cells = [F.coalesce(F.concat(F.octet_length(k).cast("string"), F.lit(":"), k), F.lit("-")) for k in texts]
    by = [*(k for k in key if k not in texts), *([F.sha2(F.concat(*cells), 256).alias("_digest")] if texts else [])]
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"), *(F.first(k).alias(k) for k in texts))
    return found.where("n > 1").select(*key, "n", "first_id")


def duplicate_patterns(df: DataFrame, title: str, full_key: list[str]) -> DataFrame:
    """Per repeated title: true duplicates agree in the whole key."""
    per = df.groupBy(title).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*full_key)).alias("keys")).where("n > 1")
    return per.withColumn("pattern", F.when(F.col("keys") == 1, "true_duplicate").otherwise("same_title"))


def newest_only(df: DataFrame, key: list[str], newest: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(newest), F.desc(tie))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def without_text(df: DataFrame, text: str, children: str | None = None) -> DataFrame:
    """Documents with neither a text of their own nor any child's."""
    blank = F.coalesce(strip(F.col(text)), F.lit("")) == ""
    if children:
        blank = blank & (F.size(child_texts(F.col(children))) == 0)
    return df.where(blank)


def out_of_sequence(df: DataFrame, parent: str, number: str) -> DataFrame:
    """Children whose number is not the one before plus one, the first being 1."""
    w = Window.partitionBy(parent).orderBy(number)
    return df.withColumn("expected", F.coalesce(F.lag(number).over(w) + 1, F.lit(1))).where(F.col(number) != F.col("expected"))


def carried_heading(df: DataFrame, doc: str, order: str, heading: str) -> DataFrame:
    """Each row with the last heading before or at it."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("current_heading", F.last(heading, ignorenulls=True).over(w))


def merged_paragraphs(df: DataFrame, doc: str, order: str, starts: Column, text: str) -> DataFrame:
    """Rows that do not start a clause join the one before; clauses are numbered from 1."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    islands = df.withColumn("clause", F.greatest(F.sum(starts.cast("int")).over(w), F.lit(1)))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return islands.groupBy(doc, "clause").agg(F.array_join(F.transform(parts, lambda p: p[text]), " ").alias("text"))


def to_hierarchy(df: DataFrame, levels: dict[str, str], title: Column, text: Column, children: Column | None = None) -> DataFrame:
    """Flat rows in the common shape: named levels, a title made from them where it is blank, children numbered from 1."""
    cells = {name: blank_to_null(F.col(c).cast("string")) for name, c in levels.items()}
    made = F.concat_ws(" ", *(F.concat(F.lit(f"{name.capitalize()} "), c) for name, c in cells.items()))
    full = F.coalesce(blank_to_null(title), made)
    kids = wrapped_children(children if children is not None else F.lit(None).cast("array<struct<title:string,text:string>>"), text, full)
    return df.select(*(c.alias(name) for name, c in cells.items()), full.alias("title"), kids.alias("clauses"))


def grouped_sections(df: DataFrame, key: list[str], title: str, sections: str) -> DataFrame:
    """Rows with equal keys as one: the first title, all sections in numeric order of their number."""
    number = lambda s: F.coalesce(F.nullif(F.regexp_extract(s["number"].cast("string"), r"([0-9]+)", 1), F.lit("")).try_cast("long"), F.lit(1 << 60))
    every = F.flatten(F.collect_list(sections))
    ordered = F.transform(F.array_sort(F.transform(every, lambda s: F.struct(number(s).alias("n"), s.alias("s")))), lambda x: x["s"])
    return df.groupBy(*key).agg(F.min(title).alias(title), ordered.alias(sections))
