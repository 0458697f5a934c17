"""Comparing and merging snapshots, and the stored query table's updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_digest(df: DataFrame, compared: list[str]) -> Column:
    """SHA-256 of the compared columns without surrounding white space; null counts as empty."""
    norm = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", "")
    return F.sha2(F.concat_ws("\u0001", *(norm(df[c]) for c in compared)), 256)


def changed(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key and change: new, updated, deleted or same; texts are compared without surrounding white space."""
    a = old.select(F.col(key), content_digest(old, compared).alias("__a"))
    b = new.select(F.col(key), content_digest(new, compared).alias("__b"))
    change = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "deleted").when(F.col("__a") != F.col("__b"), "updated").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def change_set_applied(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store after an update: new and changed rows come from ``new``; what is gone there stays, as deletions are only logged."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def split_sets(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key and state: new, removed or existing."""
    a, b = before.select(key).distinct().withColumn("__a", F.lit(1)), after.select(key).distinct().withColumn("__b", F.lit(1))
    state = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "removed").otherwise("existing")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def merged_by_title(new: DataFrame, existing: DataFrame, title: str, force: bool, tie: str) -> DataFrame:
    """Union with one row per title (case and outer spaces aside); existing rows win unless ``force``."""
    rows = new.withColumn("__o", F.lit(0 if force else 1)).unionByName(existing.withColumn("__o", F.lit(1 if force else 0)))
    w = Window.partitionBy(F.lower(F.trim(F.col(title)))).orderBy("__o", tie)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__o")


def upserted(stored: DataFrame, updates: DataFrame, key: str, values: list[str], now: Column) -> DataFrame:
    """Stored rows with updates merged in: created_at is set once, updated_at with every update."""
    u = updates.select(key, *(F.col(v).alias(f"__{v}") for v in values), F.lit(True).alias("__u"))
    j = stored.join(u, key, "full_outer")
    cells = [F.coalesce(f"__{v}", v).alias(v) for v in values]
    return j.select(key, *cells, F.coalesce("created_at", now).alias("created_at"), F.when(F.col("__u"), now).otherwise(F.col("updated_at")).alias("updated_at"))


def appended_once(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first of the rows with equal keys."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_write(rows: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
