"""Merkle manifest of a dataset: who holds the root can check any row by its proof.

The node store is external: leaves are sorted by group into runs (see ``ordering``) and
written as level 0 of a Parquet folder partitioned by level; each level reads the one
before it, joins every 16 consecutive nodes of a group into one and is written in the
order of its coordinates (group, run). A group with a third of all rows is spread over
the runs like any other, and a node never holds more than 16 digests.

Proofs are read from the top: the nodes of a level are merged by coordinate with the
paths of that level, and each member of a node gets its siblings put before the path.
So what is shared by many leaves is stored once for 16 of them, and the leaves' own
proofs are never written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, scratch_path, small_batches, stored, told_by_group
from .ordering import numbered

#: Nodes that become one. Fixed by the manifest's format.
RUN = 16
#: A path: per level the siblings on the left and on the right of the way up, as joined digests.
PATH = "array<struct<left: string, right: string>>"


def record_digest(*values: Column) -> Column:
    """SHA-256 (hex) of a record: each value as its UTF-8 byte count, a colon and the value; ``-`` if null."""
    parts = []
    for value in values:
        v = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def group_key(source: Column) -> Column:
    """A group's name without nulls, in the order of its UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


@dataclass
class Tree:
    """Levels 1 and up of a forest with one tree for each group, in a folder partitioned by level.

    A row is a node: g, run (its place in the level), members (pos, digest and, on level 1, the
    leaf's ``entry``), digest, lone (a group of a single leaf, which is its own root) and wide
    (the nodes that its group has on this level).
    """

    path: str
    levels: list[DataFrame] = field(default_factory=list)

    def roots(self) -> DataFrame:
        """g, digest: the root of every group."""
        tops = [level.where("wide = 1").select("g", "digest") for level in self.levels]
        out = tops[0]
        for top in tops[1:]:
            out = out.unionByName(top)
        return out


def _written(level: DataFrame, path: str, k: int) -> DataFrame:
    at = f"{path}/level={k}"
    with small_batches(level.sparkSession):
        level.sortWithinPartitions("g", "run").write.parquet(at)
    return level.sparkSession.read.schema(level.schema).parquet(at)


def grown(leaves: DataFrame) -> Tree:
    """The tree over ``leaves``: g, pos (0-based within g), digest, entry."""
    tree = Tree(scratch_path(leaves.sparkSession, "nodes"))
    up = lambda place: F.shiftright(F.col(place), 4).alias("run")
    joined = F.sha2(F.array_join(F.transform("members", lambda m: m["digest"]), ""), 256)
    totals = stored(leaves.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "totals")
    rows, most = totals.agg(F.sum("n"), F.max("n")).first()
    level = leaves.groupBy("g", up("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "entry"))).alias("members"))
    level = told_by_group(level, totals, ["g"], "n", rows or 0)
    digest = F.when(F.col("n") == 1, F.col("members")[0]["digest"]).otherwise(joined)
    wide = F.expr(f"(n + {RUN - 1}) DIV {RUN}")
    tree.levels.append(_written(level.select("g", "run", "members", digest.alias("digest"), (F.col("n") == 1).alias("lone"), wide.alias("wide")), tree.path, 1))
    most = -(-(most or 0) // RUN)
    while most > 1:
        level = tree.levels[-1].where("wide > 1").withColumnRenamed("run", "_at").withColumn("run", F.shiftright("_at", 4))
        members = F.array_sort(F.collect_list(F.struct(F.col("_at").alias("pos"), "digest"))).alias("members")
        level = level.groupBy("g", "run").agg(members, F.max(F.expr(f"(wide + {RUN - 1}) DIV {RUN}")).alias("wide"))
        tree.levels.append(_written(level.select("g", "run", "members", joined.alias("digest"), F.lit(False).alias("lone"), "wide"), tree.path, len(tree.levels) + 1))
        most = -(-most // RUN)
    return tree


def proofs(tree: Tree, tops: DataFrame, name: str) -> DataFrame:
    """leaf, entry, path and the columns of ``tops`` for every leaf, and its group's root as ``name``.

    tops: g, path (from the group's root up) and any other columns; one row per group.
    """
    carried = [c for c in tops.columns if c not in ("g", "path")]
    below = None
    for k in range(len(tree.levels), 0, -1):
        level = tree.levels[k - 1]
        known = level.where("wide = 1").join(tops, "g").withColumn(name, F.col("digest"))
        if below is not None:
            known = known.unionByName(level.where("wide > 1").join(below.hint("merge"), ["g", "run"]))
        digests = F.transform("members", lambda m: m["digest"])
        kept = ["g", "lone", "path", *carried, name, digests.alias("_digests")]
        each = known.select(*kept, F.posexplode("members").alias("_i", "_member"))
        left = F.array_join(F.slice("_digests", F.lit(1), F.col("_i")), "")
        right = F.array_join(F.slice("_digests", F.col("_i") + 2, F.lit(RUN)), "")
        step = F.struct(left.alias("left"), right.alias("right"))
        path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(step), F.col("path"))).alias("path")
        if k > 1:
            below = stored(each.select("g", F.col("_member.pos").alias("run"), path, *carried, name), "paths")
    return each.select(F.col("_member.digest").alias("leaf"), "_member.entry", path, *carried, name)


def siblings_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, fields: list[str], id_col: str, group_col: str, extra: dict[str, Column] | None = None) -> tuple[Tree, Tree]:
    """The trees of a dataset: one over the rows of each group, and one over the groups' roots.

    A leaf is the record digest of ``fields`` (nulls are ``-``); its entry holds id and the
    columns ``extra``. Leaves of a group ascend by id, nulls first, equal ids by leaf; a null
    group is a group of its own and the first. An empty table has trees without nodes. Columns
    that are not named are ignored. Rows equal in group, id and leaf lie in one sorted run.
    """
    leaf = record_digest(*(F.col(c) for c in fields))
    entry = F.struct(F.col(id_col).alias("id"), *(c.alias(n) for n, c in (extra or {}).items()))
    rows = stored(docs.select(group_key(F.col(group_col)).alias("g"), F.col(id_col).alias("id"), leaf.alias("digest"), entry.alias("entry")), "leaves")
    own = grown(numbered(rows, "g", ["id", "digest"]))
    roots = stored(own.roots().select(F.lit("").alias("g"), F.col("g").alias("id"), "digest", F.struct(F.col("g").alias("id")).alias("entry")), "roots")
    return own, grown(numbered(roots, "g", ["id"]))


def row_proofs(trees: tuple[Tree, Tree]) -> DataFrame:
    """leaf, entry, path, subroot, root of every row: its group's root, the dataset's, and the way from the leaf to it."""
    own, top = trees
    spark = own.levels[0].sparkSession
    over = spark.range(1).select(F.lit("").alias("g"), F.array().cast(PATH).alias("path"))
    tops = stored(proofs(top, over, "root").select(F.col("entry.id").alias("g"), "path", "root"), "tops")
    return proofs(own, tops, "subroot")


def audited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """id, leaf, path, subroot, root, forged: every row with its proof, and the leaf that its tampered row would have.

    Where 5 divides the unsigned crc32 of the id as text, the tampered row has its text's A-Z
    lower-cased (a null text stays null); elsewhere, and for a null id, ``forged`` is the leaf.
    """
    crc = F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8"))
    text = F.when(F.col(text_col).isNotNull(), lower_ascii(F.col(text_col)))
    forged = F.when(crc % 5 == 0, record_digest(*(text if c == text_col else F.col(c) for c in fields)))
    rows = row_proofs(manifest(docs, list(fields), id_col, group_col, {"forged": forged}))
    return rows.select(F.col("entry.id").alias("id"), "leaf", "path", "subroot", "root", F.coalesce("entry.forged", "leaf").alias("forged"))
