"""Connected components by contraction within tasks, star minima and pointer jumps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, stored

#: Edges that a task contracts at a time. Bounds memory only.
CHUNK_EDGES = 1 << 19


def contracted(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """A forest of stars with the same components: each node but the smallest of its component, and that smallest."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while (above := up.get(x, x)) != top:
            up[x], x = top, above
        return top

    for x, y in zip(a, b, strict=True):
        x_top, y_top = find(x), find(y)
        if x_top < y_top:
            up[y_top] = x_top
        elif y_top < x_top:
            up[x_top] = y_top
    nodes = list(up)
    return nodes, [find(x) for x in nodes]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = [[], []]

    def stars() -> pa.RecordBatch:
        found = contracted(*(np.concatenate(x).tolist() for x in held))
        for x in held:
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    for batch in batches:
        for x, column in zip(held, batch.columns, strict=True):
            x.append(column.to_numpy(zero_copy_only=False))
        if sum(map(len, held[0])) >= CHUNK_EDGES:
            yield stars()
    if held[0]:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node in ``edges`` (long columns a, b): the smallest node it reaches.

    A round contracts the edges within each task, ties the smaller ends of a node's
    edges to the least of them, and lets every edge jump to its smaller end's parent.
    A round in which nothing moves has found a forest of stars. Each round is a written
    table, so lineage stays short. A node has at most one edge for each chunk of edges
    when minima are taken, and the jumps are a plain shuffled join, which adaptive
    execution splits where very many nodes have the same parent.
    """
    edges = stored(edges.where("a <> b").select("a", "b"), "edges")
    while True:
        least = F.min("b").over(Window.partitionBy("a"))
        tied = edges.mapInArrow(_contract, "a long, b long").withColumn("m", least)
        tied = stored(tied.select("a", "b", "m"), "tied")
        stars = tied.select("a", F.col("m").alias("b"), F.lit(False).alias("moved")).where("a <> b")
        stars = stars.unionByName(tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved")))
        parents = tied.groupBy("a").agg(F.min("m").alias("p")).select(F.col("a").alias("b"), "p")
        new = stored(stars.join(parents, "b", "left").select("a", F.coalesce("p", "b").alias("b"), (F.col("moved") | F.col("p").isNotNull()).alias("moved")), "edges")
        remove(edges)
        remove(tied)
        edges = new
        if edges.where("moved").isEmpty():
            break
        edges = edges.select("a", "b")
        edges._rankwell_path = new._rankwell_path
    own = F.explode(F.array(F.col("a"), F.col("b"))).alias("node")
    return edges.select(own, F.col("b").alias("label")).distinct()
