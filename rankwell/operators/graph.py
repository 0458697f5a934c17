"""Walks over rephrased queries: results end a walk, loops and the hop limit are told apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rephrase_chains(seeds: DataFrame, nodes: DataFrame, max_hops: int = 3) -> DataFrame:
    """query, final, chain, hops, hit, loop_detected, hit_max_hops for each seed.

    nodes: query, has_results, next (null: none), one row per normalised query. A node with
    results ends the walk as a hit; a missing next ends it; a next already seen is a loop, which
    is checked before the hop limit. One equi-join per hop; finished walks ride along.
    """
    n = nodes.select(F.col("query").alias("__q"), F.col("has_results").alias("__r"), F.col("next").alias("__n"))
    state = seeds.select("query", F.col("query").alias("final"), F.array("query").alias("chain"), F.lit(0).alias("hops"), F.lit("open").alias("state"))
    for _ in range(max_hops + 1):
        j = state.join(n, state["final"] == n["__q"], "left")
        ended = (
            F.when(F.col("state") != "open", F.col("state"))
            .when(F.col("__r"), "hit")
            .when(F.col("__n").isNull(), "end")
            .when(F.array_contains("chain", F.col("__n")), "loop")
            .when(F.col("hops") >= max_hops, "max")
            .otherwise("open")
        )
        go = ended == "open"
        state = j.select(
            "query",
            F.when(go, F.col("__n")).otherwise(F.col("final")).alias("final"),
            F.when(go, F.concat("chain", F.array("__n"))).otherwise(F.col("chain")).alias("chain"),
            (F.col("hops") + go.cast("int")).alias("hops"),
            ended.alias("state"),
        )
    s = F.col("state")
    return state.select("query", "final", "chain", "hops", (s == "hit").alias("hit"), (s == "loop").alias("loop_detected"), (s == "max").alias("hit_max_hops"))


def linked(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges src, dst with ``new`` ones taking the place of a source's old one; no edge to itself."""
    good = new.where("src <> dst").dropDuplicates(["src"])
    return edges.join(good.select("src"), "src", "left_anti").unionByName(good.select(*edges.columns))
