"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvane.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them: those above the node (large) or not above it."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))  # u >= v always
    linked = both.join(least, "n")
    if large:
        out = linked.where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        out = linked.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and component (its least reachable node) for every node with an edge, as a written table. edges: a, b, both long.

    Each step is written to the shared folder, so lineage stays short and lost executors cost one step. A hot node's
    neighbours meet in joins that Spark can split and in minima that are formed before the shuffle."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most):
        # settled: every edge leads from a node to a least one, which has no edge down, and each node has one
        facts = e.agg(F.count("*").alias("n"), F.countDistinct("u").alias("up")).first()
        if facts["n"] == facts["up"] and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").take(1):
            out = materialize(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
            discard(e)
            return out
        stepped = materialize(_star(e, True), "edges")
        discard(e)
        e = materialize(_star(stepped, False), "edges")
        discard(stepped)
    raise RuntimeError(f"components have not settled in {most} rounds")
