"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step is an aggregation with a map-side part and a join, both of which Spark can split at a hot node; the
lineage is cut through the shared folder, and a step's table is deleted when the next one is written. Steps
number O(log^2 n) at worst and few in practice; an edge list that is made of stars already needs none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import Scratch, dropped


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) long pairs -> (node, root): root is the smallest node of the component. Nodes without edges are absent."""
    e = scratch.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(e):
        after = scratch.stored(_small_star(_large_star(e)))
        dropped(e)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none."""
    hang = e.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("n"))
    chained = hang.join(hang.select(F.col("u").alias("m")), "m", "left_semi").select("u")
    return not hang.filter("m <> n").select("u").unionByName(chained).head(1)


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour (or itself)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked with its smallest one. Edges have u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def merged_roots(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components after more links: only the roots that these tie together are worked on."""
    tied = rooted(links, roots).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    moved = scratch.stored(components(tied, scratch).withColumnRenamed("root", "to"))
    known = roots.unionByName(moved.select("node", F.col("node").alias("root"))).dropDuplicates(["node"])
    return known.join(moved.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root_a and root_b; a node without links is its own root."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs
