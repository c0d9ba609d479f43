"""Road networks as tables: edges (edge_id, source, target, line, length[, oneway]) and nodes (node, x, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geometry as G


def edge_table(df: DataFrame, line: Column | str = "line") -> DataFrame:
    """Adds length (of the line) and drops edges that are no lines."""
    line = F.col(line) if isinstance(line, str) else line
    return df.withColumn("line", line).filter(F.size("line") >= 2).withColumn("length", G.length("line"))


def node_table(edges: DataFrame) -> DataFrame:
    """Distinct end points of the edges."""
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), first.alias("p")), F.struct(F.col("target").alias("node"), last.alias("p")))).alias("e"))
    return ends.groupBy("e.node").agg(F.min("e.p").alias("p")).select("node", "p.x", "p.y")


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more, allowMissingColumns=True)


def truthy(c: Column) -> Column:
    """One-way marks as they stand in network files."""
    return F.coalesce(F.trim(c.cast("string")).isin("T", "t", "1", "true", "True", "TRUE"), F.lit(False))


def gps_bounds(points: DataFrame, padding: float = 0.0) -> DataFrame:
    """One row: the box of all points, padded."""
    return points.agg((F.min("x") - padding).alias("min_x"), (F.min("y") - padding).alias("min_y"), (F.max("x") + padding).alias("max_x"), (F.max("y") + padding).alias("max_y"))


def in_box(edges: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Edges whose bounding box meets the given box."""
    box = G.bounding_box("line")
    return edges.filter((box["min_x"] <= max_x) & (box["max_x"] >= min_x) & (box["min_y"] <= max_y) & (box["max_y"] >= min_y))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """(edge_id, reverse_id): the edge that runs between the same nodes the other way (smallest id)."""
    back = edges.select(F.col("edge_id").alias("reverse_id"), F.col("source").alias("target"), F.col("target").alias("source"))
    return edges.join(back, ["source", "target"]).groupBy("edge_id").agg(F.min("reverse_id").alias("reverse_id"))
