"""Candidate road edges of points: a grid-bucketed spatial join, nearest-k, and the rules on incomplete trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as G
from wayfold.operators.shared import by_trajectory

POINT_KEY = ("traj_id", "seq")


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def edge_segments(edges: DataFrame) -> DataFrame:
    """A row for each segment of each edge: the edge's columns without its line, no, its ends (ax, ay, bx, by) and its start along the line."""
    keep = [c for c in ("edge_id", "source", "target", "length", "oneway") if c in edges.columns]
    d = edges.select(*keep, F.posexplode(G.measured("line")).alias("no", "s"))
    return d.select(*keep, "no", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"), F.col("s.from").alias("start"))


def projected(rows: DataFrame) -> DataFrame:
    """Adds dist and offset of the point (x, y) of each row on its segment; plain columns, so all of it is generated code."""
    d = rows.withColumns({"ux": F.col("bx") - F.col("ax"), "uy": F.col("by") - F.col("ay")}).withColumn("square", F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy"))
    along = ((F.col("x") - F.col("ax")) * F.col("ux") + (F.col("y") - F.col("ay")) * F.col("uy")) / F.col("square")
    d = d.withColumn("share", F.when(F.col("square") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))))
    d = d.withColumns({"ex": F.col("ax") + F.col("share") * F.col("ux") - F.col("x"), "ey": F.col("ay") + F.col("share") * F.col("uy") - F.col("y")})
    d = d.withColumns({"dist": F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")), "offset": F.col("start") + F.col("share") * F.sqrt("square")})
    return d.drop("ux", "uy", "square", "share", "ex", "ey")


def spatial_candidates(points: DataFrame, edges: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """points x edges within the radius: adds edge_id, source, target, length, dist and offset to the points (traj_id, seq, x, y, ...).

    A segment is listed in each grid cell that its padded box touches; a point lies in one cell, so the join is an
    equi-join that yields each pair once. A hot cell is a skewed join key, which Spark splits. What is near is dealt
    out by trajectory; the least distance of each edge and all that follows need no other shuffle.
    """
    size = cell or max(2 * radius, 1e-9)
    low = lambda p, q: F.least(p, q) - radius
    high = lambda p, q: F.greatest(p, q) + radius
    span = lambda p, q: F.sequence(_cell(low(p, q), size), _cell(high(p, q), size))
    tiles = edge_segments(edges).withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
    at = points.withColumn("cx", _cell(F.col("x"), size)).withColumn("cy", _cell(F.col("y"), size))
    met = at.join(tiles, ["cx", "cy"]).filter(F.col("x").between(low("ax", "bx"), high("ax", "bx")) & F.col("y").between(low("ay", "by"), high("ay", "by"))).drop("cx", "cy")
    near = by_trajectory(projected(met).filter(F.col("dist") <= radius).drop("ax", "ay", "bx", "by", "start"))
    best = near.groupBy(*POINT_KEY, "edge_id").agg(F.first(F.struct(*points.columns, "source", "target", "length")).alias("row"), F.min(F.struct("dist", "no", "offset")).alias("n"))
    return best.select(*(F.col(f"row.{c}").alias(c) for c in points.columns), "edge_id", "row.source", "row.target", "row.length", F.col("n.dist").alias("dist"), F.col("n.offset").alias("offset"))


def nearest(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest candidates of each point; adds cand, their order from 1 (distance, then edge id)."""
    order = Window.partitionBy(*POINT_KEY).orderBy("dist", "edge_id")
    return candidates.withColumn("cand", F.row_number().over(order)).filter(F.col("cand") <= k)


def complete_trajectories(candidates: DataFrame, points: DataFrame, least: int = 2) -> DataFrame:
    """Candidates of trajectories all of whose points have some, and that have `least` points or more."""
    have = candidates.select(*POINT_KEY).distinct().groupBy("traj_id").agg(F.count("*").alias("have"))
    whole = points.groupBy("traj_id").agg(F.count("*").alias("all")).join(have, "traj_id").filter((F.col("have") == F.col("all")) & (F.col("all") >= least))
    return candidates.join(whole.select("traj_id"), "traj_id", "left_semi")


def whole_trajectories(candidates: DataFrame, least: int = 2) -> DataFrame:
    """complete_trajectories of candidates with `cand` whose rows tell the number of their trajectory's points (column points); no shuffle of its own."""
    own = Window.partitionBy("traj_id")
    have = candidates.withColumn("have", F.count(F.when(F.col("cand") == 1, 1)).over(own))
    return have.filter((F.col("have") == F.col("points")) & (F.col("points") >= least)).drop("have", "points")


def counted(points: DataFrame) -> DataFrame:
    """Adds points, the number of points of the row's trajectory."""
    return points.withColumn("points", F.count("*").over(Window.partitionBy("traj_id")))
