"""Matching of trajectories to hexagonal cells instead of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import hexagons


def match_cells(points: DataFrame, size: float, level: int = 0, fill: bool = True) -> DataFrame:
    """(traj_id, seq, step, cell): the cells that a trajectory's points (traj_id, seq, x, y) enter, repeats dropped.

    With `fill` the cells on the line from the cell before are put in; `step` counts them within a point from 1, and
    the first point has step 0. Points without coordinates are left out. One window by trajectory, nothing is collected.
    """
    w = Window.partitionBy("traj_id").orderBy("seq")
    here = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("traj_id", "seq", hexagons.at(F.col("x"), F.col("y"), size, level).alias("cell"))
    moved = here.withColumn("before", F.lag("cell").over(w)).filter(F.col("before").isNull() | (F.col("before") != F.col("cell")))
    if not fill:
        return moved.select("traj_id", "seq", F.when(F.col("before").isNull(), 0).otherwise(1).alias("step"), "cell")
    way = F.when(F.col("before").isNull(), F.array("cell")).otherwise(hexagons.path(F.col("before"), F.col("cell")))
    entered = moved.select("traj_id", "seq", F.col("before").isNull().alias("first"), F.posexplode(way).alias("step", "cell"))
    return entered.filter(F.col("first") | (F.col("step") > 0)).drop("first")


def cell_rows(matched: DataFrame, size: float, level: int = 0) -> DataFrame:
    """(traj_id, cells, geom): one row per trajectory for files, cells as numbers joined by commas, geom a MULTIPOLYGON."""
    d = matched.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("seq", "step", "cell"))).alias("all"))
    cells = F.transform("all", lambda s: s["cell"])
    text = F.array_join(F.transform(cells, lambda c: hexagons.number(c, level).cast("string")), ",")
    return d.select("traj_id", text.alias("cells"), hexagons.to_wkt(cells, size, level).alias("geom"))
