"""From chosen candidates to edge paths, their geometry and the rows of a match result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as G
from wayfold.operators.routing import routed_pairs

NO_EDGES = "cast(array() as array<bigint>)"

#: Values that stand for missing ones in result files (fixed values of the format).
NO_DISTANCE, NO_SCORE = -1.0, -999.0


def path_steps(chosen: DataFrame, od: DataFrame, reverse_tolerance: float = 0.0) -> DataFrame:
    """Adds step: the edges entered between the point before and this one; null where there is no way.

    chosen has one row for each point (traj_id, seq, edge_id, source, target, length, offset); od has path.
    """
    w = Window.partitionBy("traj_id").orderBy("seq")
    before = {f"{c}_a": F.lag(c).over(w) for c in ("edge_id", "target", "offset", "length")}
    d = chosen.withColumns(before).withColumn("first", F.row_number().over(w) == 1)
    ways = od.select(F.col("source").alias("target_a"), F.col("target").alias("w_target"), F.col("path").alias("between"))
    d = d.join(ways, (d["target_a"] == ways["target_a"]) & (d["source"] == ways["w_target"]), "left").drop(ways["target_a"]).drop("w_target")
    own = F.array(F.col("edge_id").cast("long"))
    none = F.expr(NO_EDGES)
    back = F.col("offset_a") - F.col("offset")
    step = (
        F.when(F.col("first"), own)
        .when((F.col("edge_id") == F.col("edge_id_a")) & ((back <= 0) | (back < F.col("length") * reverse_tolerance)), none)
        .when(F.col("edge_id") == F.col("edge_id_a"), own)
        .when(F.col("target_a") == F.col("source"), own)
        .when(F.col("between").isNotNull(), F.concat("between", own))
    )
    return d.withColumn("step", step).drop("between", "first", *before)


def routed_steps(chosen: DataFrame, edges: DataFrame, limit: float, reverse_tolerance: float = 0.0) -> DataFrame:
    """path_steps with a route of any length between successive points, for matches without a path table.

    limit is where the search starts; it is doubled for the pairs that need more.
    """
    w = Window.partitionBy("traj_id").orderBy("seq")
    pairs = chosen.select(F.lag("target").over(w).alias("source"), F.col("source").alias("target")).filter("source IS NOT NULL")
    return path_steps(chosen, routed_pairs(edges, pairs, limit), reverse_tolerance)


def complete_paths(steps: DataFrame) -> DataFrame:
    """(traj_id, opath, cpath, indices): matched edges, the edges travelled, and each point's place in them (from 0).

    A gap empties the whole path.
    """
    place = F.sum(F.size("step")).over(Window.partitionBy("traj_id").orderBy("seq")).cast("int") - 1
    turn = F.struct("seq", F.col("edge_id").cast("long").alias("edge_id"), "step", "place")
    turns = steps.withColumn("place", place).groupBy("traj_id").agg(F.array_sort(F.collect_list(turn)).alias("ts"))
    broken = F.exists("ts", lambda t: t["step"].isNull())
    cpath = F.flatten(F.transform("ts", lambda t: t["step"]))
    return turns.select(
        "traj_id",
        F.transform("ts", lambda t: t["edge_id"]).alias("opath"),
        F.when(broken, F.expr(NO_EDGES)).otherwise(cpath).alias("cpath"),
        F.when(broken, F.expr("cast(array() as array<int>)")).otherwise(F.transform("ts", lambda t: t["place"])).alias("indices"),
    )


def traversed(paths: DataFrame) -> DataFrame:
    """Adds tpath: for each step the slice of cpath from one point's edge to the next one's, as 1,2|2,3 text."""
    pairs = F.zip_with(F.slice("indices", F.lit(1), F.greatest(F.size("indices") - 1, F.lit(0))), F.slice("indices", F.lit(2), F.greatest(F.size("indices") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    text = F.transform(pairs, lambda p: F.array_join(F.transform(F.slice("cpath", p["a"] + 1, p["b"] - p["a"] + 1), lambda e: e.cast("string")), ","))
    return paths.withColumn("tpath", F.array_join(text, "|"))


def geometry(paths: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(traj_id, mgeom): the line of cpath, cut at the offsets of the first and the last point (ends: traj_id, first_offset, last_offset)."""
    parts = paths.select("traj_id", F.posexplode("cpath").alias("pos", "edge_id")).join(edges.select(F.col("edge_id").cast("long").alias("edge_id"), "line", "length"), "edge_id")
    lines = parts.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "length"))).alias("ls")).join(ends, "traj_id")
    n = F.size("ls")
    start = lambda p: F.when(p["pos"] == 0, F.col("first_offset")).otherwise(F.lit(0.0))
    stop = lambda p: F.when(p["pos"] == n - 1, F.col("last_offset")).otherwise(p["length"])
    cut = lambda p: F.when((p["pos"] > 0) & (p["pos"] < n - 1), p["line"]).otherwise(G.substring(p["line"], start(p), stop(p)))
    pieces = F.transform("ls", lambda p: F.when(p["pos"] == 0, cut(p)).otherwise(F.slice(cut(p), 2, 1_000_000_000)))
    whole = F.flatten(pieces)
    return lines.select("traj_id", whole.alias("mgeom"))


def point_rows(matched: DataFrame, paths: DataFrame, points: DataFrame) -> DataFrame:
    """A row for each point of each trajectory: matched values, or the format's stand-ins for missing ones."""
    chosen = matched.filter("chosen").select("traj_id", "seq", "edge_id", "ep", "tp", "sp", "eu", "cumu", "trust", "dist", "offset")
    rows = points.select("traj_id", "seq", "x", "y").join(chosen, ["traj_id", "seq"], "left").join(paths.select("traj_id", "cpath", "indices"), "traj_id", "left")
    travelled = F.try_element_at("cpath", F.try_element_at("indices", F.col("seq").cast("int") + 1) + 1)
    missing = {"ep": NO_DISTANCE, "tp": NO_DISTANCE, "sp": NO_DISTANCE, "eu": NO_DISTANCE, "dist": NO_DISTANCE, "offset": NO_DISTANCE, "cumu": NO_SCORE, "trust": NO_SCORE}
    out = rows.withColumn("matched", F.col("edge_id").isNotNull()).withColumn("cpath_edge", F.coalesce(travelled, F.lit(-1)))
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in missing.items()} | {"edge_id": F.coalesce("edge_id", F.lit(-1))}).drop("cpath", "indices")


def realigned(values: DataFrame, column: str, missing: float = NO_DISTANCE) -> DataFrame:
    """(traj_id, seq, column) for all original positions, gaps filled."""
    last = values.groupBy("traj_id").agg(F.max("seq").alias("last"))
    places = last.select("traj_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("seq"))
    return places.join(values.select("traj_id", "seq", column), ["traj_id", "seq"], "left").withColumn(column, F.coalesce(column, F.lit(missing)))


def durations(rows: DataFrame, t: str = "t", way: str = "sp") -> DataFrame:
    """Adds duration (seconds since the point before, 0 at the first) and speed (way by duration, 0 without one)."""
    w = Window.partitionBy("traj_id").orderBy("seq")
    d = F.coalesce(F.col(t) - F.lag(t).over(w), F.lit(0.0))
    return rows.withColumn("duration", d).withColumn("speed", F.when(F.col("duration") > 0, F.col(way) / F.col("duration")).otherwise(F.lit(0.0)))
