"""From points, texts or files to match results in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geometry as G
from wayfold.operators import covariance, matching, paths, routing
from wayfold.operators.counts import Counts, rows, rows_where
from wayfold.operators.shared import checkpointed
from wayfold.sources import files, text_tables

#: Columns of a result that can be written, and those that are without being asked for (fixed names of the format).
FIELDS = ("opath", "cpath", "tpath", "indices", "mgeom", "pgeom", "offset", "error", "spdist", "ep", "tp", "eu_dist", "trustworthiness", "cumu_prob", "length")
DEFAULT_FIELDS = ("cpath", "mgeom")


@dataclass(frozen=True)
class Network:
    """Edges and, once made, the path table up to a distance."""

    edges: DataFrame
    od: DataFrame

    @staticmethod
    def of(edges: DataFrame, limit: float) -> Network:
        return Network(edges, checkpointed(routing.od_table(edges, limit)))


def match_points(points: DataFrame, network: Network, config: matching.MatchConfig) -> DataFrame:
    """One row for each trajectory of (traj_id, seq, x, y) that has a match: all of FIELDS.

    Trajectories with a point that has no candidate, or of fewer than two points, are absent; where no way leads on,
    cpath and what follows from it are empty.
    """
    found = checkpointed(matching.fast_match(points, network.edges, network.od, config))
    steps = paths.path_steps(found.filter("chosen"), network.od, config.reverse_tolerance)
    return _results(found, steps, network.edges)


def match_on_the_fly(points: DataFrame, edges: DataFrame, config: matching.MatchConfig, radius: float = 1000.0) -> DataFrame:
    """The same without a path table: ways are searched within each step's own limit (by its time, if points have t).

    radius is what the search for ways between matched edges, from both ends, starts with.
    """
    found = checkpointed(matching.st_match(points, edges, config))
    return _results(found, paths.routed_steps(found.filter("chosen"), edges, radius, config.reverse_tolerance), edges)


def _results(found: DataFrame, steps: DataFrame, edges: DataFrame) -> DataFrame:
    chosen = found.filter("chosen").join(edges.select("edge_id", "line"), "edge_id")
    done = paths.traversed(paths.complete_paths(steps))
    ends = chosen.groupBy("traj_id").agg(F.min_by("offset", "seq").alias("first_offset"), F.max_by("offset", "seq").alias("last_offset"))
    lines = paths.geometry(done, edges, ends)
    names = {"offset": "offset", "error": "dist", "spdist": "sp", "ep": "ep", "tp": "tp", "eu_dist": "eu", "trustworthiness": "trust", "cumu_prob": "cumu", "length": "length"}
    one = F.struct("seq", G.locate("line", "offset").alias("pgeom"), *(F.col(c).alias(n) for n, c in names.items()))
    lists = chosen.groupBy("traj_id").agg(F.array_sort(F.collect_list(one)).alias("ps"))
    lists = lists.select("traj_id", *(F.col(f"ps.{n}").alias(n) for n in ("pgeom", *names)))
    return done.join(lists, "traj_id").join(lines, "traj_id", "left").select("traj_id", *FIELDS)


#: Columns of a covariance-aware match: a row for each matched point, and for each failed one.
POINT_FIELDS = ("traj_id", "seq", "part", "status", "edge_id", "ep", "tp", "sp", "eu", "cumu", "trust", "entropy")


def match_covariance_points(points: DataFrame, network: Network, config: covariance.CovarianceConfig, cell: float, threshold: float | None = None) -> DataFrame:
    """POINT_FIELDS of points (traj_id, seq, t, x, y, sde, sdn, sdne, pl). cell is the side of the search grid; with a
    threshold, points of less trust are left out."""
    found = covariance.covariance_match(points, network.edges, network.od, config, cell)
    found = found if threshold is None else covariance.trusted(checkpointed(found), threshold)
    return found.filter("chosen OR edge_id IS NULL AND status LIKE 'FAILED%'").select(*POINT_FIELDS)


def match_covariance_file(spark: SparkSession, gps: str, network: Network | str, result: str, config: covariance.CovarianceConfig, cell: float, limit: float = 3000.0, threshold: float | None = None, counts: Counts | None = None) -> DataFrame:
    """Matches a file of trajectories with covariances (one row each, with a column geom) or of points with covariances,
    and writes POINT_FIELDS by trajectory and point; returns them.

    counts, if given, takes along: points read, rows_read and rows_rejected (trajectories whose columns don't fit), and
    matched and failed points of the result.
    """
    counts = counts or Counts()
    net = Network.of(files.read_any_network(spark, network), limit) if isinstance(network, str) else network
    whole = "geom" in {c.strip().lower() for c in text_tables.read_delimited(spark, gps).columns}
    if whole:
        read = text_tables.read_covariance_trajectories(spark, gps)
        points = text_tables.covariance_points(counts.along(read, rows_read=rows(), rows_rejected=rows_where(~F.col("valid"))))
    else:
        points = text_tables.read_covariance_points(spark, gps)
    points = checkpointed(counts.along(points.select("traj_id", "seq", "t", "x", "y", "sde", "sdn", "sdne", "pl"), points=rows()))
    found = match_covariance_points(points, net, config, cell, threshold)
    done = checkpointed(counts.along(found, matched=rows_where(F.col("edge_id").isNotNull()), failed=rows_where(F.col("edge_id").isNull())))
    done.orderBy("traj_id", "seq").write.mode("overwrite").csv(result, sep=";", header=True)
    return done


def points_of(lines: DataFrame) -> DataFrame:
    """(traj_id, seq, x, y) of (traj_id, line)."""
    d = lines.select("traj_id", F.posexplode("line").alias("seq", "p"))
    return d.select("traj_id", F.col("seq").cast("long").alias("seq"), "p.x", "p.y")


def lines_of(spark: SparkSession, wkt: str | list[str]) -> DataFrame:
    """(traj_id, line) of texts of lines, numbered from 0; other texts are left out."""
    texts = [wkt] if isinstance(wkt, str) else wkt
    rows = spark.createDataFrame(list(enumerate(texts)), "traj_id long, wkt string")
    return rows.select("traj_id", G.from_wkt("wkt").alias("line")).filter("line IS NOT NULL")


def match_lines(lines: DataFrame, network: Network, config: matching.MatchConfig) -> DataFrame:
    """match_points for (traj_id, line)."""
    return match_points(points_of(lines), network, config)


def match_wkt(wkt: str | list[str], network: Network, config: matching.MatchConfig) -> DataFrame:
    """match_points for texts of lines, numbered from 0."""
    return match_lines(lines_of(network.edges.sparkSession, wkt), network, config)


def match_wkt_on_the_fly(wkt: str | list[str], edges: DataFrame, config: matching.MatchConfig, radius: float = 1000.0) -> DataFrame:
    """match_on_the_fly for texts of lines, numbered from 0."""
    return match_on_the_fly(points_of(lines_of(edges.sparkSession, wkt)), edges, config, radius)


def fields_of(names: tuple[str, ...] | str | None) -> tuple[str, ...]:
    """Columns to write, with traj_id: "all", the default, or a choice; unknown names are an error."""
    if names is None:
        chosen = DEFAULT_FIELDS
    elif names == "all" or tuple(names) == ("all",):
        chosen = FIELDS
    else:
        chosen = tuple(x.strip() for x in names.split(",")) if isinstance(names, str) else tuple(names)
    unknown = [c for c in chosen if c not in FIELDS]
    if unknown:
        raise ValueError(f"unknown result fields {unknown}; known are {FIELDS}")
    return ("traj_id", *(c for c in FIELDS if c in chosen))


def match_file(
    spark: SparkSession, gps: str, network: Network | str, result: str, config: matching.MatchConfig, limit: float = 3000.0, points: bool = False, fields: tuple[str, ...] | str | None = None, on_the_fly: bool = False, counts: Counts | None = None
) -> DataFrame:
    """Matches a file of trajectories (or of points) and writes the chosen fields; returns all of them.

    on_the_fly: without a path table; `limit` is then the radius that searches between matched edges start with.
    counts, if given, takes along: points read, trajectories of the result, those without a whole path, and matched points.
    """
    counts = counts or Counts()
    read = checkpointed(counts.along(files.read_gps(spark, gps, points), points=rows()))
    if on_the_fly:
        edges = files.read_any_network(spark, network) if isinstance(network, str) else network.edges
        found = match_on_the_fly(read, edges, config, limit)
    else:
        net = Network.of(files.read_any_network(spark, network), limit) if isinstance(network, str) else network
        found = match_points(read, net, config)
    done = checkpointed(counts.along(found, trajectories=rows(), broken=rows_where(F.coalesce(F.size("cpath"), F.lit(0)) < 1), matched=F.sum(F.size("opath"))))
    text_tables.write_matches(done, result, fields_of(fields))
    return done
