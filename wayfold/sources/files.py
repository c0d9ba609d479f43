"""Readers chosen by a file's extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources import shapefile, text_tables


def extension(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


def _unknown(path: str) -> ValueError:
    return ValueError(f"no reader for the extension of {path}: csv, txt, geojson, json, shp, gpkg or parquet")


def read_any_network(spark: SparkSession, path: str) -> DataFrame:
    """Edges from delimited text, GeoJSON, a shapefile, a GeoPackage or a Parquet table in the form of the text reader's result."""
    kind = extension(path)
    if kind in ("csv", "txt"):
        return text_tables.read_network(spark, path)
    if kind in ("geojson", "json"):
        return text_tables.read_geojson_network(spark, path)
    if kind in ("shp", "gpkg"):
        return shapefile.read_network(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise _unknown(path)


def read_geojson_lines(spark: SparkSession, path: str, id_column: str = "id") -> DataFrame:
    """(traj_id, line, times) of a GeoJSON feature collection of lines; features without a number as id are dropped."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<double>>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).filter("f.geometry.type = 'LineString'")
    line = F.transform("f.geometry.coordinates", lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    d = raw.select(F.col("f.properties")[id_column].try_cast("long").alias("traj_id"), line.alias("line"), F.lit(None).cast("array<double>").alias("times"))
    return d.filter("traj_id IS NOT NULL")


def read_gps(spark: SparkSession, path: str, points: bool = False) -> DataFrame:
    """Points (traj_id, seq, x, y, t) of a file of trajectories or, with points, of single positions."""
    kind = extension(path)
    if kind in ("csv", "txt") and points:
        # an id that comes back is another trajectory
        return text_tables.read_points(spark, path).select(F.xxhash64("id", "run").alias("traj_id"), "seq", "x", "y", "t")
    if kind in ("csv", "txt"):
        return text_tables.exploded(text_tables.read_trajectories(spark, path))
    if kind in ("geojson", "json"):
        return text_tables.exploded(read_geojson_lines(spark, path))
    if kind in ("shp", "gpkg"):
        return text_tables.exploded(shapefile.read_trajectories(spark, path))
    if kind == "parquet":
        return spark.read.parquet(path)
    raise _unknown(path)
