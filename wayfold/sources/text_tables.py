"""Delimited text sources and sinks: trajectories, points, covariances, path tables, vehicle feeds, match results.

Readers take a path that Spark reads; parsers are columns, so rows that don't parse are filtered, and may be
counted, by the plan itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as G

#: Header names under which columns may stand in covariance files (fixed values, in lower case).
ALIASES = {"covariances": ("covariances", "covariance", "covariance_json"), "protection_levels": ("protection_levels", "protection_level", "pl"), "timestamps": ("timestamps", "timestamp")}


def strict_number(text: Column | str) -> Column:
    """A double if the whole (trimmed) text is a number, else null."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    return F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), text.try_cast("double"))


def number_array(text: Column | str) -> Column:
    """A JSON array of numbers; null unless all are numbers."""
    values = F.from_json(text, "array<double>")
    return F.when(F.forall(values, lambda v: v.isNotNull()), values)


def covariance_row(text: Column | str) -> Column:
    """One covariance: a JSON array of at least six numbers, else null."""
    values = number_array(text)
    return F.when(F.size(values) >= 6, values)


def covariance_rows(text: Column | str) -> Column:
    """A JSON array of covariances; null if any has fewer than six numbers."""
    rows = F.from_json(text, "array<array<double>>")
    return F.when(F.forall(rows, lambda c: c.isNotNull() & (F.size(c) >= 6) & F.forall(c, lambda v: v.isNotNull())), rows)


def candidate_list(text: Column | str) -> Column:
    """((x,y,ep),...) as an array of structs."""
    number = r"\s*[-+0-9.eE]+\s*"
    triples = F.regexp_extract_all(text, F.lit(rf"\(({number},{number},{number})\)"), 1)
    return F.transform(F.transform(triples, lambda t: F.split(t, ",")), lambda v: F.struct(F.trim(v[0]).try_cast("double").alias("x"), F.trim(v[1]).try_cast("double").alias("y"), F.trim(v[2]).try_cast("double").alias("ep")))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A table of strings with a header; without a separator the header tells whether it is ; or a comma."""
    if sep is None:
        head = spark.read.text(path).head(1)
        sep = ";" if head and ";" in head[0][0] else ","
    return spark.read.csv(path, sep=sep, header=True)


def named(df: DataFrame, name: str) -> str:
    """The column that stands for a name, whatever its case or alias."""
    wanted = ALIASES.get(name, (name,))
    found = next((c for w in wanted for c in df.columns if c.strip().lower() == w), None)
    if found is None:
        raise ValueError(f"no column {name} among {df.columns}")
    return found


def parsed_trajectories(raw: DataFrame, id_column: str = "id", geom: str = "geom", timestamp: str = "timestamp") -> DataFrame:
    """(traj_id, line, times) of id, WKT and comma-separated times; rows without a line are dropped."""
    times = F.transform(F.split(F.col(timestamp), ","), strict_number) if timestamp in raw.columns else F.lit(None).cast("array<double>")
    return raw.select(F.col(id_column).cast("long").alias("traj_id"), G.from_wkt(geom).alias("line"), times.alias("times")).filter("line IS NOT NULL")


def read_trajectories(spark: SparkSession, path: str, **columns: str) -> DataFrame:
    return parsed_trajectories(read_delimited(spark, path, ";"), **columns)


def exploded(trajectories: DataFrame) -> DataFrame:
    """Points (traj_id, seq, x, y, t) of trajectories."""
    d = trajectories.select("traj_id", "times", F.posexplode("line").alias("seq", "p"))
    return d.select("traj_id", F.col("seq").cast("long").alias("seq"), "p.x", "p.y", F.get("times", F.col("seq")).alias("t"))


def numbered(raw: DataFrame) -> DataFrame:
    """Adds row, the place of each row in the file (from 1).

    Rows are numbered by splits of the file: each split's rows by themselves, and the splits' counts summed up, so no
    task reads the whole file.
    """
    m = F.col("_metadata")
    raw = raw.withColumns({"__file": m["file_path"], "__start": m["file_block_start"]}).withColumn("__tick", F.monotonically_increasing_id())
    raw = raw.withColumn("__own", F.row_number().over(Window.partitionBy("__file", "__start").orderBy("__tick")))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = raw.groupBy("__file", "__start").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return raw.join(splits.drop("__n"), ["__file", "__start"]).withColumn("row", F.col("__before") + F.col("__own"))


def read_points(spark: SparkSession, path: str, id_column: str = "id", x: str = "x", y: str = "y", timestamp: str = "timestamp") -> DataFrame:
    """Points in file order; successive rows of one id are one trajectory, and an id that comes back starts a new one (run)."""
    raw = numbered(read_delimited(spark, path, ";"))
    t = strict_number(timestamp) if timestamp in raw.columns else F.lit(None).cast("double")
    p = raw.select(F.col(id_column).cast("long").alias("id"), strict_number(x).alias("x"), strict_number(y).alias("y"), t.alias("t"), "row")
    # a run is what shares id and the difference of the two row numbers
    p = p.withColumn("run", F.col("row") - F.row_number().over(Window.partitionBy("id").orderBy("row")))
    return p.withColumn("seq", (F.row_number().over(Window.partitionBy("id", "run").orderBy("row")) - 1).cast("long"))


def read_covariance_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """(traj_id, line, times, covariances, levels, valid): invalid rows are marked, to be counted and filtered."""
    return parsed_covariance_trajectories(read_delimited(spark, path, ";"))


def parsed_covariance_trajectories(raw: DataFrame) -> DataFrame:
    """The same of a table of strings."""
    d = raw.select(
        F.col(named(raw, "id")).cast("long").alias("traj_id"),
        G.from_wkt(named(raw, "geom")).alias("line"),
        number_array(named(raw, "timestamps")).alias("times"),
        covariance_rows(named(raw, "covariances")).alias("covariances"),
        number_array(named(raw, "protection_levels")).alias("levels"),
    )
    n = F.size("line")
    return d.withColumn("valid", F.coalesce((F.size("times") == n) & (F.size("covariances") == n) & (F.size("levels") == n), F.lit(False)))


def covariance_points(trajectories: DataFrame) -> DataFrame:
    """Points (traj_id, seq, t, x, y, sde, sdn, sdne, pl) of valid trajectories with covariances."""
    d = trajectories.filter("valid").select("traj_id", F.posexplode("line").alias("seq", "p"), "times", "covariances", "levels")
    c, at = F.get("covariances", F.col("seq")), lambda name: F.get(name, F.col("seq"))
    return d.select("traj_id", F.col("seq").cast("long").alias("seq"), at("times").alias("t"), "p.x", "p.y", c[0].alias("sde"), c[1].alias("sdn"), c[3].alias("sdne"), at("levels").alias("pl"))


def read_covariance_points(spark: SparkSession, path: str, swap_sigmas: bool = True) -> DataFrame:
    """Points with covariances: id, timestamp, x, y, sdn, sde, protection_level (and sdne, ... as 0 where absent).

    All rows of an id are one trajectory, in the order of the file (seq). swap_sigmas keeps the east/north order that
    existing results were made with.
    """
    raw = numbered(read_delimited(spark, path))
    number = lambda name: strict_number(named(raw, name))
    extra = {c: strict_number(c) if c in raw.columns else F.lit(0.0) for c in ("sdne", "sdu", "sdeu", "sdun")}
    east, north = ("sdn", "sde") if swap_sigmas else ("sde", "sdn")
    d = raw.select(
        F.col(named(raw, "id")).cast("long").alias("traj_id"), number("timestamps").alias("t"), number("x").alias("x"), number("y").alias("y"),
        number(east).alias("sde"), number(north).alias("sdn"), *(v.alias(c) for c, v in extra.items()), number("protection_levels").alias("pl"), "row",
    )
    return d.withColumn("seq", (F.row_number().over(Window.partitionBy("traj_id").orderBy("row")) - 1).cast("long")).drop("row")


def read_od(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True, schema="source long, target long, next_n long, prev_n long, next_e long, distance double")


def write_od(od: DataFrame, path: str) -> None:
    """Path table as Parquet sorted by source, so that row groups are skipped on lookups."""
    od.repartition("source").sortWithinPartitions("source", "target").write.parquet(path)


def clean_feed(raw: DataFrame, line: str, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    """Vehicle feed rows (vehicle, stamp, speed, lon, lat) of exactly five fields within the bounds."""
    parts = F.split(F.col(line), ",")
    d = raw.withColumn("__p", parts).filter(F.size("__p") == 5)
    d = d.withColumns({"vehicle": F.col("__p")[0], "stamp": F.col("__p")[1], "speed": strict_number(F.col("__p")[2]), "lon": strict_number(F.col("__p")[3]), "lat": strict_number(F.col("__p")[4])})
    return d.drop("__p", line).filter(F.col("lon").between(min_lon, max_lon) & F.col("lat").between(min_lat, max_lat))


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """Edges from delimited text: id, source, target, geom (WKT) and perhaps oneway."""
    from wayfold.operators.network import edge_table, truthy

    raw = read_delimited(spark, path)
    missing = {"id", "source", "target", "geom"} - set(raw.columns)
    if missing:
        raise ValueError(f"network without {sorted(missing)}")
    oneway = truthy(F.col("oneway")) if "oneway" in raw.columns else F.lit(False)
    d = raw.select(F.col("id").cast("long").alias("edge_id"), F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), G.from_wkt("geom").alias("line"), oneway.alias("oneway"))
    return edge_table(d)


def read_geojson_network(spark: SparkSession, path: str) -> DataFrame:
    """Edges from a GeoJSON feature collection of lines with id, source and target."""
    from wayfold.operators.network import edge_table, truthy

    schema = "features array<struct<properties:struct<id:string,source:string,target:string,oneway:string>,geometry:struct<type:string,coordinates:array<array<double>>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).filter("f.geometry.type = 'LineString'")
    line = F.transform("f.geometry.coordinates", lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    p = F.col("f.properties")
    return edge_table(raw.select(p["id"].cast("long").alias("edge_id"), p["source"].cast("long").alias("source"), p["target"].cast("long").alias("target"), line.alias("line"), truthy(p["oneway"]).alias("oneway")))


def write_matches(rows: DataFrame, path: str, fields: tuple[str, ...] = ("traj_id", "cpath", "mgeom")) -> None:
    """Match results as ;-separated text, sorted by trajectory; arrays are comma lists, lines WKT."""
    kinds = dict(rows.dtypes)

    def text(c: str) -> Column:
        if kinds[c].startswith("array<struct<x"):
            return G.to_wkt(c)
        if kinds[c].startswith("array"):
            return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
        return F.col(c).cast("string")

    rows.orderBy("traj_id").select(*(text(c).alias(c) for c in fields)).write.csv(path, sep=";", header=True)
