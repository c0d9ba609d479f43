"""Queries on lines, coordinates and text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geodesy as D
from wayfold.functions import geometry as G
from wayfold.operators import alignment, network
from wayfold.plans import demo
from wayfold.plans.checks import r, sql
from wayfold.sources import nmea, text_tables

Spark, Frame = SparkSession, DataFrame
STEP = 0.8


def consecutive_distance(spark: Spark, sf: str) -> Frame:
    d = demo.lines(spark, sf).select("traj_id", F.posexplode(G.segment_lengths("line")).alias("no", "len"))
    return d.select("traj_id", F.col("no").cast("long").alias("no"), r("len").alias("len"))


def trajectory_length(spark: Spark, sf: str) -> Frame:
    return demo.lines(spark, sf).select("traj_id", r(G.length("line")).alias("len"))


def reverse_geometry(spark: Spark, sf: str) -> Frame:
    d = demo.lines(spark, sf).select("traj_id", F.posexplode(F.reverse("line")).alias("no", "p"))
    return d.select("traj_id", F.col("no").cast("long").alias("no"), r("p.x").alias("x"), r("p.y").alias("y"))


def split_line(spark: Spark, sf: str) -> Frame:
    d = demo.lines(spark, sf).select("traj_id", F.posexplode(G.split_every(F.col("line"), F.lit(STEP))).alias("no", "piece"))
    return d.select("traj_id", F.col("no").cast("long").alias("no"), r(G.length("piece")).alias("len"))


def interpolate_distances(spark: Spark, sf: str) -> Frame:
    at = F.array(F.lit(0.25), F.lit(1.0), F.lit(2.6))
    d = demo.lines(spark, sf).filter(F.size("line") > 1).select("traj_id", F.posexplode(G.points_at(F.col("line"), at)).alias("no", "p"))
    return d.select("traj_id", F.col("no").cast("long").alias("no"), r("p.x").alias("x"), r("p.y").alias("y"))


def interpolate_every(spark: Spark, sf: str) -> Frame:
    d = demo.lines(spark, sf).select("traj_id", F.size(G.points_every(F.col("line"), F.lit(STEP))).cast("long").alias("n"))
    return d


def bounding_box(spark: Spark, sf: str) -> Frame:
    b = G.bounding_box("line")
    return demo.lines(spark, sf).select("traj_id", *(r(b[c]).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


def length_to_end(spark: Spark, sf: str) -> Frame:
    d = demo.lines(spark, sf).select("traj_id", F.posexplode(G.lengths_to_end("line")).alias("seq", "rest"))
    return d.select("traj_id", F.col("seq").cast("long").alias("seq"), r("rest").alias("rest"))


def closest_point_on_segment(spark: Spark, sf: str) -> Frame:
    p = demo.points(spark, sf)
    near = G.closest_on_segment(F.col("x"), F.col("y"), G.point(F.lit(1.0), F.lit(0.0)), G.point(F.lit(4.0), F.lit(2.0)))
    return p.select("event_id", r(near["dist"]).alias("dist"), r(near["offset"]).alias("offset"))


PROBE = (2.2, 1.1)


def linear_referencing(spark: Spark, sf: str) -> Frame:
    ref = G.linear_reference("line", F.lit(PROBE[0]), F.lit(PROBE[1]))
    return demo.lines(spark, sf).filter(F.size("line") > 1).select("traj_id", r(ref["dist"]).alias("dist"), r(ref["offset"]).alias("offset"))


def locate_point_by_offset(spark: Spark, sf: str) -> Frame:
    p = G.locate("line", F.lit(1.3))
    return demo.lines(spark, sf).filter(F.size("line") > 1).select("traj_id", r(p["x"]).alias("x"), r(p["y"]).alias("y"))


def line_substring(spark: Spark, sf: str) -> Frame:
    part = G.substring("line", F.lit(0.5), F.lit(2.0))
    return demo.lines(spark, sf).filter(F.size("line") > 1).select("traj_id", r(G.length(part)).alias("len"), F.size(part).cast("long").alias("n"))


def point_on_polyline(spark: Spark, sf: str) -> Frame:
    ref = G.linear_reference("line", F.lit(PROBE[0]), F.lit(PROBE[1]))
    return demo.lines(spark, sf).filter(F.size("line") > 1).select("traj_id", (ref["dist"] <= 0.9).alias("near"))


def dedup_consecutive(spark: Spark, sf: str) -> Frame:
    return demo.lines(spark, sf).select("traj_id", F.size(G.without_repeats("line", 0.3)).cast("long").alias("n"))


def densify(spark: Spark, sf: str) -> Frame:
    """Points added on each segment so that none is longer than the bound."""
    return demo.lines(spark, sf).select("traj_id", F.size(G.densified("line", F.lit(0.25))).cast("long").alias("n"))


def wkt_roundtrip(spark: Spark, sf: str) -> Frame:
    d = demo.lines(spark, sf).withColumn("back", G.from_wkt(G.to_wkt("line")))
    return d.select("traj_id", G.same_line(F.col("line"), F.col("back")).alias("same"), F.size("back").cast("long").alias("n"), r(G.length("back")).alias("len"))


def geojson_export(spark: Spark, sf: str) -> Frame:
    text = G.to_geojson("line")
    d = demo.lines(spark, sf).select("traj_id", F.get_json_object(text, "$.type").alias("kind"), F.from_json(F.get_json_object(text, "$.coordinates"), "array<array<double>>").alias("c"))
    return d.select("traj_id", "kind", F.size("c").cast("long").alias("n"), r(F.aggregate("c", F.lit(0.0), lambda s, p: s + p[0])).alias("sum_x"))


def wkt_trajectory_scan(spark: Spark, sf: str) -> Frame:
    """Lines as text with times, read back through the parser of the trajectory reader."""
    p = demo.points(spark, sf).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "t"))).alias("ps"))
    geom = G.to_wkt(F.transform("ps", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))))
    raw = p.select(F.col("traj_id").cast("string").alias("id"), geom.alias("geom"), F.array_join(F.transform("ps", lambda q: q["t"].cast("string")), ",").alias("timestamp"))
    d = text_tables.parsed_trajectories(raw)
    return d.select("traj_id", F.size("line").cast("long").alias("n"), r(G.length("line")).alias("len"), r(F.element_at("times", 1)).alias("first_t"))


def point_run_sessionize(spark: Spark, sf: str) -> Frame:
    """Stretches of events of one type within a user's events."""
    e = demo.table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = alignment.sessions(e, "user_id", ["ts", "event_id"], F.col("event_type") != F.lag("event_type").over(w))
    return d.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def _cmm_raw(spark: Spark, sf: str) -> Frame:
    e = demo.points(spark, sf)
    cov = F.concat(F.lit("["), F.concat_ws(",", F.col("sde"), F.col("sdn"), F.lit("0.1"), F.col("sdne"), F.lit("0.0"), F.lit("0.0")), F.lit("]"))
    bad = F.when(F.col("event_id") % 11 == 0, F.lit("[1,2]")).when(F.col("event_id") % 13 == 0, F.lit("x")).otherwise(cov)
    return e.select("event_id", bad.alias("covariances"), F.concat(F.lit("["), F.col("pl").cast("string"), F.lit("]")).alias("protection_levels"))


def json_covariance_parse(spark: Spark, sf: str) -> Frame:
    d = _cmm_raw(spark, sf).withColumn("c", text_tables.covariance_row("covariances"))
    return d.select("event_id", F.col("c").isNotNull().alias("valid"), r(F.get("c", 0)).alias("sde"), r(F.get("c", 3)).alias("sdne"))


def cmm_aggregated_scan(spark: Spark, sf: str) -> Frame:
    """Pieces of ten points as rows of an aggregated covariance file, some of which can't be read or don't fit."""
    p = demo.points(spark, sf).withColumn("id", F.col("traj_id") * 1000 + F.floor(F.col("seq") / 10))
    cov = F.when(F.col("event_id") % 29 == 0, F.lit("[1,2]")).otherwise(F.concat(F.lit("["), F.concat_ws(",", "sde", "sdn", F.lit("0.0"), "sdne", F.lit("0.0"), F.lit("0.0")), F.lit("]")))
    d = p.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" ", "x", "y").alias("at"), F.col("t").cast("string").alias("t"), cov.alias("c"), F.col("pl").cast("string").alias("pl")))).alias("ps"))
    listed = lambda name, n=F.size("ps"): F.concat(F.lit("["), F.array_join(F.slice(f"ps.{name}", F.lit(1), n), ","), F.lit("]"))
    line = F.concat(F.lit("LINESTRING("), F.array_join("ps.at", ","), F.lit(")"))
    fewer = F.size("ps") - (F.col("id") % 7 == 0).cast("int")
    raw = d.select(F.col("id").cast("string").alias("id"), line.alias("geom"), listed("t", fewer).alias("timestamps"), listed("c").alias("covariance"), listed("pl").alias("PL"))
    rows = text_tables.parsed_covariance_trajectories(raw)
    read = text_tables.covariance_points(rows).groupBy("traj_id").agg(F.count("*").alias("points"), F.min("t").alias("begins"), F.sum("x").alias("x"), F.sum("sde").alias("sde"), F.sum("sdne").alias("sdne"), F.max("pl").alias("pl"))
    d = rows.select("traj_id", "valid").join(read, "traj_id", "left")
    return d.select("traj_id", "valid", F.coalesce("points", F.lit(0)).alias("points"), *(r(c).alias(c) for c in ("begins", "x", "sde", "sdne", "pl")))


def strict_numeric_parse(spark: Spark, sf: str) -> Frame:
    e = demo.table(spark, sf, "events").withColumn("s", F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id").cast("string"), F.lit("x"))).when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).otherwise(F.lit("")))
    return e.select("event_id", text_tables.strict_number("s").alias("number"))


def _around(spark: Spark, sf: str) -> Frame:
    """Longitudes and latitudes from event numbers."""
    e = F.col("event_id")
    return demo.table(spark, sf, "events").select("event_id", (110 + (e * 17 % 1000) / 100.0).alias("lon"), (20 + (e * 29 % 1500) / 100.0).alias("lat"), (110 + (e * 31 % 1000) / 100.0).alias("lon2"), (20 + (e * 41 % 1500) / 100.0).alias("lat2"))


AROUND = """around AS (SELECT event_id, 110::DOUBLE + ((event_id * 17) % 1000)::DOUBLE / 100::DOUBLE AS lon, 20::DOUBLE + ((event_id * 29) % 1500)::DOUBLE / 100::DOUBLE AS lat,
  110::DOUBLE + ((event_id * 31) % 1000)::DOUBLE / 100::DOUBLE AS lon2, 20::DOUBLE + ((event_id * 41) % 1500)::DOUBLE / 100::DOUBLE AS lat2 FROM events)"""


def _c(*names: str) -> list:
    return [F.col(n) for n in names]


def haversine(spark: Spark, sf: str) -> Frame:
    return _around(spark, sf).select("event_id", F.round(D.haversine(*_c("lon", "lat", "lon2", "lat2")), 3).alias("metres"))


def equirectangular_distance(spark: Spark, sf: str) -> Frame:
    return _around(spark, sf).select("event_id", F.round(D.equirectangular(*_c("lon", "lat", "lon2", "lat2")), 3).alias("metres"))


def is_projected(spark: Spark, sf: str) -> Frame:
    return _around(spark, sf).withColumn("x", F.when(F.col("event_id") % 5 == 0, F.col("lon") * 1000).otherwise(F.col("lon"))).select("event_id", D.is_projected(F.col("x"), F.col("lat")).alias("projected"))


def utm_epsg(spark: Spark, sf: str) -> Frame:
    return _around(spark, sf).select("event_id", D.utm_epsg(F.col("lon") - 120, F.col("lat") * 4 - 60).cast("long").alias("epsg"))


def utm_roundtrip(spark: Spark, sf: str) -> Frame:
    d = _around(spark, sf).withColumn("p", D.utm_forward(F.col("lon"), F.col("lat"), F.lit(114.0))).withColumn("q", D.utm_inverse(F.col("p.x"), F.col("p.y"), F.lit(114.0)))
    return d.select("event_id", r("q.lon").alias("lon"), r("q.lat").alias("lat"))


def lla_to_ecef(spark: Spark, sf: str) -> Frame:
    v = D.lla_to_ecef(F.col("lon"), F.col("lat"), F.lit(30.0))
    return _around(spark, sf).select("event_id", *(F.round(v[c], 3).alias(c) for c in "xyz"))


def gcj02_to_wgs84(spark: Spark, sf: str) -> Frame:
    """Places inside and outside the datum's bounds."""
    e, v = F.col("event_id"), D.gcj02_to_wgs84(F.col("lon"), F.col("lat"))
    wide = demo.table(spark, sf, "events").select("event_id", (60 + (e * 17 % 1000) / 10.0).alias("lon"), ((e * 29 % 1500) / 25.0).alias("lat"))
    return wide.select("event_id", r(v["lon"]).alias("lon"), r(v["lat"]).alias("lat"))


def sigma_m_to_deg(spark: Spark, sf: str) -> Frame:
    v = D.sigma_to_degrees(F.col("lon") - 100, F.col("lat"), F.col("lat"))
    return _around(spark, sf).select("event_id", F.round(v["lon"] * 1000, 6).alias("lon"), F.round(v["lat"] * 1000, 6).alias("lat"))


def ellipse_to_covariance(spark: Spark, sf: str) -> Frame:
    v = D.ellipse_to_covariance(F.col("lon") - 100, F.col("lat") / 10, F.col("lon2"))
    return _around(spark, sf).select("event_id", *(r(v[c]).alias(c) for c in ("sigma_e", "sigma_n", "cov_en")))


def _squares() -> tuple:
    return F.col("sde") * F.col("sde"), F.col("sdn") * F.col("sdn"), F.col("sdne")


def mahalanobis_sq(spark: Spark, sf: str) -> Frame:
    return demo.points(spark, sf).select("event_id", F.round(D.mahalanobis_squared(F.col("x") - 2, F.col("y") - 1, *_squares()), 3).alias("m2"))


def protection_level_cov(spark: Spark, sf: str) -> Frame:
    return demo.points(spark, sf).select("event_id", r(D.protection_level(*_squares())).alias("hpl"))


def whiten_error(spark: Spark, sf: str) -> Frame:
    v = D.whitened(F.col("x") - 2, F.col("y") - 1, *_squares())
    return demo.points(spark, sf).select("event_id", F.round(v["u"], 5).alias("u"), F.round(v["v"], 5).alias("v"))


def chi_square_quantile(spark: Spark, sf: str) -> Frame:
    return demo.points(spark, sf).select("event_id", r(D.chi_square_quantile((F.col("event_id") % 20 + 1).cast("double"), 1.6448536269514722)).alias("q"))


def rayleigh_cdf(spark: Spark, sf: str) -> Frame:
    return demo.points(spark, sf).select("event_id", r(D.rayleigh_cdf(F.col("x"), F.col("sde") * 20)).alias("p"))


def parse_point_wkt(spark: Spark, sf: str) -> Frame:
    e = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("point( "), e, F.lit(".5 -"), e, F.lit(" )"))).when(F.col("event_id") % 4 == 1, F.lit("POINT EMPTY")).otherwise(F.concat(F.lit("POINT("), e, F.lit(" "), e, F.lit(".25)")))
    p = G.point_from_wkt(text)
    return demo.table(spark, sf, "events").select("event_id", p["x"].alias("x"), p["y"].alias("y"))


def parse_candidates(spark: Spark, sf: str) -> Frame:
    e = F.col("event_id").cast("string")
    text = F.concat(F.lit("(("), e, F.lit(",1.5,0.5),("), e, F.lit(",2.5,0.25))"))
    d = demo.table(spark, sf, "events").select("event_id", F.explode(text_tables.candidate_list(text)).alias("c"))
    return d.groupBy("event_id").agg(F.count("*").alias("n"), r(F.sum(F.col("c.y") * F.col("c.ep"))).alias("v"))


def _sentence(spark: Spark, sf: str) -> Frame:
    e = F.col("event_id")
    hms = F.format_string("%02d%02d%02d.%02d", e % 24, e % 60, (e * 7) % 60, e % 100)
    gga = F.concat(F.lit("$GNGGA,"), hms, F.lit(","), F.format_string("%02d%02d.%04d", e % 90, e % 60, e % 10000), F.when(e % 2 == 0, F.lit(",N,")).otherwise(F.lit(",S,")), F.format_string("%03d%02d.%04d", e % 180, e % 60, e % 10000), F.lit(",E,1,08,0.9,10.0,M,,M,,*00"))
    return demo.table(spark, sf, "events").select("event_id", "user_id", gga.alias("line"))


def dm_to_decimal_degrees(spark: Spark, sf: str) -> Frame:
    d = _sentence(spark, sf).withColumn("g", nmea.gga("line"))
    return d.select("event_id", r("g.lon").alias("lon"), r("g.lat").alias("lat"))


def nmea_time_parse(spark: Spark, sf: str) -> Frame:
    d = _sentence(spark, sf).withColumn("g", nmea.gga("line"))
    return d.select("event_id", r("g.seconds").alias("seconds"))


def date_carry_forward(spark: Spark, sf: str) -> Frame:
    e = demo.table(spark, sf, "events").withColumn("day", F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyyMMdd")))
    return nmea.carried_forward(e, "user_id", ["ts", "event_id"], "day").select("event_id", "day")


def network_bbox_filter(spark: Spark, sf: str) -> Frame:
    d = network.in_box(demo.edges(spark, sf), 1.5, 0.0, 5.2, 3.5)
    return d.select("edge_id", "source", "target")


def gps_bounds(spark: Spark, sf: str) -> Frame:
    b = network.gps_bounds(demo.points(spark, sf), 0.25)
    return b.select(*(r(c).alias(c) for c in b.columns))


def clean_bounds_filter(spark: Spark, sf: str) -> Frame:
    """Raw feed lines of five fields within the bounds; others are dropped."""
    e = F.col("event_id")
    line = F.concat_ws(",", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("0"), (110 + (e % 100) / 10.0).cast("string"), (20 + (e % 50) / 10.0).cast("string"))
    raw = demo.table(spark, sf, "events").select("event_id", F.when(e % 7 == 0, F.concat(line, F.lit(",extra"))).otherwise(line).alias("value"))
    d = text_tables.clean_feed(raw, "value", 112.0, 21.0, 118.0, 23.0)
    return d.select("event_id", "vehicle", r("lon").alias("lon"), r("lat").alias("lat"))


def bin_by_trace(spark: Spark, sf: str) -> Frame:
    trace = F.col("sde") * F.col("sde") + F.col("sdn") * F.col("sdn")
    label = F.lit("over")
    for edge in (0.015, 0.01, 0.0075):
        label = F.when(trace <= edge, F.lit(str(edge))).otherwise(label)
    return demo.points(spark, sf).groupBy(label.alias("bin")).agg(F.count("*").alias("n"))


def points_to_linestring(spark: Spark, sf: str) -> Frame:
    d = demo.lines(spark, sf)
    return d.select("traj_id", F.size("line").cast("long").alias("n"), r(F.element_at("line", 1)["x"]).alias("x0"), r(F.element_at("line", -1)["y"]).alias("y1"))


S = demo.SEGMENTS
P = f"WITH {demo.POINTS}"
A = f"WITH {AROUND}"
E2 = D.ECCENTRICITY
VARS = "sde * sde AS a, sdn * sdn AS b, sdne AS c"

def _waves(v: str, parts: tuple) -> str:
    return "(" + " + ".join(f"{w}::DOUBLE * sin({v} * {k} * pi())" for w, k in parts) + ") * 2 / 3"


def _gcj_sql() -> str:
    """The shift written out from the datum's definition (fixed values)."""
    both = _waves("x", ((20, 6), (20, 2)))
    lat = f"-100 + 2 * x + 3 * y + 0.2::DOUBLE * y * y + 0.1::DOUBLE * x * y + 0.2::DOUBLE * sqrt(abs(x)) + {both} + {_waves('y', ((20, 1), (40, '(1 / 3::DOUBLE)')))} + {_waves('y', ((160, '(1 / 12::DOUBLE)'), (320, '(1 / 30::DOUBLE)')))}"
    lon = f"300 + x + 2 * y + 0.1::DOUBLE * x * x + 0.1::DOUBLE * x * y + 0.1::DOUBLE * sqrt(abs(x)) + {both} + {_waves('x', ((20, 1), (40, '(1 / 3::DOUBLE)')))} + {_waves('x', ((150, '(1 / 12::DOUBLE)'), (300, '(1 / 30::DOUBLE)')))}"
    wide = "wide AS (SELECT event_id, 60 + ((event_id * 17) % 1000)::DOUBLE / 10::DOUBLE AS lon, ((event_id * 29) % 1500)::DOUBLE / 25::DOUBLE AS lat FROM events)"
    moved = f"moved AS (SELECT *, {lat} AS dy, {lon} AS dx, 1 - 0.00669342162296594323::DOUBLE * sin(radians(lat)) ** 2 AS m FROM (SELECT *, lon - 105 AS x, lat - 35 AS y FROM wide))"
    inside = "lon BETWEEN 73.66 AND 135.05 AND lat BETWEEN 3.86 AND 53.55"
    new_lon = "lon - dx * 180 / (6378245::DOUBLE / sqrt(m) * cos(radians(lat)) * pi())"
    new_lat = "lat - dy * 180 / (6378245::DOUBLE * (1 - 0.00669342162296594323::DOUBLE) / (m * sqrt(m)) * pi())"
    return f"WITH {wide}, {moved} SELECT event_id, {sql(f'CASE WHEN {inside} THEN {new_lon} ELSE lon END')} AS lon, {sql(f'CASE WHEN {inside} THEN {new_lat} ELSE lat END')} AS lat FROM moved"


ORACLE_SQL = {
    "gcj02_to_wgs84": _gcj_sql(),
    "consecutive_distance": f"WITH {S} SELECT traj_id, no, {sql('len')} AS len FROM seg",
    "trajectory_length": f"WITH {S} SELECT s.traj_id, {sql('coalesce(sum(len), 0)')} AS len FROM (SELECT DISTINCT traj_id FROM points) s LEFT JOIN seg USING (traj_id) GROUP BY 1",
    "reverse_geometry": f"WITH {demo.POINTS} SELECT traj_id, max(seq) OVER (PARTITION BY traj_id) - seq AS no, {sql('x')} AS x, {sql('y')} AS y FROM points",
    "split_line": f"WITH {S}, t AS (SELECT s.traj_id, coalesce(max(total), 0) AS total FROM (SELECT DISTINCT traj_id FROM points) s LEFT JOIN seg USING (traj_id) GROUP BY 1), n AS (SELECT *, unnest(range(greatest(ceil(total / {STEP}::DOUBLE)::BIGINT, 1))) AS no FROM t) SELECT n.traj_id, n.no, {sql('coalesce(sum(greatest(0, least(seg.upto, least((n.no + 1) * 0.8::DOUBLE, n.total)) - greatest(seg.pos, n.no * 0.8::DOUBLE))), 0)')} AS len FROM n LEFT JOIN seg ON seg.traj_id = n.traj_id GROUP BY ALL",
    "interpolate_distances": f"WITH {S}, d AS (SELECT s.traj_id, t.no, t.d FROM (SELECT DISTINCT traj_id FROM seg) s, (SELECT unnest([0, 1, 2])::BIGINT AS no, unnest([0.25, 1, 2.6])::DOUBLE AS d) t), m AS (SELECT d.*, seg.*, row_number() OVER (PARTITION BY d.traj_id, d.no ORDER BY seg.no DESC) AS k FROM d JOIN seg ON seg.traj_id = d.traj_id AND (d.d < total AND pos <= d.d OR d.d >= total AND upto >= total)) SELECT traj_id, no, {sql('x1 + CASE WHEN len > 0 THEN (least(d, total) - pos) / len ELSE 0 END * (x2 - x1)')} AS x, {sql('y1 + CASE WHEN len > 0 THEN (least(d, total) - pos) / len ELSE 0 END * (y2 - y1)')} AS y FROM m WHERE k = 1 AND (d < total OR no = 2)",
    "interpolate_every": f"WITH {S} SELECT s.traj_id, (CASE WHEN coalesce(max(total), 0) = 0 THEN 1 ELSE ceil(max(total) / {STEP}::DOUBLE) + 1 END)::BIGINT AS n FROM (SELECT DISTINCT traj_id FROM points) s LEFT JOIN seg USING (traj_id) GROUP BY 1",
    "bounding_box": f"WITH {demo.POINTS} SELECT traj_id, {sql('min(x)')} AS min_x, {sql('min(y)')} AS min_y, {sql('max(x)')} AS max_x, {sql('max(y)')} AS max_y FROM points GROUP BY 1",
    "length_to_end": f"WITH {S} SELECT p.traj_id, p.seq, {sql('coalesce(sum(seg.len), 0)')} AS rest FROM points p LEFT JOIN seg ON seg.traj_id = p.traj_id AND seg.no >= p.seq GROUP BY 1, 2",
    "closest_point_on_segment": f"{P}, s AS (SELECT event_id, x, y, greatest(0::DOUBLE, least(1::DOUBLE, ((x - 1) * 3 + y * 2) / 13::DOUBLE)) AS u FROM points) SELECT event_id, {sql('sqrt((x - 1 - 3 * u) ** 2 + (y - 2 * u) ** 2)')} AS dist, {sql('u * sqrt(13::DOUBLE)')} AS \"offset\" FROM s",
    "point_on_polyline": f"WITH {S}, u AS (SELECT *, CASE WHEN len = 0 THEN 0 ELSE greatest(0, least(1, ((2.2::DOUBLE - x1) * (x2 - x1) + (1.1::DOUBLE - y1) * (y2 - y1)) / (len * len))) END AS u FROM seg) SELECT traj_id, min(sqrt((2.2::DOUBLE - x1 - u * (x2 - x1)) ** 2 + (1.1::DOUBLE - y1 - u * (y2 - y1)) ** 2)) <= 0.9 AS near FROM u GROUP BY 1",
    "linear_referencing": f"WITH {S}, u AS (SELECT *, CASE WHEN len = 0 THEN 0 ELSE greatest(0, least(1, ((2.2::DOUBLE - x1) * (x2 - x1) + (1.1::DOUBLE - y1) * (y2 - y1)) / (len * len))) END AS u FROM seg), d AS (SELECT *, sqrt((2.2::DOUBLE - x1 - u * (x2 - x1)) ** 2 + (1.1::DOUBLE - y1 - u * (y2 - y1)) ** 2) AS d FROM u) SELECT traj_id, {sql('d')} AS dist, {sql('pos + u * len')} AS \"offset\" FROM d QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY d, no) = 1",
    "locate_point_by_offset": f"WITH {S}, l AS (SELECT *, least(1.3::DOUBLE, total) AS o FROM seg) SELECT traj_id, {sql('x1 + CASE WHEN len > 0 THEN (o - pos) / len ELSE 0 END * (x2 - x1)')} AS x, {sql('y1 + CASE WHEN len > 0 THEN (o - pos) / len ELSE 0 END * (y2 - y1)')} AS y FROM l WHERE upto >= o OR no = (SELECT max(no) FROM seg s WHERE s.traj_id = l.traj_id) QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY no) = 1",
    "line_substring": f"WITH {S} SELECT traj_id, {sql('greatest(0, least(2, max(total)) - 0.5)')} AS len, 2 + count(*) FILTER (upto > 0.5 AND upto < 2) AS n FROM seg GROUP BY 1",
    "densify": f"WITH {S} SELECT s.traj_id, (1 + coalesce(sum(greatest(ceil(len / 0.25), 1)), 0))::BIGINT AS n FROM (SELECT DISTINCT traj_id FROM points) s LEFT JOIN seg USING (traj_id) GROUP BY 1",
    "dedup_consecutive": f"WITH RECURSIVE {demo.POINTS}, k AS (SELECT traj_id, seq, x, y, 1 AS n FROM points WHERE seq = 0 UNION ALL SELECT k.traj_id, s.seq, CASE WHEN (s.x - k.x) ** 2 + (s.y - k.y) ** 2 > 0.09::DOUBLE THEN s.x ELSE k.x END, CASE WHEN (s.x - k.x) ** 2 + (s.y - k.y) ** 2 > 0.09::DOUBLE THEN s.y ELSE k.y END, k.n + CASE WHEN (s.x - k.x) ** 2 + (s.y - k.y) ** 2 > 0.09::DOUBLE THEN 1 ELSE 0 END FROM k JOIN points s ON s.traj_id = k.traj_id AND s.seq = k.seq + 1) SELECT traj_id, max(n)::BIGINT AS n FROM k GROUP BY 1",
    "wkt_roundtrip": f"WITH {S} SELECT s.traj_id, true AS same, s.n, {sql('coalesce(sum(len), 0)')} AS len FROM (SELECT traj_id, count(*)::BIGINT AS n FROM points GROUP BY 1) s LEFT JOIN seg USING (traj_id) GROUP BY 1, 2, 3",
    "geojson_export": f"WITH {demo.POINTS} SELECT traj_id, 'LineString' AS kind, count(*)::BIGINT AS n, {sql('sum(x)')} AS sum_x FROM points GROUP BY 1",
    "wkt_trajectory_scan": f"WITH {S} SELECT s.traj_id, s.n, {sql('coalesce(sum(len), 0)')} AS len, {sql('s.t')} AS first_t FROM (SELECT traj_id, count(*)::BIGINT AS n, arg_min(t, seq) AS t FROM points GROUP BY 1) s LEFT JOIN seg USING (traj_id) GROUP BY s.traj_id, s.n, s.t",
    "point_run_sessionize": "WITH l AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM l) SELECT user_id, run, count(*)::BIGINT AS n, min(event_id) AS first_id FROM n GROUP BY 1, 2",
    "cmm_aggregated_scan": f"{P}, q AS (SELECT *, traj_id * 1000 + seq // 10 AS id FROM points), g AS (SELECT id AS traj_id, NOT bool_or(event_id % 29 = 0) AND id % 7 <> 0 AS valid, count(*) AS n, min(t) AS begins, sum(x) AS x, sum(sde) AS sde, sum(sdne) AS sdne, max(pl) AS pl FROM q GROUP BY id) SELECT traj_id, valid, CASE WHEN valid THEN n ELSE 0 END AS points, "
    + ", ".join(f"CASE WHEN valid THEN {sql(c)} END AS {c}" for c in ("begins", "x", "sde", "sdne", "pl"))
    + " FROM g",
    "json_covariance_parse": f"{P} SELECT event_id, event_id % 11 <> 0 AND event_id % 13 <> 0 AS valid, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN {sql('sde')} END AS sde, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN {sql('sdne')} END AS sdne FROM points",
    "strict_numeric_parse": "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN event_id::DOUBLE END AS number FROM events",
    "haversine": f"{A}, q AS (SELECT event_id, sin(radians(lat2 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(lat2)) * sin(radians(lon2 - lon) / 2) ** 2 AS a FROM around) SELECT event_id, round(2 * 6371000 * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres FROM q",
    "equirectangular_distance": f"{A} SELECT event_id, round(sqrt(((lon2 - lon) * 111320 * cos(radians((lat + lat2) / 2))) ** 2 + ((lat2 - lat) * 111320) ** 2), 3) AS metres FROM around",
    "is_projected": "SELECT event_id, event_id % 5 = 0 AS projected FROM events",
    "utm_epsg": f"{A} SELECT event_id, (CASE WHEN lat * 4 - 60 <= -80 OR lat * 4 - 60 >= 84 THEN -1 ELSE CASE WHEN lat * 4 - 60 >= 0 THEN 32600 ELSE 32700 END + least(60, greatest(1, floor((lon + 60) / 6)::BIGINT + 1)) END)::BIGINT AS epsg FROM around",
    "utm_roundtrip": f"{A} SELECT event_id, {sql('lon')} AS lon, {sql('lat')} AS lat FROM around",
    "lla_to_ecef": f"{A}, n AS (SELECT *, 6378137 / sqrt(1 - {E2}::DOUBLE * sin(radians(lat)) ** 2) AS n FROM around) SELECT event_id, round((n + 30) * cos(radians(lat)) * cos(radians(lon)), 3) AS x, round((n + 30) * cos(radians(lat)) * sin(radians(lon)), 3) AS y, round((n * (1 - {E2}::DOUBLE) + 30) * sin(radians(lat)), 3) AS z FROM n",
    "sigma_m_to_deg": f"{A}, w AS (SELECT *, 1 - {E2}::DOUBLE * sin(radians(lat)) ** 2 AS w FROM around) SELECT event_id, round(1000 * degrees((lon - 100) / (6378137 / sqrt(w) * cos(radians(lat)))), 6) AS lon, round(1000 * degrees(lat / (6378137 * (1 - {E2}::DOUBLE) / w ** 1.5)), 6) AS lat FROM w",
    "ellipse_to_covariance": f"{A}, t AS (SELECT event_id, lon - 100 AS a, lat / 10 AS b, sin(radians(lon2)) AS s, cos(radians(lon2)) AS c FROM around) SELECT event_id, {sql('sqrt((a * s) ** 2 + (b * c) ** 2)')} AS sigma_e, {sql('sqrt((a * c) ** 2 + (b * s) ** 2)')} AS sigma_n, {sql('(a * a - b * b) * s * c')} AS cov_en FROM t",
    "mahalanobis_sq": f"{P}, v AS (SELECT event_id, x - 2 AS dx, y - 1 AS dy, {VARS} FROM points) SELECT event_id, round((b * dx * dx - 2 * c * dx * dy + a * dy * dy) / (a * b - c * c), 3) AS m2 FROM v",
    "protection_level_cov": f"{P}, v AS (SELECT event_id, {VARS} FROM points) SELECT event_id, {sql('3.72 * sqrt((a + b) / 2 + sqrt((a - b) ** 2 / 4 + c * c))')} AS hpl FROM v",
    "whiten_error": f"{P}, v AS (SELECT event_id, x - 2 AS dx, y - 1 AS dy, {VARS} FROM points) SELECT event_id, round(dx / sqrt(a), 5) AS u, round((dy - c / sqrt(a) * dx / sqrt(a)) / sqrt(b - c * c / a), 5) AS v FROM v",
    "chi_square_quantile": f"SELECT event_id, {sql('k * (1 - 2 / (9 * k) + 1.6448536269514722::DOUBLE * sqrt(2 / (9 * k))) ** 3')} AS q FROM (SELECT event_id, (event_id % 20 + 1)::DOUBLE AS k FROM events)",
    "rayleigh_cdf": f"{P} SELECT event_id, {sql('1 - exp(-x * x / (2 * (sde * 20) ** 2))')} AS p FROM points",
    "parse_point_wkt": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id + 0.5::DOUBLE WHEN 1 THEN NULL ELSE event_id::DOUBLE END AS x, CASE event_id % 4 WHEN 0 THEN -event_id::DOUBLE WHEN 1 THEN NULL ELSE event_id + 0.25::DOUBLE END AS y FROM events",
    "parse_candidates": "SELECT event_id, 2::BIGINT AS n, 1.375::DOUBLE AS v FROM events",
    "dm_to_decimal_degrees": f"SELECT event_id, {sql('(event_id % 180) + ((event_id % 60) + (event_id % 10000) / 10000::DOUBLE) / 60::DOUBLE')} AS lon, {sql('CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * ((event_id % 90) + ((event_id % 60) + (event_id % 10000) / 10000::DOUBLE) / 60::DOUBLE)')} AS lat FROM events",
    "nmea_time_parse": f"SELECT event_id, {sql('(event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60 + (event_id % 100) / 100::DOUBLE')} AS seconds FROM events",
    "date_carry_forward": "SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y%m%d') END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS day FROM events",
    "network_bbox_filter": f"WITH {demo.EDGES} SELECT edge_id, source, target FROM edges WHERE least(x1, x2) <= 5.2 AND greatest(x1, x2) >= 1.5 AND least(y1, y2) <= 3.5 AND greatest(y1, y2) >= 0",
    "gps_bounds": f"{P} SELECT {sql('min(x) - 0.25')} AS min_x, {sql('min(y) - 0.25')} AS min_y, {sql('max(x) + 0.25')} AS max_x, {sql('max(y) + 0.25')} AS max_y FROM points",
    "clean_bounds_filter": f"SELECT event_id, user_id::VARCHAR AS vehicle, {sql('110 + (event_id % 100) / 10::DOUBLE')} AS lon, {sql('20 + (event_id % 50) / 10::DOUBLE')} AS lat FROM events WHERE event_id % 7 <> 0 AND 110 + (event_id % 100) / 10::DOUBLE BETWEEN 112 AND 118 AND 20 + (event_id % 50) / 10::DOUBLE BETWEEN 21 AND 23",
    "bin_by_trace": f"{P} SELECT CASE WHEN sde * sde + sdn * sdn <= 0.0075::DOUBLE THEN '0.0075' WHEN sde * sde + sdn * sdn <= 0.01::DOUBLE THEN '0.01' WHEN sde * sde + sdn * sdn <= 0.015::DOUBLE THEN '0.015' ELSE 'over' END AS bin, count(*)::BIGINT AS n FROM points GROUP BY 1",
    "points_to_linestring": f"WITH {demo.POINTS} SELECT traj_id, count(*)::BIGINT AS n, {sql('arg_min(x, seq)')} AS x0, {sql('arg_max(y, seq)')} AS y1 FROM points GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (
    consecutive_distance, trajectory_length, reverse_geometry, split_line, interpolate_distances, interpolate_every, bounding_box, length_to_end, closest_point_on_segment, linear_referencing,
    locate_point_by_offset, line_substring, point_on_polyline, dedup_consecutive, densify, wkt_roundtrip, geojson_export, wkt_trajectory_scan, point_run_sessionize, cmm_aggregated_scan, json_covariance_parse,
    strict_numeric_parse, haversine, equirectangular_distance, is_projected, utm_epsg, utm_roundtrip, lla_to_ecef, gcj02_to_wgs84, sigma_m_to_deg, ellipse_to_covariance, mahalanobis_sq,
    protection_level_cov, whiten_error, chi_square_quantile, rayleigh_cdf, parse_point_wkt, parse_candidates, dm_to_decimal_degrees, nmea_time_parse, date_carry_forward, network_bbox_filter,
    gps_bounds, clean_bounds_filter, bin_by_trace, points_to_linestring,
)}
