"""Queries on satellite geometry and learned scores; results that SQL can't express are tested against NumPy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geometry as G
from wayfold.functions import orbits
from wayfold.operators import evaluation, integrity
from wayfold.operators.orbits import AGE, with_elements
from wayfold.plans import demo
from wayfold.plans.checks import r, sql

Spark, Frame = SparkSession, DataFrame


def satellites(spark: Spark, sf: str) -> Frame:
    """Line items as satellites of their order's epoch."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    d = demo.table(spark, sf, "lineitem").withColumn("epoch", F.floor(F.col("l_orderkey") / 2).cast("long"))
    return d.select("epoch", ((p * 37) % 360).cast("double").alias("azimuth"), (10 + (s * 13 + p) % 80).cast("double").alias("elevation"), (((p * 7 + s) % 41 - 20) / 8.0 + F.when(p % 50 == 0, 60).otherwise(0)).alias("residual"), (1 + (s % 5) / 4.0).alias("sigma"))


def dilution_of_precision(spark: Spark, sf: str) -> Frame:
    return integrity.dop(satellites(spark, sf))


def position_fix_exclusion(spark: Spark, sf: str) -> Frame:
    return integrity.position_fixes(satellites(spark, sf))


#: Broadcast elements of orders, in both dialects.
ELEMENTS = {
    "af0": "(k % 19 - 9) * 1e-5", "af1": "(k % 7) * 1e-12", "af2": "0.0", "tgd": "(k % 5) * 1e-9", "m0": "(k % 62) / 10.0 - 3", "delta_n": "4.5e-9", "e": "(k % 23) / 1000.0", "sqrt_a": "5153.0 + (k % 11) / 10.0",
    "omega0": "(k % 6) * 1.0472 - 3", "omega": "(k % 13) / 4.0", "omega_dot": "-8e-9", "i0": "0.95 + (k % 9) / 200.0", "idot": "1e-10", "cuc": "1e-6", "cus": "(k % 5) * 1e-6", "crc": "250.0", "crs": "20.0 + k % 17", "cic": "3e-8", "cis": "-5e-8",
}


def satellite_positions(spark: Spark, sf: str) -> Frame:
    """Events as observations of satellites, orders as their broadcast elements; places in 1000 km, clocks in microseconds."""
    k = F.col("k")
    e = demo.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k")).select((k % 30).alias("satellite"), (k * 137 % 84 * 7200.0).alias("toe"), (k * 137 % 84 * 7200.0 - k % 3 * 16).alias("toc"), "k", *(F.expr(f"CAST({c} AS DOUBLE)").alias(n) for n, c in ELEMENTS.items()))
    e = e.withColumn("satellite", F.concat(F.lit("G"), F.col("satellite").cast("string")))
    seen = demo.table(spark, sf, "events").select("event_id", F.concat(F.lit("G"), (F.col("event_id") % 30).cast("string")).alias("satellite"), (F.pmod(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(604800)) + 0.25).alias("time"))
    d = with_elements(seen, e).withColumn("p", orbits.position(F.col("el"), F.col("time")))
    return d.select("event_id", F.col("el.k").alias("k"), *(r(F.col(f"p.{c}") / 1e6).alias(c) for c in "xyz"), r(orbits.clock(F.col("el"), F.col("time")) * 1e6).alias("clock"))


def logistic_combiner(spark: Spark, sf: str) -> Frame:
    d = evaluation.combined_score(demo.scored(spark, sf), ["confidence", "level"], "correct", "event_id")
    return d.select("event_id", "score")


def interpolate_random_points(spark: Spark, sf: str) -> Frame:
    d = demo.lines(spark, sf).filter(F.size("line") > 1).select("traj_id", F.explode(G.random_points("line", 4, 11)).alias("p"))
    return d.select("traj_id", "p.x", "p.y")


QUERIES = {f.__name__: f for f in (dilution_of_precision, position_fix_exclusion, satellite_positions, logistic_combiner, interpolate_random_points)}

_FIELDS = ", ".join(f"({c})::DOUBLE AS {n}" for n, c in ELEMENTS.items())
_NEWTON = "list_reduce(list_transform(range(0, 11), lambda n: m), lambda v, m1: v - (v - e * sin(v) - m1) / (1 - e * cos(v)))"
ORACLE_SQL = {
    "satellite_positions": f"""WITH k0 AS (SELECT o_orderkey::BIGINT AS k, (o_orderkey % 30)::BIGINT AS satellite, (o_orderkey * 137 % 84 * 7200)::DOUBLE AS toe FROM orders),
k1 AS (SELECT *, toe - k % 3 * 16 AS toc FROM k0), k2 AS (SELECT * FROM k1 QUALIFY row_number() OVER (PARTITION BY satellite, toe ORDER BY toc DESC, k DESC) = 1),
el AS (SELECT *, {_FIELDS} FROM k2), seen AS (SELECT event_id, event_id % 30 AS satellite, floor(epoch(ts))::BIGINT % 604800 + 0.25::DOUBLE AS t FROM events),
met AS (SELECT * FROM seen JOIN el USING (satellite) WHERE t >= toe - {AGE}::DOUBLE AND t < toe + {AGE}::DOUBLE QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(t - toe), toe DESC) = 1),
a AS (SELECT *, t - toe AS age, m0 + (sqrt({orbits.GM}::DOUBLE / sqrt_a ** 6) + delta_n) * (t - toe) AS m FROM met),
b AS (SELECT *, {_NEWTON} AS ea FROM a),
c AS (SELECT *, atan2(sqrt(1 - e * e) * sin(ea), cos(ea) - e) + omega AS phi, omega0 + (omega_dot - {orbits.EARTH_RATE}::DOUBLE) * age - {orbits.EARTH_RATE}::DOUBLE * toe AS node FROM b),
d AS (SELECT *, phi + cus * sin(2 * phi) + cuc * cos(2 * phi) AS u, sqrt_a ** 2 * (1 - e * cos(ea)) + crs * sin(2 * phi) + crc * cos(2 * phi) AS rr, i0 + idot * age + cis * sin(2 * phi) + cic * cos(2 * phi) AS i FROM c)
SELECT event_id, k, {sql("rr * (cos(u) * cos(node) - sin(u) * cos(i) * sin(node)) / 1e6")} AS x, {sql("rr * (cos(u) * sin(node) + sin(u) * cos(i) * cos(node)) / 1e6")} AS y, {sql("rr * sin(u) * sin(i) / 1e6")} AS z,
  {sql(f"(af0 + af1 * (t - toc) + af2 * (t - toc) ** 2 + ({orbits.RELATIVITY})::DOUBLE * e * sqrt_a * sin(ea) - tgd) * 1e6")} AS clock FROM d""",
}
