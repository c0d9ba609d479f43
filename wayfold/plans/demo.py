"""A road network, trajectories and scores derived from the driver's tables, in Spark and in SQL alike.

Suppliers are nodes of a lattice ten wide, with edges of length 1 both ways; events are points that wander over
it, by user and time. The SQL pieces are common table expressions with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as G

WIDTH = 10
#: Directions: edge id = source * 4 + direction; the step in node numbers.
STEPS = ((0, 1), (1, -1), (2, WIDTH), (3, -WIDTH))
#: Matching parameters: search radius, candidates of a point, standard deviation, longest way in the path table.
RADIUS, K, SIGMA, LIMIT = 0.6, 4, 0.5, 6.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.alias("node"), (s % WIDTH).cast("double").alias("x"), F.floor(s / WIDTH).cast("double").alias("y"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    turns = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d, s in STEPS))
    out = n.select(F.col("node").alias("source"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.explode(turns).alias("t"))
    out = out.filter(~((F.col("t.d") == 0) & (F.col("x1") == WIDTH - 1)) & ~((F.col("t.d") == 1) & (F.col("x1") == 0)))
    out = out.withColumn("target", F.col("source") + F.col("t.s")).join(n.select(F.col("node").alias("target"), F.col("x").alias("x2"), F.col("y").alias("y2")), "target")
    return out.select(
        (F.col("source") * 4 + F.col("t.d")).alias("edge_id"), "source", "target", F.array(G.point("x1", "y1"), G.point("x2", "y2")).alias("line"), F.lit(1.0).alias("length"), (F.col("source") % 7 == 0).alias("oneway")
    )


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the lattice."""
    return int(nodes(spark, sf_dir).agg(F.max("y")).first()[0] or 0) + 1


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    d = table(spark, sf_dir, "events").withColumn("seq", seq.cast("long"))
    return d.select(
        u.alias("traj_id"), "seq", e.alias("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.least(F.lit(9.0), (u % 5) + 0.35 * (F.col("seq") % 12) + (((e * 37) % 11) - 5) / 50.0).alias("x"),
        ((u % height(spark, sf_dir)) + (((e * 53) % 13) - 6) / 60.0).alias("y"),
        (0.05 + (e % 7) / 100.0).alias("sde"), (0.05 + (e % 5) / 100.0).alias("sdn"), (0.1 * (0.05 + (e % 7) / 100.0) * (0.05 + (e % 5) / 100.0)).alias("sdne"), (0.6 + (e % 9) / 20.0).alias("pl"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(traj_id, line): the points of each trajectory in order."""
    p = points(spark, sf_dir).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("ps"))
    return p.select("traj_id", F.transform("ps", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("line"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, confidence, correct, error, level): scores and labels for the quality measures."""
    e = F.col("event_id")
    d = table(spark, sf_dir, "events").select("event_id", "user_id", ((e * 7919) % 10007 / 10007.0).alias("confidence"), F.col("value").alias("value"))
    d = d.withColumn("correct", ((e * 31) % 100 < 100 * F.col("confidence")).cast("int"))
    return d.withColumn("error", (e * 271 % 1009) / 16.0).withColumn("level", (e * 37 % 503) / 8.0)


EDGES = f"""steps AS (SELECT unnest([0,1,2,3]) AS d, unnest([1,-1,{WIDTH},-{WIDTH}]) AS s),
edges AS (SELECT a.s_suppkey * 4 + d AS edge_id, a.s_suppkey AS source, b.s_suppkey AS target, (a.s_suppkey % {WIDTH})::DOUBLE AS x1, (a.s_suppkey // {WIDTH})::DOUBLE AS y1,
  (b.s_suppkey % {WIDTH})::DOUBLE AS x2, (b.s_suppkey // {WIDTH})::DOUBLE AS y2, 1::DOUBLE AS length, a.s_suppkey % 7 = 0 AS oneway
  FROM supplier a CROSS JOIN steps JOIN supplier b ON b.s_suppkey = a.s_suppkey + s
  WHERE NOT (d = 0 AND a.s_suppkey % {WIDTH} = {WIDTH - 1}) AND NOT (d = 1 AND a.s_suppkey % {WIDTH} = 0))"""

POINTS = f"""numbered AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS seq FROM events),
h AS (SELECT max(s_suppkey // {WIDTH}) + 1 AS h FROM supplier),
points AS (SELECT user_id AS traj_id, seq, event_id, epoch(ts)::DOUBLE AS t,
  least(9::DOUBLE, (user_id % 5)::DOUBLE + 0.35::DOUBLE * (seq % 12)::DOUBLE + (((event_id * 37) % 11) - 5)::DOUBLE / 50::DOUBLE) AS x,
  (user_id % (SELECT h FROM h))::DOUBLE + (((event_id * 53) % 13) - 6)::DOUBLE / 60::DOUBLE AS y,
  0.05::DOUBLE + (event_id % 7)::DOUBLE / 100::DOUBLE AS sde, 0.05::DOUBLE + (event_id % 5)::DOUBLE / 100::DOUBLE AS sdn,
  0.1::DOUBLE * (0.05::DOUBLE + (event_id % 7)::DOUBLE / 100::DOUBLE) * (0.05::DOUBLE + (event_id % 5)::DOUBLE / 100::DOUBLE) AS sdne, 0.6::DOUBLE + (event_id % 9)::DOUBLE / 20::DOUBLE AS pl FROM numbered)"""

#: Segments of the trajectories with their place along the line.
SEGMENTS = f"""{POINTS},
seg0 AS (SELECT traj_id, seq - 1 AS no, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2 FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
seg1 AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM seg0 WHERE no >= 0),
seg AS (SELECT *, sum(len) OVER (PARTITION BY traj_id ORDER BY no) - len AS pos, sum(len) OVER (PARTITION BY traj_id ORDER BY no) AS upto, sum(len) OVER (PARTITION BY traj_id) AS total FROM seg1)"""

SCORED = """scored AS (SELECT event_id, user_id, value, confidence, CASE WHEN (event_id * 31) % 100 < 100 * confidence THEN 1 ELSE 0 END AS correct,
  ((event_id * 271) % 1009)::DOUBLE / 16::DOUBLE AS error, ((event_id * 37) % 503)::DOUBLE / 8::DOUBLE AS level
  FROM (SELECT *, ((event_id * 7919) % 10007)::DOUBLE / 10007::DOUBLE AS confidence FROM events))"""

#: Candidates of the trajectories, by plain comparison of all points and edges.
CANDIDATES = f"""{POINTS}, {EDGES},
near AS (SELECT p.*, e.edge_id, e.source, e.target, e.length, greatest(0::DOUBLE, least(1::DOUBLE, (p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1))) AS share, x1, y1, x2, y2 FROM points p, edges e),
close AS (SELECT *, share * length AS "offset", sqrt((x - x1 - share * (x2 - x1)) ** 2 + (y - y1 - share * (y2 - y1)) ** 2) AS dist FROM near),
cands AS (SELECT *, row_number() OVER (PARTITION BY traj_id, seq ORDER BY round(dist, 9), edge_id) AS cand FROM close WHERE dist <= {RADIUS}),
top AS MATERIALIZED (SELECT *, exp(-0.5 * (round(dist, 9) / {SIGMA}) ** 2) AS ep FROM cands WHERE cand <= {K})"""

#: All pairs of nodes within LIMIT: the first path by edge ids of each number of edges, which are all of length 1.
OD = "walk1 AS (SELECT source, target, [edge_id] AS path, source AS prev_n FROM edges QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY edge_id) = 1),\n"
OD += "".join(
    f"walk{n} AS (SELECT a.source, e.target, list_append(a.path, e.edge_id) AS path, e.source AS prev_n FROM walk{n - 1} a JOIN edges e ON e.source = a.target QUALIFY row_number() OVER (PARTITION BY a.source, e.target ORDER BY list_append(a.path, e.edge_id)) = 1),\n"
    for n in range(2, int(LIMIT) + 1)
)
OD += "walks AS (" + " UNION ALL ".join(f"SELECT * FROM walk{n}" for n in range(1, int(LIMIT) + 1)) + "),\n"
OD += "od AS MATERIALIZED (SELECT *, len(path)::DOUBLE AS cost, path[1] AS next_e FROM walks WHERE source <> target QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY len(path), path) = 1)"
