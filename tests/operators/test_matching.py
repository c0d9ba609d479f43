"""The small lattice network, its path table and the matches that are known for it."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry as G
from wayfold.operators import matching, network, paths, routing

# Node positions, edges (source, target) in order of id, and three trajectories with their matches.
NODES = {0: (2, 1), 1: (2, 0), 2: (3, 1), 3: (4, 1), 4: (2, 2), 5: (3, 2), 6: (0, 2), 7: (1, 2), 8: (4, 2), 9: (2, 3), 10: (3, 3), 11: (4, 3), 12: (2, 4)}
EDGES = [(0, 1), (1, 0), (2, 0), (3, 2), (0, 4), (4, 0), (2, 5), (6, 7), (7, 6), (4, 7), (7, 4), (5, 4), (4, 5), (5, 8), (8, 5), (9, 4), (4, 9), (5, 10), (9, 10), (10, 11), (12, 9), (9, 12), (8, 11), (11, 8), (8, 3), (3, 8)]
TRIPS = [
    (1, "LINESTRING(1.65889830508474 0.25098870056497,1.65494350282486 0.701836158192091,2.4933615819209 1.76567796610169,3.54929378531073 1.88827683615819,4.13064971751412 2.45776836158192)"),
    (2, "LINESTRING(4.15042372881356 1.60353107344633,3.47019774011299 0.923305084745761,2.40635593220339 0.923305084745761,2.14533898305084 1.53234463276836,2.08601694915254 2.57641242937853,2.49731638418079 2.98771186440678)"),
    (3, "LINESTRING(0.200812146892656 2.14088983050848,1.44262005649717 2.14879943502825,3.06408898305084 2.16066384180791,3.06408898305084 2.7103813559322,3.70872175141242 2.97930790960452,4.11606638418078 2.62337570621469)"),
]
OPATHS = {1: [2, 2, 13, 14, 23], 2: [25, 4, 3, 5, 17, 19], 3: [8, 11, 18, 18, 20, 24]}
CPATHS = {1: [2, 5, 13, 14, 23], 2: [25, 4, 3, 5, 17, 19], 3: [8, 11, 13, 18, 20, 24]}
INDICES = {1: [0, 0, 2, 3, 4], 2: [0, 1, 2, 3, 4, 5], 3: [0, 1, 3, 3, 4, 5]}
SPDIST = {1: [0.450847, 1.79153, 1.05593, 0.908475], 2: [1.13333, 1.06384, 0.938701, 1.04407, 0.920904], 3: [1.24181, 1.71804, 0.549718, 0.99834, 0.667903]}
CUMU = {1: -1.02940444597, 2: -1.09781209191, 3: -0.754059095915}
LINE1 = [(2, 0.250988700565), (2, 1), (2, 2), (3, 2), (4, 2), (4, 2.45776836158)]
TPATH2 = "25,4|4,3|3,5|5,17|17,19"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i + 1, s, t, [tuple(map(float, NODES[s])), tuple(map(float, NODES[t]))]) for i, (s, t) in enumerate(EDGES)]
    return network.edge_table(spark.createDataFrame(rows, "edge_id long, source long, target long, line array<struct<x:double,y:double>>"))


@pytest.fixture(scope="module")
def points(spark):
    trips = spark.createDataFrame(TRIPS, "traj_id long, geom string")
    return trips.select("traj_id", F.posexplode(G.from_wkt("geom")).alias("seq", "p")).select("traj_id", F.col("seq").cast("long").alias("seq"), "p.x", "p.y")


@pytest.fixture(scope="module")
def od(edges):
    return routing.od_table(edges, 3.0).cache()


@pytest.fixture(scope="module")
def matched(points, edges, od):
    return matching.fast_match(points, edges, od, matching.MatchConfig(4, 0.4, 0.5)).cache()


def test_path_table_is_all_pairs_within_the_limit(od):
    dist = {(a, b): 0.0 if a == b else math.inf for a in NODES for b in NODES}
    dist |= {e: math.dist(NODES[e[0]], NODES[e[1]]) for e in EDGES}
    for k, i, j in itertools.product(NODES, NODES, NODES):
        dist[i, j] = min(dist[i, j], dist[i, k] + dist[k, j])
    got = {(r.source, r.target): r.distance for r in od.collect()}
    assert got == {k: d for k, d in dist.items() if 0 < d <= 3.0}


def test_known_routes(edges, od, spark):
    one = spark.createDataFrame([(1,)], "source long")
    reached = {r.target: (r.distance, r.path) for r in routing.bounded_paths(edges, one, 5.1).collect()}
    assert reached[3][0] == 5.0 and 2 not in reached
    walked = routing.unrolled(od.drop("path"), od.select("source", "target"))
    assert walked.join(od.select("source", "target", F.col("path").alias("p")), ["source", "target"]).filter("path <> p").count() == 0
    assert {tuple(r) for r in routing.reverse_paths(edges, spark.createDataFrame([(3,)], "target long"), 1.0).collect()} == {(3, 3, 0.0), (8, 3, 1.0)}


def test_known_matches(matched, od, edges):
    best = matched.filter("chosen").orderBy("traj_id", "seq").collect()
    for t in OPATHS:
        own = [r for r in best if r.traj_id == t]
        assert [r.edge_id for r in own] == OPATHS[t]
        assert [r.sp for r in own][1:] == pytest.approx(SPDIST[t], rel=1e-5)
        assert own[-1].cumu == pytest.approx(CUMU[t], rel=1e-9)
    done = paths.traversed(paths.complete_paths(paths.path_steps(matched.filter("chosen"), od)))
    rows = {r.traj_id: r for r in done.collect()}
    assert {t: r.cpath for t, r in rows.items()} == CPATHS
    assert {t: r.indices for t, r in rows.items()} == INDICES
    assert rows[2].tpath == TPATH2
    ends = matched.filter("chosen").groupBy("traj_id").agg(F.min_by("offset", "seq").alias("first_offset"), F.max_by("offset", "seq").alias("last_offset"))
    line = {r.traj_id: r.mgeom for r in paths.geometry(done, edges, ends).collect()}[1]
    assert [v for p in line for v in (p.x, p.y)] == pytest.approx([v for p in LINE1 for v in p], abs=1e-9)


def test_viterbi_is_the_best_of_all_paths(matched, points, edges, od):
    config = matching.MatchConfig(4, 0.4, 0.5)
    cands = matching.layers(points, edges, config)
    steps = {(r.traj_id, r.seq, r.cand_a, r.cand_b): (r.tp, r.ep_b) for r in matching.transitions(cands, od, config).collect()}
    layers = {}
    for r in cands.collect():
        layers.setdefault(r.traj_id, {}).setdefault(r.seq, {})[r.cand] = r.ep
    for t, own in layers.items():
        best = -math.inf
        for way in itertools.product(*(own[s] for s in sorted(own))):
            value = math.log(own[0][way[0]])
            for s in range(1, len(way)):
                tp, ep = steps[t, s, way[s - 1], way[s]]
                value += (math.log(tp) if tp > 0 else -math.inf) + math.log(ep)
            best = max(best, value)
        assert matched.filter(f"traj_id = {t}").agg(F.max(F.when(F.col("seq") == max(own), F.col("cumu")))).first()[0] == pytest.approx(best)


def test_trajectories_without_candidates_are_left_out(points, edges, spark):
    more = points.unionByName(spark.createDataFrame([(9, 0, 2.0, 0.5), (9, 1, 50.0, 50.0)], "traj_id long, seq long, x double, y double"))
    assert matching.layers(more, edges, matching.MatchConfig(4, 0.4, 0.5)).filter("traj_id = 9").count() == 0
