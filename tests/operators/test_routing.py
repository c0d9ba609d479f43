"""Searches with own limits, targets, from both ends and towards a goal, against all pairs by brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import routing
from wayfold.operators.search import Search

SIDE = 7


@pytest.fixture(scope="module")
def net(spark):
    """A lattice of unequal edges, one-way here and there, and a part that nothing leads to."""
    rng = random.Random(4)
    place = {i: (i % SIDE + rng.uniform(-0.2, 0.2), i // SIDE + rng.uniform(-0.2, 0.2)) for i in range(SIDE * SIDE)} | {100: (20.0, 0.0), 101: (21.0, 0.0)}
    ends = [(i, j) for i in range(SIDE * SIDE) for j in (i + 1, i + SIDE) if j < SIDE * SIDE and (j != i + 1 or j % SIDE)] + [(100, 101), (100, 3)]
    ends += [(b, a) for a, b in ends if rng.random() < 0.7 and a != 100]
    rows = [(i, a, b, math.dist(place[a], place[b]) * rng.uniform(1, 1.6)) for i, (a, b) in enumerate(ends)]
    dist = {(a, b): 0.0 if a == b else math.inf for a in place for b in place}
    for _, a, b, w in rows:
        dist[a, b] = min(dist[a, b], w)
    for k, i, j in itertools.product(place, place, place):
        dist[i, j] = min(dist[i, j], dist[i, k] + dist[k, j])
    edges = spark.createDataFrame(rows, "edge_id long, source long, target long, length double").cache()
    nodes = spark.createDataFrame([(n, x, y) for n, (x, y) in place.items()], "node long, x double, y double").cache()
    return edges, nodes, dist, {r[0]: r[1:] for r in rows}


def checked(found, want, byid):
    rows = found.collect()
    assert {(r.source, r.target): round(r.distance, 9) for r in rows} == {k: round(d, 9) for k, d in want.items()} and len(rows) == len(want)
    for r in rows:
        at, length = r.source, 0.0
        for e in r.path:
            a, b, w = byid[e]
            assert a == at
            at, length = b, length + w
        assert at == r.target and length == pytest.approx(r.distance)


def pairs_of(spark, dist, n, seed):
    rng = random.Random(seed)
    chosen = rng.sample(sorted({a for a, _ in dist}), n)
    out = [(a, rng.choice(sorted({b for _, b in dist}))) for a in chosen for _ in range(3)] + [(100, 48), (3, 100), (5, 5), (101, 100)]
    return spark.createDataFrame([*out, out[0]], "source long, target long"), {p for p in out if p[0] != p[1] and dist[p] < math.inf}


def test_own_limits_of_sources(spark, net):
    edges, _, dist, byid = net
    limits = {0: 1.0, 24: 2.5, 48: 0.0, 100: 99.0}
    sources = spark.createDataFrame([*limits.items(), (24, 2.0)], "source long, limit double")
    checked(routing.bounded_paths(edges, sources), {(s, t): d for (s, t), d in dist.items() if s in limits and d <= limits[s]}, byid)


def test_targets_settle_a_source_early(spark, net):
    edges, _, dist, byid = net
    targets = spark.createDataFrame([(0, 1), (0, 8), (24, 25), (100, 101), (3, 100), (7, 7)], "source long, target long")
    sources = targets.select("source").distinct().withColumn("limit", F.lit(50.0))
    found = routing.bounded_paths(edges, sources, targets=targets)
    checked(found, {(r.source, r.target): dist[r.source, r.target] for r in targets.collect() if dist[r.source, r.target] < 50}, byid)
    starts = sources.filter("source IN (0, 24)").select("source", F.col("limit").alias("unit"), F.col("source").alias("node"))
    wanted = targets.withColumnRenamed("target", "node")
    states = {}
    for name, w in (("all", None), ("settled", wanted)):
        search = Search(edges, starts, wanted=w).to()
        states[name] = search.known().count()
        search.dropped()
    assert states["settled"] < states["all"] / 4


def test_distances_without_paths(spark, net):
    edges, _, dist, _ = net
    got = {(r.source, r.target): r.distance for r in routing.bounded_paths(edges, edges.select("source"), 2.0, paths=False).collect()}
    assert got == pytest.approx({k: d for k, d in dist.items() if d <= 2.0 and k[0] != 101})


def test_a_search_goes_on_where_it_stopped(spark, net):
    edges, _, dist, _ = net
    starts = spark.createDataFrame([(0, 0), (24, 24)], "source long, node long")
    search = Search(edges, starts)
    for factor in (0.5, 1.5, 4.0):
        got = {(r.source, r.node): r.distance for r in search.to(factor).reached().collect()}
        assert got == pytest.approx({k: d for k, d in dist.items() if k[0] in (0, 24) and d <= factor})
    once = Search(edges, starts).to(4.0)
    assert search.known().count() <= 1.3 * once.known().count()
    search.dropped(), once.dropped()


@pytest.mark.parametrize("radius", [0.3, 2.0, 100.0])
def test_two_sided_pairs(spark, net, radius):
    edges, _, dist, byid = net
    pairs, want = pairs_of(spark, dist, 12, 1)
    checked(routing.two_sided_paths(edges, pairs, radius), {p: dist[p] for p in want}, byid)


def test_goal_directed_pairs(spark, net):
    edges, nodes, dist, byid = net
    pairs, want = pairs_of(spark, dist, 12, 2)
    checked(routing.goal_directed_paths(edges, nodes, pairs), {p: dist[p] for p in want}, byid)


def test_fewer_states_than_circles(spark, net):
    """On a pair far apart both ways keep far fewer states than the circle around the source."""
    edges, nodes, dist, _ = net
    pair = spark.createDataFrame([(24, 27), (21, 27)], "source long, target long")
    two, goal = {}, {}
    assert routing.two_sided_paths(edges, pair, 1.0, two).count() == routing.goal_directed_paths(edges, nodes, pair, 1.2, goal).count() == 2
    circle = sum(1 for (s, _), d in dist.items() for p in ((24, 27), (21, 27)) if s == p[0] and d <= dist[p])
    assert goal["states"] < circle


def test_offers_only_are_shuffled(spark, net):
    """Comparing with earlier states takes no exchange of them."""
    edges, *_ = net
    search = Search(edges, edges.select("source").distinct().withColumn("node", F.col("source"))).to(1.0)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = search.better(search.parked())._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "LeftAnti" in plan, plan
        lines = plan.split("\n")
        scan = next(i for i, x in enumerate(lines) if "Bucketed: true" in x and "round" not in x.split("PartitionFilters")[-1].split("PushedFilters")[0])
        above = lines[scan]
        path, depth = [], len(above) - len(above.lstrip(" :+-"))
        for line in reversed(lines[:scan]):
            d = len(line) - len(line.lstrip(" :+-"))
            if d < depth:
                path.append(line.strip(" :+-"))
                depth = d
        assert not any(x.startswith("Exchange") for x in path[: next(i for i, x in enumerate(path) if "Join" in x)]), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        search.dropped()


def test_no_pairs(spark, net):
    edges, nodes, *_ = net
    none = spark.createDataFrame([(1, 1)], "source long, target long")
    assert routing.two_sided_paths(edges, none, 1.0).count() == 0 and routing.goal_directed_paths(edges, nodes, none).count() == 0
    assert routing.bounded_paths(edges, none.select("source").filter("false"), 1.0).count() == 0
