"""Ways over the blocks of a network, against all pairs by brute force; ways of many edges take few rounds."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import overlay, routing
from wayfold.operators.search import Search

SIDE = 7


@pytest.fixture(scope="module")
def net(spark):
    """A lattice of unequal edges, one-way here and there, with a twin edge, an edge from a node to itself, and a part that nothing leads to."""
    rng = random.Random(11)
    place = {i: (i % SIDE + rng.uniform(-0.2, 0.2), i // SIDE + rng.uniform(-0.2, 0.2)) for i in range(SIDE * SIDE)} | {100: (20.0, 0.0), 101: (21.0, 0.0)}
    ends = [(i, j) for i in range(SIDE * SIDE) for j in (i + 1, i + SIDE) if j < SIDE * SIDE and (j != i + 1 or j % SIDE)] + [(100, 101), (100, 3)]
    ends += [(b, a) for a, b in ends if rng.random() < 0.7 and a != 100] + [(0, 1), (5, 5)]
    rows = [(i, a, b, math.dist(place[a], place[b]) * rng.uniform(1, 1.6) + 0.01, [place[a], place[b]]) for i, (a, b) in enumerate(ends)]
    dist = {(a, b): 0.0 if a == b else math.inf for a in place for b in place}
    for _, a, b, w, _ in rows:
        if a != b:
            dist[a, b] = min(dist[a, b], w)
    for k, i, j in itertools.product(place, place, place):
        dist[i, j] = min(dist[i, j], dist[i, k] + dist[k, j])
    edges = spark.createDataFrame(rows, "edge_id long, source long, target long, length double, line array<struct<x:double,y:double>>").cache()
    return edges, dist, {r[0]: r[1:4] for r in rows}, place


def checked(rows, want, byid):
    assert {(r.source, r.target): round(r.distance, 9) for r in rows} == {k: round(d, 9) for k, d in want.items()} and len(rows) == len(want)
    for r in rows:
        at, length = r.source, 0.0
        for e in r.path:
            a, b, w = byid[e]
            assert a == at
            at, length = b, length + w
        assert at == r.target and length == pytest.approx(r.distance)


@pytest.mark.parametrize("size, lines", [(8, True), (8, False), (1000, True)])
def test_all_pairs(spark, net, monkeypatch, size, lines):
    monkeypatch.setattr(overlay, "BLOCK", size)
    edges, dist, byid, place = net
    over = overlay.Overlay.of(edges if lines else edges.drop("line"))
    n = over.near.select("block").distinct().count()
    assert n == 1 if size == 1000 else 4 <= n <= 14
    pairs = spark.createDataFrame([(a, b) for a in place for b in place], "source long, target long")
    want = {k: d for k, d in dist.items() if k[0] != k[1] and d < math.inf}
    checked(over.ways(pairs).collect(), want, byid)
    sources = spark.createDataFrame([(0,), (24,), (101,)], "source long")
    got = {(r.source, r.target): r.distance for r in over.reach(sources).collect()}
    assert got == pytest.approx({k: d for k, d in dist.items() if k[0] in (0, 24, 101) and d < math.inf})


def test_two_sided_and_goal_directed_pairs_far_apart(spark, net, monkeypatch):
    monkeypatch.setattr(overlay, "BLOCK", 8)
    monkeypatch.setattr(routing, "FAR", 3)
    edges, dist, byid, place = net
    pairs = spark.createDataFrame([(0, 48), (48, 0), (3, 4), (20, 5), (100, 48), (3, 100), (101, 100), (6, 6), (0, 48)], "source long, target long")
    want = {p: dist[p] for p in [(0, 48), (48, 0), (3, 4), (20, 5), (100, 48)]}
    checked(routing.two_sided_paths(edges, pairs, 0.5).collect(), want, byid)
    nodes = spark.createDataFrame([(n, *p) for n, p in place.items()], "node long, x double, y double")
    checked(routing.goal_directed_paths(edges, nodes, pairs).collect(), want, byid)


def test_a_long_street_takes_few_rounds(spark, monkeypatch):
    """A way of 400 edges, in a few rounds and not one for each edge; and the same by rounds if the overlay is too large."""
    monkeypatch.setattr(overlay, "BLOCK", 50)
    n, rounds, stored = 400, [], Search.stored
    monkeypatch.setattr(Search, "stored", lambda self, better: rounds.append(1) or stored(self, better))
    edges = spark.range(n).select(F.col("id").alias("edge_id"), F.col("id").alias("source"), (F.col("id") + 1).alias("target"), F.lit(0.5).alias("length"))
    nodes = spark.range(n + 1).select(F.col("id").alias("node"), F.col("id") * 0.5, F.lit(0.0)).toDF("node", "x", "y")
    pair = spark.createDataFrame([(0, n), (390, 395)], "source long, target long")
    start = pair.select("source").filter("source = 0")
    got = {r.target: r.distance for r in routing.far_distances(edges, start, 150.0).collect()}
    assert got == {i: i * 0.5 for i in range(301)}
    for found in (routing.two_sided_paths(edges, pair, 1.0), routing.goal_directed_paths(edges, nodes, pair)):
        assert {(r.source, r.target): (r.distance, r.path) for r in found.collect()} == {(0, n): (n / 2, list(range(n))), (390, 395): (2.5, list(range(390, 395)))}
    assert 0 < len(rounds) < 40
    monkeypatch.setattr(overlay, "MOST", 3)
    assert {r.target: r.distance for r in routing.far_distances(edges, start, 2.0).collect()} == {i: i * 0.5 for i in range(5)}
