"""Transitions formed within the folds, against those formed as a table."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import candidates, matching, network, routing

CONFIG = matching.MatchConfig(4, 0.7, 0.5, reverse_tolerance=0.3)


@pytest.fixture(scope="module")
def setting(spark):
    rng = random.Random(3)
    ends = [(i, j) for i in range(16) for j in (i + 1, i + 4) if j < 16 and (j != i + 1 or j % 4)]
    ends += [(b, a) for a, b in ends if rng.random() < 0.6]
    rows = [(n, a, b, [(float(a % 4), float(a // 4)), (float(b % 4), float(b // 4))]) for n, (a, b) in enumerate(ends)]
    edges = network.edge_table(spark.createDataFrame(rows, "edge_id long, source long, target long, line array<struct<x:double,y:double>>"))
    points = [(t, s, rng.uniform(0, 3), rng.uniform(0, 3)) for t in range(12) for s in range(rng.randint(1, 9)) if (t, s) != (5, 2)] + [(3, 20, 99.0, 99.0)]
    return spark.createDataFrame(points, "traj_id long, seq long, x double, y double"), edges, routing.od_table(edges, 2.0).cache()


def test_folds_form_the_same_transitions(spark, setting, monkeypatch):
    """Ways that are missing, run-backs, a trajectory with a point missing, one without candidates at a point, single points."""
    points, edges, od = setting
    near = candidates.nearest(candidates.spatial_candidates(points, edges, CONFIG.radius), CONFIG.k)
    cands = candidates.complete_trajectories(near, points).withColumn("ep", matching.emission(F.col("dist"), CONFIG.gps_error)).cache()
    names = ["traj_id", "seq", "cand", "edge_id", "prev", "ep", "tp", "sp", "eu", "cumu", "trust", "chosen", "offset"]
    rows = lambda d: sorted(map(tuple, d.select(names).collect()))
    want = rows(matching.folded(cands, matching.transitions(cands, od, CONFIG)))
    assert len(want) > 100 and any(r[9] < -1e300 for r in want)

    def never(*_):
        raise AssertionError("transitions are a table again")

    monkeypatch.setattr(matching, "stepped", never)
    assert rows(matching.fast_match(points, edges, od, CONFIG)) == want
    assert {r[0] for r in want} == {r.traj_id for r in matching.layers(points, edges, CONFIG).select("traj_id").distinct().collect()}


def test_what_is_too_far_is_not_shuffled(spark, setting):
    """Distances are known before rows are dealt out by trajectory, and the candidates are dealt out once for both readings."""
    points, edges, od = setting
    plan = candidates.spatial_candidates(points, edges, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    dealt = plan.split("RepartitionByExpression")[1]
    assert "SQRT" in dealt.split("Join")[0], plan
    done = matching.fast_match(points, edges, od, CONFIG)
    done.collect()
    assert "ReusedExchange" in done._jdf.queryExecution().executedPlan().toString()
