"""Queries see every point of every trajectory and every row of their tables."""

import math
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold.operators import matching
from wayfold.plans import demo, integrity_queries, match_queries, registry

LARGER = "/root/testdata/sf0.01"


def test_trajectories_are_matched_to_their_ends(spark, small):
    n = demo.points(spark, small).count()
    assert n == spark.read.parquet(f"{small}/events.parquet").count()
    assert match_queries.match_rows_point_mode(spark, small).count() == n
    ends = {r.traj_id: r.n for r in demo.points(spark, small).groupBy("traj_id").agg(F.count("*").alias("n")).collect()}
    lengths = {r.traj_id: r.points for r in match_queries.complete_path(spark, small).collect()}
    assert lengths and all(ends[t] == k for t, k in lengths.items())
    last = max(ends.values()) - 1
    assert match_queries.cmm_candidates(spark, small).agg(F.max("seq")).first()[0] == last
    assert match_queries.cmm_forward(spark, small).agg(F.max("seq")).first()[0] == last


def test_random_points_lie_anywhere_on_the_whole_line(spark, small):
    whole = demo.lines(spark, small).agg(F.sum(F.size("line"))).first()[0]
    assert whole == demo.points(spark, small).count()
    assert integrity_queries.interpolate_random_points(spark, small).count() > 0


def test_ways_of_whole_trajectories(spark, small):
    """Ways of every step within six times its length, beyond LIMIT, too; against all pairs by brute force."""
    p = demo.points(spark, small).drop("t")
    edges = [(r.source, r.target) for r in demo.edges(spark, small).collect()]
    nodes = {v for e in edges for v in e}
    dist = {(a, b): 0.0 if a == b else math.inf for a in nodes for b in nodes} | dict.fromkeys(edges, 1.0)
    for k in nodes:
        for i in nodes:
            for j in nodes:
                dist[i, j] = min(dist[i, j], dist[i, k] + dist[k, j])
    cands = match_queries._whole(spark, small)
    rows = matching.limited_steps(cands, p, demo.edges(spark, small), match_queries.CONFIG).collect()
    assert len(rows) == matching.stepped(cands).count()
    longest = 0.0
    for r in rows:
        ahead = r.edge_id_a == r.edge_id_b and r.offset_a <= r.offset_b
        want = r.offset_b - r.offset_a if ahead else r.length_a - r.offset_a + r.offset_b + dist[r.target_a, r.source_b]
        assert (r.sp is None) if want > r.eu * 6 + 1e-9 else r.sp == pytest.approx(want)
        longest = max(longest, r.sp or 0.0)
    assert longest > demo.LIMIT
    matched = match_queries.stmatch_viterbi(spark, small)
    assert matched.agg(F.max("seq")).first()[0] > 20


@pytest.mark.parametrize("name", ["matched_edges_semi_join", "composite_graph_edges", "fmm_viterbi", "trajectory_length"])
def test_no_bound_on_trajectories(spark, name):
    """Against the registered SQL on tables of more trajectories."""
    con = duckdb.connect()
    for t in ("supplier", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{LARGER}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(tuple(r) for r in registry.queries()[name](spark, LARGER).select(*names).collect()) == sorted(found.fetchall())


def test_no_bound_on_events(spark, tmp_path):
    rows = [(i, i % 2, datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(1200)] + [(1200, 1, datetime(2023, 1, 1)), (1202, 2, datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.exact for r in registry.queries()["exact_path_accuracy"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: False, 2: True}
