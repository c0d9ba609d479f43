"""Queries on candidates, routing and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geodesy as D
from wayfold.functions import geometry as G
from wayfold.functions import hexagons
from wayfold.operators import alignment, candidates, covariance, evaluation, matching, network, paths, routing
from wayfold.operators.cells import match_cells
from wayfold.operators.path_table import PathTable, faults
from wayfold.operators.shared import checkpointed
from wayfold.plans import demo
from wayfold.plans.checks import r, sql

Spark, Frame = SparkSession, DataFrame
CONFIG = matching.MatchConfig(demo.K, demo.RADIUS, demo.SIGMA)
COVARIANCE = covariance.CovarianceConfig(k=4, min_candidates=3, min_sigma=0.01, map_sigma=0.02, phmi=1e-3, max_interval=1e9, max_speed=1e9)
ID = ("traj_id", "seq")
#: Side of the hexagonal cells.
HEX = 0.1


def _near(spark: Spark, sf: str) -> Frame:
    """All candidates of the trajectories; distances are rounded for the order of equal ones."""
    p = demo.points(spark, sf).select("traj_id", "seq", "event_id", "t", "x", "y")
    d = candidates.spatial_candidates(p, demo.edges(spark, sf), demo.RADIUS)
    return d.withColumn("dist", F.round("dist", 9))


def _top(spark: Spark, sf: str) -> Frame:
    return candidates.nearest(_near(spark, sf), demo.K).withColumn("ep", matching.emission(F.col("dist"), demo.SIGMA))


def _complete(spark: Spark, sf: str) -> Frame:
    """The k nearest candidates of whole trajectories, as a plan."""
    p = candidates.counted(demo.points(spark, sf).select("traj_id", "seq", "x", "y"))
    d = candidates.spatial_candidates(p, demo.edges(spark, sf), demo.RADIUS).withColumn("dist", F.round("dist", 9))
    return candidates.whole_trajectories(candidates.nearest(d, demo.K)).withColumn("ep", matching.emission(F.col("dist"), demo.SIGMA))


def _whole(spark: Spark, sf: str) -> Frame:
    return checkpointed(_complete(spark, sf))


def _od(spark: Spark, sf: str) -> Frame:
    """The path table, materialised: matching and path assembly read the same one."""
    return checkpointed(routing.od_table(demo.edges(spark, sf), demo.LIMIT))


def _steps(spark: Spark, sf: str) -> Frame:
    return matching.transitions(_whole(spark, sf), _od(spark, sf), CONFIG)


def _folded(spark: Spark, sf: str) -> tuple[Frame, Frame]:
    """All candidates with the fold's values, as a plan, and the path table."""
    od = _od(spark, sf)
    return matching.folded_over(_complete(spark, sf), od, CONFIG.reverse_tolerance), od


#: What results are made of, of a chosen candidate.
CHOSEN = ("traj_id", "seq", "edge_id", "source", "target", "length", "offset", "dist", "ep", "tp", "sp", "eu", "cumu", "trust", "chosen")


def _matched(spark: Spark, sf: str) -> tuple[Frame, Frame]:
    """The chosen candidates, materialised, and the path table."""
    m, od = _folded(spark, sf)
    return checkpointed(m.filter("chosen").select(*CHOSEN)), od


def _paths(matched: Frame, od: Frame) -> Frame:
    return paths.complete_paths(paths.path_steps(matched.filter("chosen"), od))


def spatial_candidate_join(spark: Spark, sf: str) -> Frame:
    return _near(spark, sf).select(*ID, "edge_id", r("dist").alias("dist"), r("offset").alias("offset"))


def knn_candidates(spark: Spark, sf: str) -> Frame:
    return _top(spark, sf).select(*ID, F.col("cand").cast("long").alias("cand"), "edge_id")


def candidate_complete_trajectories(spark: Spark, sf: str) -> Frame:
    """Of each trajectory's pieces of four points those whose points all have a candidate within a small radius."""
    four = (F.col("traj_id") * 1000 + F.floor(F.col("seq") / 4)).alias("traj_id")
    p = demo.points(spark, sf).select(four, "seq", "x", "y")
    near = candidates.nearest(candidates.spatial_candidates(p, demo.edges(spark, sf), 0.09), demo.K)
    return candidates.complete_trajectories(near, p).select("traj_id").distinct()


def emission_prob(spark: Spark, sf: str) -> Frame:
    return _top(spark, sf).select(*ID, "edge_id", r("ep").alias("ep"))


def od_table(spark: Spark, sf: str) -> Frame:
    return _od(spark, sf).select("source", "target", "next_n", "prev_n", "next_e", r("distance").alias("distance"))


def od_incremental(spark: Spark, sf: str) -> Frame:
    """The path table of four fifths of the edges, repaired after the last fifth is added."""
    e = demo.edges(spark, sf)
    table = PathTable(e.filter("edge_id % 5 <> 0"), demo.LIMIT)
    table.add_edges(e.filter("edge_id % 5 = 0"))
    done = table.search.ended(table.ways())
    return done.select("source", "target", r("distance").alias("distance"), F.size("path").cast("long").alias("edges"))


def od_faults(spark: Spark, sf: str) -> Frame:
    """What is wrong with a path table of which some rows were spoilt."""
    s, t = F.col("source"), F.col("target")
    od = _od(spark, sf).drop("path")
    spoilt = od.withColumn("distance", F.when((s + t) % 17 == 0, F.col("distance") + 1).otherwise(F.col("distance"))).withColumn("next_e", F.when((s * 3 + t) % 23 == 0, -1).otherwise(F.col("next_e")))
    return faults(spoilt.withColumn("prev_n", F.when((s + 2 * t) % 29 == 0, F.lit(None)).otherwise(F.col("prev_n"))), demo.edges(spark, sf))


def od_path_unroll(spark: Spark, sf: str) -> Frame:
    od = _od(spark, sf)
    d = routing.unrolled(od.drop("path"), od.select("source", "target"))
    return d.select("source", "target", F.array_join(F.transform("path", lambda e: e.cast("string")), ",").alias("path"))


def od_source_index(spark: Spark, sf: str) -> Frame:
    return routing.source_index(_od(spark, sf))


def partial_od_semi_join(spark: Spark, sf: str) -> Frame:
    return routing.partial_od(_od(spark, sf), demo.edges(spark, sf), (0.5, 0.0, 2.5, 1.5)).select("source", "target")


def _node(spark: Spark, sf: str, n: int, name: str) -> Frame:
    return demo.nodes(spark, sf).filter(F.col("node") == n).select(F.col("node").alias(name))


def shortest_path(spark: Spark, sf: str) -> Frame:
    d = routing.far_distances(demo.edges(spark, sf), _node(spark, sf, 0, "source"), 1e9)
    return d.select("target", r("distance").alias("distance"))


def bounded_sssp(spark: Spark, sf: str) -> Frame:
    d = routing.bounded_paths(demo.edges(spark, sf), _node(spark, sf, 5, "source"), 2.0)
    return d.select("target", r("distance").alias("distance"))


def bounded_reverse_sssp(spark: Spark, sf: str) -> Frame:
    one_way = demo.edges(spark, sf).filter("NOT (oneway AND target < source)")
    d = routing.reverse_paths(one_way, _node(spark, sf, 5, "target"), 2.0)
    return d.select("source", r("distance").alias("distance"))


def edges_within_distance(spark: Spark, sf: str) -> Frame:
    e, n = demo.edges(spark, sf), _node(spark, sf, 5, "node")
    return routing.edges_within(e, n, 2.0).unionByName(routing.edges_within(e, n, 2.0, backward=True)).distinct().select("edge_id")


def od_lookup_join(spark: Spark, sf: str) -> Frame:
    pairs = matching.stepped(_whole(spark, sf)).select("traj_id", F.col("target_a").alias("source"), F.col("source_b").alias("target"))
    return pairs.join(_od(spark, sf), ["source", "target"]).groupBy("traj_id").agg(F.count("*").alias("n"), r(F.sum("distance")).alias("total"))


def transition_matrix(spark: Spark, sf: str) -> Frame:
    d = matching.stepped(_whole(spark, sf))
    return d.select(*ID, "edge_id_a", "edge_id_b", r("eu").alias("eu"))


def fmm_sp_dist(spark: Spark, sf: str) -> Frame:
    d = _steps(spark, sf)
    return d.select(*ID, "edge_id_a", "edge_id_b", r(F.when(F.col("sp") == float("inf"), F.lit(-1.0)).otherwise(F.col("sp"))).alias("sp"))


def transition_prob(spark: Spark, sf: str) -> Frame:
    return _steps(spark, sf).select(*ID, "edge_id_a", "edge_id_b", r("tp").alias("tp"))


def transition_row_norm(spark: Spark, sf: str) -> Frame:
    w = Window.partitionBy(*ID, "edge_id_a")
    return _steps(spark, sf).filter("tp > 0").select(*ID, "edge_id_a", "edge_id_b", r(F.col("tp") / F.sum("tp").over(w)).alias("a"))


def fmm_viterbi(spark: Spark, sf: str) -> Frame:
    d = _folded(spark, sf)[0].filter("cumu > -1e300")
    return d.select(*ID, "edge_id", r("cumu").alias("cumu"))


def fmm_trust(spark: Spark, sf: str) -> Frame:
    return _folded(spark, sf)[0].filter("cumu > -1e300").select(*ID, "edge_id", r("trust").alias("trust"))


def viterbi_opath(spark: Spark, sf: str) -> Frame:
    """The likelihood of the path that was chosen, summed from its own emissions and transitions."""
    d = _matched(spark, sf)[0].filter("chosen")
    value = F.log("ep") + F.when(F.col("tp") > 0, F.log("tp")).otherwise(F.lit(0.0))
    return d.groupBy("traj_id").agg(F.count("*").alias("n"), r(F.sum(value)).alias("log_p"))


def _texts(*names: str) -> list:
    return [F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c) for c in names]


def complete_path(spark: Spark, sf: str) -> Frame:
    d = _paths(*_matched(spark, sf))
    return d.select("traj_id", F.size("opath").cast("long").alias("points"), F.size("cpath").cast("long").alias("edges"), *_texts("opath", "cpath", "indices"))


def tpath(spark: Spark, sf: str) -> Frame:
    return paths.traversed(_paths(*_matched(spark, sf))).select("traj_id", "tpath")


def matched_geometry(spark: Spark, sf: str) -> Frame:
    """The vertices of each trajectory's matched line."""
    m, od = _matched(spark, sf)
    ends = m.filter("chosen").groupBy("traj_id").agg(F.min_by("offset", "seq").alias("first_offset"), F.max_by("offset", "seq").alias("last_offset"))
    d = paths.geometry(_paths(m, od), demo.edges(spark, sf), ends).select("traj_id", F.posexplode("mgeom").alias("place", "p"))
    return d.select("traj_id", F.col("place").cast("long").alias("place"), r("p.x").alias("x"), r("p.y").alias("y"))


def match_rows_point_mode(spark: Spark, sf: str) -> Frame:
    m, od = _matched(spark, sf)
    d = paths.point_rows(m, _paths(m, od), demo.points(spark, sf))
    return d.withColumns({c: r(c) for c in ("x", "y", "ep", "tp", "sp", "eu", "cumu", "trust", "dist", "offset")})


def match_rows_trajectory_mode(spark: Spark, sf: str) -> Frame:
    m, od = _matched(spark, sf)
    scores = m.filter("chosen").groupBy("traj_id").agg(r(F.max_by("cumu", "seq")).alias("cumu"), r(F.avg("trust")).alias("trust"))
    return _paths(m, od).join(scores, "traj_id").select("traj_id", *_texts("opath", "cpath", "indices"), "cumu", "trust")


def match_summary(spark: Spark, sf: str) -> Frame:
    have = _whole(spark, sf).select(*ID).distinct().withColumn("hit", F.lit(1))
    d = demo.points(spark, sf).join(have, list(ID), "left")
    return d.agg(F.count("*").alias("points"), F.count("hit").alias("matched"), F.countDistinct("traj_id").alias("trajectories"), r(100.0 * F.count("hit") / F.count("*")).alias("percent"))


def realign_original_indices(spark: Spark, sf: str) -> Frame:
    d = demo.points(spark, sf).filter((F.col("event_id") % 3) != 0).select(*ID, F.col("x").alias("v"))
    return paths.realigned(d, "v").select(*ID, r("v").alias("v"))


def duration_speed(spark: Spark, sf: str) -> Frame:
    p = demo.points(spark, sf).withColumn("sp", F.lit(1.5))
    d = paths.durations(p)
    return d.select(*ID, r("duration").alias("duration"), r(F.col("speed") * 1000).alias("speed"))


def distinct_matched_edges(spark: Spark, sf: str) -> Frame:
    return _top(spark, sf).select("edge_id").distinct()


def matched_edges_semi_join(spark: Spark, sf: str) -> Frame:
    hit = _top(spark, sf).select("edge_id")
    return demo.edges(spark, sf).join(hit, "edge_id", "left_semi").select("edge_id", "source", "target")


def edge_match_with_reverse(spark: Spark, sf: str) -> Frame:
    truth = F.when(F.col("event_id") % 2 == 0, F.col("edge_id")).otherwise(F.col("edge_id") + F.when(F.col("edge_id") % 4 == 0, 5).otherwise(0))
    d = _top(spark, sf).filter("cand = 1").withColumn("truth", truth).join(network.reverse_edges(demo.edges(spark, sf)), "edge_id", "left")
    return d.select(*ID, ((F.col("edge_id") == F.col("truth")) | F.coalesce(F.col("reverse_id") == F.col("truth"), F.lit(False))).alias("correct"))


def stmatch_delta(spark: Spark, sf: str) -> Frame:
    w = Window.partitionBy("traj_id").orderBy("seq")
    d = demo.points(spark, sf).withColumn("eu", G.distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y"))).withColumn("dt", F.when(F.col("event_id") % 3 != 0, F.col("t") - F.lag("t").over(w)))
    return d.filter("seq > 0").select(*ID, F.round(matching.search_limit(F.col("eu"), F.col("dt"), CONFIG), 4).alias("delta"))


def stmatch_distances(spark: Spark, sf: str) -> Frame:
    """Ways between candidates of successive points without times, each within its step's own limit."""
    p = demo.points(spark, sf).drop("t")
    d = matching.limited_steps(_whole(spark, sf), p, demo.edges(spark, sf), CONFIG)
    return d.select(*ID, "edge_id_a", "edge_id_b", r(F.coalesce("sp", F.lit(-1.0))).alias("sp"))


def stmatch_viterbi(spark: Spark, sf: str) -> Frame:
    d = matching.st_folded(_whole(spark, sf), demo.points(spark, sf).drop("t"), demo.edges(spark, sf), CONFIG)
    return d.filter("chosen").select(*ID, "edge_id", r("ep").alias("ep"), F.round(F.col("cumu") + 3.7e-7, 5).alias("cumu"))


def _pairs(spark: Spark, sf: str) -> Frame:
    """Pairs of nodes across the whole lattice: each node with one drawn from its own number."""
    n = demo.nodes(spark, sf)
    count = n.count()
    return n.select(F.col("node").alias("source"), ((F.col("node") * 37 + 11) % count).alias("target"))


def bidirectional_paths(spark: Spark, sf: str) -> Frame:
    """Pairs across the network by searches from both ends."""
    d = routing.two_sided_paths(demo.edges(spark, sf), _pairs(spark, sf), 2.0)
    return d.select("source", "target", r("distance").alias("distance"), F.size("path").cast("long").alias("edges"))


def goal_directed_paths(spark: Spark, sf: str) -> Frame:
    """The same pairs by searches towards their goals."""
    d = routing.goal_directed_paths(demo.edges(spark, sf), demo.nodes(spark, sf), _pairs(spark, sf))
    return d.select("source", "target", r("distance").alias("distance"), F.size("path").cast("long").alias("edges"))


def composite_graph_edges(spark: Spark, sf: str) -> Frame:
    d = matching.composite_edges(_whole(spark, sf))
    return d.groupBy("traj_id", F.col("seq")).agg(F.count("*").alias("n"), r(F.sum("cost")).alias("cost"))


def grid_cell_match(spark: Spark, sf: str) -> Frame:
    """Grid cells that a trajectory enters, successive repeats dropped."""
    p = demo.points(spark, sf).withColumn("cx", F.floor("x").cast("long")).withColumn("cy", F.floor("y").cast("long"))
    w = Window.partitionBy("traj_id").orderBy("seq")
    moved = F.coalesce((F.col("cx") != F.lag("cx").over(w)) | (F.col("cy") != F.lag("cy").over(w)), F.lit(True))
    return p.withColumn("moved", moved).filter("moved").select(*ID, "cx", "cy")


def hex_cell_match(spark: Spark, sf: str) -> Frame:
    """Hexagonal cells that a trajectory enters, with those on the line between its points, and the cell of the next level."""
    d = match_cells(demo.points(spark, sf), HEX).withColumn("up", hexagons.parent(F.col("cell")))
    cell = {"q": "cell.q", "r": "cell.r", "parent_q": "up.q", "parent_r": "up.r"}
    return d.select(*ID, F.col("step").cast("long").alias("step"), *(F.col(c).alias(n) for n, c in cell.items()), hexagons.number(F.col("cell")).alias("number"))


def hex_level_counts(spark: Spark, sf: str) -> Frame:
    """Points and trajectories of each cell two levels up; counted by cell of level 0 first."""
    p = demo.points(spark, sf).select("traj_id", hexagons.at(F.col("x"), F.col("y"), HEX).alias("cell"))
    low = p.groupBy("cell", "traj_id").agg(F.count("*").alias("n"))
    d = low.groupBy(hexagons.ancestor(F.col("cell"), 2).alias("cell")).agg(F.sum("n").alias("points"), F.countDistinct("traj_id").alias("trajectories"))
    return d.select("cell.q", "cell.r", "points", "trajectories")


def gap_segmentation(spark: Spark, sf: str) -> Frame:
    d = alignment.time_gaps(demo.points(spark, sf), 20_000.0, 3)
    return d.select(*ID, F.col("run").cast("long").alias("run"))


def speed_split(spark: Spark, sf: str) -> Frame:
    d = alignment.speed_cuts(demo.points(spark, sf), 0.001)
    return d.select(*ID, F.col("run").cast("long").alias("run"))


def continuity_jumps(spark: Spark, sf: str) -> Frame:
    w = Window.partitionBy("traj_id").orderBy("seq")
    d = demo.points(spark, sf).withColumn("step", G.distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")))
    return d.groupBy("traj_id").agg(F.count(F.when(F.col("step") > 1, 1)).alias("jumps"), r(F.sum("step")).alias("total"), r(F.max("step")).alias("greatest"))


def cmm_cov_floor(spark: Spark, sf: str) -> Frame:
    c = covariance.floored(F.col("sde") - 0.055, F.col("sdn") - 0.035, F.col("sdne"), 0.03)
    return demo.points(spark, sf).select("event_id", *(r(c[k]).alias(k) for k in ("sde", "sdn", "sdne")))


def mahalanobis_projection(spark: Spark, sf: str) -> Frame:
    line = F.array(G.point(F.lit(0.0), F.lit(0.0)), G.point(F.lit(4.0), F.lit(2.0)))
    v = covariance.anisotropic(line, F.col("x"), F.col("y"), F.col("sde") * F.col("sde"), F.col("sdn") * F.col("sdn"), F.col("sdne"))
    return demo.points(spark, sf).select("event_id", F.round(v["metric"] + 3.7e-5, 3).alias("metric"), r(v["dist"]).alias("dist"), r(v["offset"]).alias("offset"))


def cmm_log_emission(spark: Spark, sf: str) -> Frame:
    see, snn, sen = F.col("sde") * F.col("sde") + 0.0004, F.col("sdn") * F.col("sdn") + 0.0004, F.col("sdne")
    v = covariance.log_emission(D.mahalanobis_squared(F.lit(0.1), F.col("event_id") % 7 / 20.0, see, snn, sen), see, snn, sen)
    return demo.points(spark, sf).select("event_id", r(v).alias("log_ep"))


def _cmm_edges(spark: Spark, sf: str) -> Frame:
    """The network without one-way marks: the reverse guard that they switch on needs the path taken so far."""
    return demo.edges(spark, sf).drop("oneway")


def _emitted(spark: Spark, sf: str, config: covariance.CovarianceConfig = COVARIANCE) -> Frame:
    p = demo.points(spark, sf).drop("event_id")
    return covariance.emissions(covariance.covariance_candidates(p, _cmm_edges(spark, sf), config, 1.0), config)


def cmm_candidates(spark: Spark, sf: str) -> Frame:
    return _emitted(spark, sf).select(*ID, "edge_id", F.col("cand").cast("long").alias("cand"), r("dist").alias("dist"), r("offset").alias("offset"))


def _cmm(spark: Spark, sf: str, config: covariance.CovarianceConfig) -> Frame:
    return covariance.covariance_match(demo.points(spark, sf).drop("event_id"), _cmm_edges(spark, sf), _od(spark, sf), config, 1.0)


def cmm_forward(spark: Spark, sf: str) -> Frame:
    d = _cmm(spark, sf, COVARIANCE)
    return d.select(*ID, F.col("part").cast("long").alias("part"), "status", F.col("cand").cast("long").alias("cand"), "edge_id", r("cumu").alias("cumu"), r("trust").alias("trust"), r("entropy").alias("entropy"))


def lag_smoothing(spark: Spark, sf: str) -> Frame:
    from dataclasses import replace

    d = _cmm(spark, sf, replace(COVARIANCE, lag_steps=2))
    return d.select(*ID, F.col("cand").cast("long").alias("cand"), "edge_id", r("trust").alias("trust"), r("entropy").alias("entropy"))


def background_state(spark: Spark, sf: str) -> Frame:
    """Probabilities of the candidates and of the state off the road (edge -1)."""
    from dataclasses import replace

    config = replace(COVARIANCE, background=0.05)
    d = covariance.with_background(_emitted(spark, sf, config), config)
    return d.select(*ID, F.coalesce("edge_id", F.lit(-1)).alias("edge_id"), r("ep").alias("ep"))


def phmi_emission_norm(spark: Spark, sf: str) -> Frame:
    """Densities normalised apart within and beyond the protection level."""
    return _emitted(spark, sf).select(*ID, "edge_id", r("ep").alias("ep"))


def softmax_posterior(spark: Spark, sf: str) -> Frame:
    """Posteriors of the filter at every point: the softmax of the forward values."""
    return _cmm(spark, sf, COVARIANCE).select(*ID, "edge_id", r("trust").alias("p"))


def log_sum_exp(spark: Spark, sf: str) -> Frame:
    """The evidence of each point but the first by the forward values of the plain matcher: log of the sum over candidates."""
    d = _folded(spark, sf)[0].filter("cumu > -1e300")
    # trust is exp(best - total), so the total comes back from the candidate of most trust
    return d.groupBy(*ID).agg(r(F.max_by(F.col("cumu") - F.log("trust"), F.struct("trust", "cand"))).alias("lse"))


def entropy_bits(spark: Spark, sf: str) -> Frame:
    """Entropy of the filter's posteriors."""
    return _cmm(spark, sf, COVARIANCE).groupBy(*ID).agg(r(F.max("entropy")).alias("bits"))


def top3_scores(spark: Spark, sf: str) -> Frame:
    """The three best posteriors of each point."""
    d = _cmm(spark, sf, COVARIANCE).groupBy(*ID).agg(F.slice(F.sort_array(F.collect_list(r("trust")), asc=False), 1, 3).alias("best"))
    return d.select(*ID, F.posexplode("best").alias("place", "score")).select(*ID, F.col("place").cast("long").alias("place"), "score")


def _hex(name: str, source: str, q: str, r: str, keep: str) -> str:
    """SQL of the cell nearest to a place (q, r) between cells, as columns q and r beside those kept."""
    return f"""{name}_0 AS (SELECT {keep}, {q} AS fq, {r} AS fr FROM {source}), {name}_1 AS (SELECT *, floor(fq + 0.5) AS a, floor(fr + 0.5) AS b, floor(-fq - fr + 0.5) AS c FROM {name}_0),
{name} AS (SELECT {keep}, (CASE WHEN abs(a - fq) > abs(b - fr) AND abs(a - fq) > abs(c + fq + fr) THEN -b - c ELSE a END)::BIGINT AS q,
  (CASE WHEN abs(a - fq) > abs(b - fr) AND abs(a - fq) > abs(c + fq + fr) THEN b WHEN abs(b - fr) > abs(c + fq + fr) THEN -a - c ELSE b END)::BIGINT AS r FROM {name}_1)"""


HEX_POINTS = f"{demo.POINTS}, " + _hex("at_cell", "points", f"(x * (sqrt(3) / 3) - y / 3) / {HEX}::DOUBLE", f"y * 2 / 3 / {HEX}::DOUBLE", "traj_id, seq")
HEX_WAYS = f"""{HEX_POINTS}, l AS (SELECT *, lag(q) OVER w AS pq, lag(r) OVER w AS pr FROM at_cell WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
n AS (SELECT *, coalesce((abs(q - pq) + abs(r - pr) + abs(q + r - pq - pr)) // 2, 0) AS n FROM l WHERE pq IS NULL OR pq <> q OR pr <> r),
s AS (SELECT *, unnest(generate_series(CASE WHEN pq IS NULL THEN 0 ELSE 1 END, n)) AS step FROM n), """
HEX_WAYS += _hex("way", "s", "coalesce(pq + (q - pq) * (step::DOUBLE / n), q) + 1e-6::DOUBLE", "coalesce(pr + (r - pr) * (step::DOUBLE / n), r) + 2e-6::DOUBLE", "traj_id, seq, step")
HEX_UP = lambda q, r: f"floor((2 * (3 * {q} + {r}) + 7) / 14)::BIGINT AS {q}, floor((2 * (2 * {r} - {q}) + 7) / 14)::BIGINT AS {r}"

WHOLE = f"{demo.CANDIDATES}, {demo.OD}, whole AS MATERIALIZED (SELECT * FROM top WHERE traj_id IN (SELECT s.traj_id FROM points s LEFT JOIN (SELECT DISTINCT traj_id, seq FROM top) t USING (traj_id, seq) GROUP BY 1 HAVING count(*) = count(t.seq) AND count(*) >= 2))"
STEPS = f"""{WHOLE}, st0 AS (SELECT b.traj_id, b.seq, a.edge_id AS edge_id_a, b.edge_id AS edge_id_b, a.cand AS cand_a, b.cand AS cand_b, b.ep AS ep_b, a.target AS target_a, b.source AS source_b, a."offset" AS oa, b."offset" AS ob, a.length AS la,
  sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS eu FROM whole a JOIN whole b ON b.traj_id = a.traj_id AND b.seq = a.seq + 1),
st1 AS (SELECT st0.*, CASE WHEN edge_id_a = edge_id_b AND oa <= ob THEN ob - oa WHEN target_a = source_b THEN la - oa + ob WHEN od.cost IS NOT NULL THEN od.cost + la - oa + ob END AS sp
  FROM st0 LEFT JOIN od ON od.source = target_a AND od.target = source_b),
st AS MATERIALIZED (SELECT *, CASE WHEN sp IS NULL THEN 0 WHEN eu >= sp THEN 1 ELSE eu / sp END AS tp FROM st1)"""
FORWARD = f"""WITH RECURSIVE {STEPS}, v AS (SELECT traj_id, seq, cand, edge_id, ln(ep) AS cumu, ep AS f FROM whole WHERE seq = 0
  UNION ALL SELECT st.traj_id, st.seq, st.cand_b, any_value(st.edge_id_b), max(v.cumu + ln(st.tp) + ln(st.ep_b)), sum(v.f * st.tp * st.ep_b) FROM v JOIN st ON st.traj_id = v.traj_id AND st.seq = v.seq + 1 AND st.cand_a = v.cand WHERE st.tp > 0 GROUP BY 1, 2, 3)"""
T = f"WITH {demo.CANDIDATES}"
# candidates under a point's covariance: operations in the order of the operators', so equal distances stay equal
PHMI, FLOOR = COVARIANCE.phmi, COVARIANCE.map_sigma**2
CMM = f"""{demo.POINTS}, {demo.EDGES},
pairs AS (SELECT p.traj_id, p.seq, p.x, p.y, p.pl, p.sde, p.sdn, p.sdne, e.edge_id, e.source, e.target, e.length, x1, y1, x2, y2, x2 - x1 AS ux, y2 - y1 AS uy, p.x - x1 AS vx, p.y - y1 AS vy FROM points p, edges e),
feet AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, (vx * ux + vy * uy) / (ux * ux + uy * uy))) AS share FROM pairs),
plain AS (SELECT *, sqrt((x1 + share * ux - x) * (x1 + share * ux - x) + (y1 + share * uy - y) * (y1 + share * uy - y)) AS near FROM feet),
ranges AS (SELECT traj_id, seq, CASE WHEN count(*) FILTER (near <= pl) < {COVARIANCE.min_candidates} THEN 2 * any_value(pl) ELSE any_value(pl) END AS radius FROM plain GROUP BY 1, 2),
ranked AS (SELECT plain.*, radius, row_number() OVER (PARTITION BY traj_id, seq ORDER BY near, edge_id) AS rank FROM plain JOIN ranges USING (traj_id, seq) WHERE near <= radius),
inverse AS (SELECT *, (sde * sde) * (sdn * sdn) - sdne * sdne AS det FROM ranked WHERE rank <= {COVARIANCE.k}),
weights AS (SELECT *, (sdn * sdn) / det AS wa, (sde * sde) / det AS wb, -sdne / det AS wc FROM inverse),
shares AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, (wa * ux * vx + wc * (ux * vy + uy * vx) + wb * uy * vy) / (wa * ux * ux + wc * (ux * uy + uy * ux) + wb * uy * uy))) AS m_share FROM weights),
moved AS (SELECT *, x - x1 - m_share * ux AS mx, y - y1 - m_share * uy AS my FROM shares),
three AS (SELECT *, wa * mx * mx + wc * (mx * my + my * mx) + wb * my * my AS metric, sqrt(mx * mx + my * my) AS dist, m_share * sqrt(ux * ux + uy * uy) AS "offset", mx AS dx, my AS dy FROM moved
  UNION ALL SELECT *, ((sdn * sdn) * vx * vx - 2 * sdne * vx * vy + (sde * sde) * vy * vy) / det, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)), 0, vx, vy FROM moved WHERE sqrt(vx * vx + vy * vy) <= radius
  UNION ALL SELECT *, ((sdn * sdn) * (x - x2) * (x - x2) - 2 * sdne * (x - x2) * (y - y2) + (sde * sde) * (y - y2) * (y - y2)) / det, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), length, x - x2, y - y2 FROM moved WHERE sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) <= radius),
best AS (SELECT * FROM three QUALIFY row_number() OVER (PARTITION BY traj_id, seq, edge_id ORDER BY metric, dist, "offset") = 1),
picked AS (SELECT *, row_number() OVER (PARTITION BY traj_id, seq ORDER BY metric, edge_id) AS cand, sde * sde + {FLOOR}::DOUBLE AS a, sdn * sdn + {FLOOR}::DOUBLE AS b FROM best),
dense AS (SELECT *, greatest(exp(-0.5 * (ln(2 * pi()) + ln(a * b - sdne * sdne + 1e-12::DOUBLE) + (b * dx * dx - 2 * sdne * dx * dy + a * dy * dy) / (a * b - sdne * sdne))), 2.2250738585072014e-308::DOUBLE) AS density, dist <= pl AS inside FROM picked WHERE cand <= {max(COVARIANCE.k, COVARIANCE.min_candidates)}),
cmm AS MATERIALIZED (SELECT *, CASE WHEN inside THEN {1 - PHMI}::DOUBLE ELSE {PHMI}::DOUBLE END * density / sum(density) OVER (PARTITION BY traj_id, seq, inside) AS ep FROM dense)"""
# ways between candidates of successive points, the normalised transitions, and the filter over them
FILTER = f"""WITH RECURSIVE {CMM}, {demo.OD},
gone AS (SELECT b.traj_id, b.seq, a.cand AS cand_a, b.cand AS cand_b, b.edge_id AS edge_b, b.ep AS ep_b, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS eu, a.length - a."offset" AS rest, b."offset" AS ob, a."offset" - b."offset" AS back,
  a.edge_id = b.edge_id AS same, a.target = b.source AS meets, od.cost, (SELECT count(*) FROM od o WHERE o.source = a.target AND o.target = a.source) > 0 AS round, a.length AS la
  FROM cmm a JOIN cmm b ON b.traj_id = a.traj_id AND b.seq = a.seq + 1 LEFT JOIN od ON od.source = a.target AND od.target = b.source),
way AS (SELECT *, CASE WHEN same AND back <= 0 THEN -back WHEN same AND back <= greatest(0.15::DOUBLE * la, 1e-7::DOUBLE) THEN 0 WHEN same AND round THEN back WHEN same THEN -1 WHEN meets THEN rest + ob WHEN cost IS NOT NULL THEN cost + rest + ob ELSE -1 END AS sp FROM gone),
raw AS (SELECT *, CASE WHEN sp < 0 THEN 0 WHEN eu >= sp THEN 1 ELSE eu / sp END AS tp FROM way),
a AS MATERIALIZED (SELECT *, tp / sum(tp) OVER (PARTITION BY traj_id, seq, cand_a) AS p FROM raw),
v AS (SELECT traj_id, seq, cand, edge_id, ln(ep) - ln(count(*) OVER (PARTITION BY traj_id)) AS cumu, ep / count(*) OVER (PARTITION BY traj_id) AS f FROM cmm WHERE seq = 0
  UNION ALL SELECT a.traj_id, a.seq, a.cand_b, any_value(a.edge_b), max(v.cumu + ln(a.p) + ln(a.ep_b)), sum(v.f * a.p * a.ep_b) FROM v JOIN a ON a.traj_id = v.traj_id AND a.seq = v.seq + 1 AND a.cand_a = v.cand WHERE a.p > 0 GROUP BY 1, 2, 3),
post AS (SELECT *, f / sum(f) OVER (PARTITION BY traj_id, seq) AS trust FROM v)"""
# the chosen candidates (of equal predecessors the first), and the edges that they enter
BEST = f"""{FORWARD}, b AS (SELECT traj_id, seq, cand, ln(ep) AS cumu, [cand] AS way FROM whole WHERE seq = 0
  UNION ALL SELECT st.traj_id, st.seq, st.cand_b, max(b.cumu + ln(st.tp) + ln(st.ep_b)), max_by(list_append(b.way, st.cand_b), (b.cumu + ln(st.tp) + ln(st.ep_b), -b.cand)) FROM b JOIN st ON st.traj_id = b.traj_id AND st.seq = b.seq + 1 AND st.cand_a = b.cand WHERE st.tp > 0 GROUP BY 1, 2, 3),
ends AS (SELECT traj_id, max(seq) AS seq FROM points GROUP BY 1),
ways AS (SELECT traj_id, max_by(way, (cumu, -cand)) AS way FROM b JOIN ends USING (traj_id, seq) GROUP BY 1),
chosen AS (SELECT traj_id, unnest(way) AS cand, generate_subscripts(way, 1) - 1 AS seq FROM ways),
picked AS (SELECT w.* FROM chosen JOIN whole w USING (traj_id, seq, cand)),
linked AS (SELECT *, lag(cand) OVER w AS cand_a, lag(edge_id) OVER w AS edge_a, lag(target) OVER w AS target_a, lag("offset") OVER w AS offset_a FROM picked WINDOW w AS (PARTITION BY traj_id ORDER BY seq)),
entered AS (SELECT l.*, CASE WHEN edge_a IS NULL THEN [l.edge_id] WHEN l.edge_id = edge_a AND offset_a <= l."offset" THEN []::BIGINT[] WHEN l.edge_id = edge_a OR target_a = l.source THEN [l.edge_id] ELSE list_append(od.path, l.edge_id) END AS step FROM linked l LEFT JOIN od ON od.source = l.target_a AND od.target = l.source),
placed AS (SELECT *, (sum(len(step)) OVER (PARTITION BY traj_id ORDER BY seq) - 1)::BIGINT AS place FROM entered),
whole_paths AS (SELECT traj_id, list(edge_id ORDER BY seq) AS opath, flatten(list(step ORDER BY seq)) AS cpath, list(place ORDER BY seq) AS indices, arg_min("offset", seq) AS first_offset, arg_max("offset", seq) AS last_offset FROM placed GROUP BY 1)"""
LISTS = "array_to_string(opath, ',') AS opath, array_to_string(cpath, ',') AS cpath, array_to_string(indices, ',') AS indices"
# each chosen candidate with the values of its best transition
SCORED = f"""{BEST}, sums AS (SELECT traj_id, seq, sum(f) AS f FROM v GROUP BY 1, 2),
scored AS (SELECT p.*, coalesce(st.tp, 0) AS tp, coalesce(st.sp, 0) AS sp, coalesce(st.eu, 0) AS eu, v.cumu, exp(v.cumu) / sums.f AS trust FROM placed p JOIN v USING (traj_id, seq, cand) JOIN sums USING (traj_id, seq)
  LEFT JOIN st ON st.traj_id = p.traj_id AND st.seq = p.seq AND st.cand_a = p.cand_a AND st.cand_b = p.cand)"""
# without times a step's ways may be six times as long as the step; the later one of equal predecessors counts
REACH = f"""WITH RECURSIVE {WHOLE}, most AS (SELECT ceil(6 * max(sqrt((x - px) ** 2 + (y - py) ** 2))) AS most FROM (SELECT x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) q),
walk AS (SELECT DISTINCT source, source AS node, 0 AS d FROM edges UNION SELECT k.source, e.target, k.d + 1 FROM walk k JOIN edges e ON e.source = k.node WHERE k.d < (SELECT most FROM most)),
far AS MATERIALIZED (SELECT source, node AS target, min(d)::DOUBLE AS cost FROM walk GROUP BY 1, 2),
st0 AS (SELECT b.traj_id, b.seq, a.edge_id AS edge_id_a, b.edge_id AS edge_id_b, a.cand AS cand_a, b.cand AS cand_b, b.ep AS ep_b, a.target AS target_a, b.source AS source_b, a."offset" AS oa, b."offset" AS ob, a.length AS la,
  sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS eu FROM whole a JOIN whole b ON b.traj_id = a.traj_id AND b.seq = a.seq + 1),
st1 AS (SELECT st0.*, CASE WHEN edge_id_a = edge_id_b AND oa <= ob THEN ob - oa WHEN target_a = source_b THEN la - oa + ob WHEN far.cost IS NOT NULL THEN far.cost + la - oa + ob END AS sp FROM st0 LEFT JOIN far ON far.source = target_a AND far.target = source_b),
st2 AS (SELECT *, CASE WHEN sp <= eu * 6 THEN sp ELSE 1.7976931348623157e308::DOUBLE END AS way FROM st1),
st AS MATERIALIZED (SELECT *, CASE WHEN eu >= way THEN 1 ELSE eu / way END AS tp FROM st2)"""
LATER = f"""{REACH}, b AS (SELECT traj_id, seq, cand, ln(ep) AS cumu, [cand] AS way, [ln(ep)] AS values FROM whole WHERE seq = 0
  UNION ALL SELECT st.traj_id, st.seq, st.cand_b, max(b.cumu + ln(st.tp) + ln(st.ep_b)), max_by(list_append(b.way, st.cand_b), (b.cumu + ln(st.tp) + ln(st.ep_b), b.cand)), max_by(list_append(b.values, b.cumu + ln(st.tp) + ln(st.ep_b)), (b.cumu + ln(st.tp) + ln(st.ep_b), b.cand))
  FROM b JOIN st ON st.traj_id = b.traj_id AND st.seq = b.seq + 1 AND st.cand_a = b.cand WHERE st.tp > 0 GROUP BY 1, 2, 3),
ends AS (SELECT traj_id, max(seq) AS seq FROM points GROUP BY 1),
ways AS (SELECT traj_id, max_by(way, (cumu, -cand)) AS way, max_by(values, (cumu, -cand)) AS values FROM b JOIN ends USING (traj_id, seq) GROUP BY 1),
chosen AS (SELECT traj_id, unnest(way) AS cand, unnest(values) AS cumu, generate_subscripts(way, 1) - 1 AS seq FROM ways)"""
#: Smoothing over two points ahead: the best continuation of each candidate, from the raw transitions.
SMOOTH = f"""{FILTER}, one AS (SELECT traj_id, seq - 1 AS seq, cand_a AS cand, max(ln(tp) + ln(ep_b)) AS one FROM raw WHERE tp > 0 GROUP BY 1, 2, 3),
two AS (SELECT a.traj_id, a.seq - 1 AS seq, a.cand_a AS cand, max(ln(a.tp) + ln(a.ep_b) + o.one) AS two FROM raw a JOIN one o ON o.traj_id = a.traj_id AND o.seq = a.seq AND o.cand = a.cand_b WHERE a.tp > 0 GROUP BY 1, 2, 3),
size AS (SELECT traj_id, max(seq) AS last FROM v GROUP BY 1),
score AS (SELECT v.traj_id, v.seq, v.cand, v.edge_id, post.trust AS own, size.last, CASE WHEN v.seq = size.last - 1 THEN v.cumu + one ELSE v.cumu + two END AS score FROM v JOIN size USING (traj_id) JOIN post USING (traj_id, seq, cand) LEFT JOIN one USING (traj_id, seq, cand) LEFT JOIN two USING (traj_id, seq, cand)),
soft AS (SELECT *, coalesce(exp(score - max(score) OVER w), 0) AS e FROM score WINDOW w AS (PARTITION BY traj_id, seq)),
smooth AS (SELECT traj_id, seq, cand, edge_id, CASE WHEN seq = last THEN own ELSE e / sum(e) OVER (PARTITION BY traj_id, seq) END AS trust FROM soft)"""
PAIRS = "pairs AS (SELECT s_suppkey AS source, (s_suppkey * 37 + 11) % (SELECT count(*) FROM supplier) AS target FROM supplier)"
ROUTED = f"WITH RECURSIVE {demo.EDGES}, {PAIRS}, walk AS (SELECT DISTINCT source, source AS node, 0 AS d FROM pairs UNION SELECT k.source, e.target, k.d + 1 FROM walk k JOIN edges e ON e.source = k.node WHERE k.d < (SELECT count(*) FROM supplier) // {demo.WIDTH} + 2 * {demo.WIDTH}) SELECT p.source, p.target, {sql('min(d)')} AS distance, min(d)::BIGINT AS edges FROM pairs p JOIN walk k ON k.source = p.source AND k.node = p.target WHERE p.source <> p.target GROUP BY 1, 2"
P, SP = f"WITH {demo.POINTS}", f"WITH {demo.POINTS}"
E = f"WITH RECURSIVE {demo.EDGES}"


def _reach(start: str, limit: str, where: str = "true", near: str = "source", far: str = "target") -> str:
    """Distances from a node by rounds (all edges have length 1)."""
    return f"{E}, e AS (SELECT * FROM edges WHERE {where}), w AS (SELECT {start}::BIGINT AS node, 0::BIGINT AS d WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = {start}) UNION SELECT e.{far}, w.d + 1 FROM w JOIN e ON e.{near} = w.node WHERE w.d + 1 <= {limit})"


ORACLE_SQL = {
    "spatial_candidate_join": f"{T} SELECT traj_id, seq, edge_id, {sql('dist')} AS dist, {sql(chr(34) + 'offset' + chr(34))} AS \"offset\" FROM cands",
    "knn_candidates": f"{T} SELECT traj_id, seq, cand::BIGINT AS cand, edge_id FROM top",
    "candidate_complete_trajectories": f"{T}, p AS (SELECT (traj_id * 1000 + seq // 4)::BIGINT AS piece, traj_id, seq FROM points) SELECT piece AS traj_id FROM p LEFT JOIN (SELECT DISTINCT traj_id, seq FROM close WHERE dist <= 0.09) t USING (traj_id, seq) GROUP BY 1 HAVING count(*) = count(t.seq) AND count(*) >= 2",
    "emission_prob": f"{T} SELECT traj_id, seq, edge_id, {sql('ep')} AS ep FROM top",
    "od_table": f"WITH {demo.EDGES}, {demo.OD} SELECT od.source, od.target, e.target AS next_n, prev_n, next_e, {sql('cost')} AS distance FROM od JOIN edges e ON e.edge_id = next_e",
    "od_incremental": f"WITH {demo.EDGES}, {demo.OD} SELECT source, target, {sql('cost')} AS distance, len(path) AS edges FROM od",
    "od_faults": f"""WITH {demo.EDGES}, {demo.OD}, rows AS (SELECT od.source, od.target, e.target AS next_n, CASE WHEN (od.source + 2 * od.target) % 29 = 0 THEN NULL ELSE prev_n END AS prev_n,
  CASE WHEN (od.source * 3 + od.target) % 23 = 0 THEN -1 ELSE next_e END AS next_e, cost + CASE WHEN (od.source + od.target) % 17 = 0 THEN 1 ELSE 0 END AS distance FROM od JOIN edges e ON e.edge_id = next_e),
f AS (SELECT r.*, e.source AS es, e.target AS et, e.length AS el, CASE WHEN r.next_n = r.target THEN 0 ELSE n.distance END AS rest FROM rows r LEFT JOIN edges e ON e.edge_id = r.next_e LEFT JOIN rows n ON n.source = r.next_n AND n.target = r.target)
SELECT source, target, 'null' AS fault FROM f WHERE prev_n IS NULL UNION ALL SELECT source, target, 'first edge' FROM f WHERE prev_n IS NOT NULL AND (es IS NULL OR es <> source OR et <> next_n)
UNION ALL SELECT source, target, 'last node' FROM f WHERE prev_n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = prev_n AND e.target = f.target)
UNION ALL SELECT source, target, 'rest' FROM f WHERE prev_n IS NOT NULL AND NOT coalesce(abs(el + rest - distance) <= 1e-6, false)""",
    "od_path_unroll": f"WITH {demo.EDGES}, {demo.OD} SELECT source, target, array_to_string(path, ',') AS path FROM od",
    "od_source_index": f"WITH {demo.EDGES}, {demo.OD} SELECT source, count(*)::BIGINT AS rows FROM od GROUP BY 1",
    "partial_od_semi_join": f"WITH {demo.EDGES}, {demo.OD}, n AS (SELECT unnest([source, target]) AS n FROM edges WHERE least(x1, x2) <= 2.5 AND greatest(x1, x2) >= 0.5 AND least(y1, y2) <= 1.5 AND greatest(y1, y2) >= 0) SELECT source, target FROM od WHERE source IN (SELECT n FROM n)",
    "shortest_path": f"WITH {demo.EDGES} SELECT s_suppkey AS target, {sql(f's_suppkey % {demo.WIDTH} + s_suppkey // {demo.WIDTH}')} AS distance FROM supplier",
    "bounded_sssp": f"{_reach('5', '2')} SELECT node AS target, {sql('min(d)')} AS distance FROM w GROUP BY 1",
    "bounded_reverse_sssp": f"{_reach('5', '2', 'NOT (oneway AND target < source)', 'target', 'source')} SELECT node AS source, {sql('min(d)')} AS distance FROM w GROUP BY 1",
    "edges_within_distance": f"{_reach('5', '1')} SELECT DISTINCT edge_id FROM edges WHERE source IN (SELECT node FROM w) OR target IN (SELECT node FROM w)",
    "od_lookup_join": f"WITH {STEPS} SELECT st.traj_id, count(*)::BIGINT AS n, {sql('sum(od.cost)')} AS total FROM st JOIN od ON od.source = target_a AND od.target = source_b GROUP BY 1",
    "transition_matrix": f"WITH {STEPS} SELECT traj_id, seq, edge_id_a, edge_id_b, {sql('eu')} AS eu FROM st",
    "fmm_sp_dist": f"WITH {STEPS} SELECT traj_id, seq, edge_id_a, edge_id_b, {sql('coalesce(sp, -1)')} AS sp FROM st",
    "transition_prob": f"WITH {STEPS} SELECT traj_id, seq, edge_id_a, edge_id_b, {sql('tp')} AS tp FROM st",
    "transition_row_norm": f"WITH {STEPS} SELECT traj_id, seq, edge_id_a, edge_id_b, {sql('tp / sum(tp) OVER (PARTITION BY traj_id, seq, edge_id_a)')} AS a FROM st WHERE tp > 0",
    "fmm_viterbi": f"{FORWARD} SELECT traj_id, seq, edge_id, {sql('cumu')} AS cumu FROM v",
    "fmm_trust": f"{FORWARD} SELECT traj_id, seq, edge_id, {sql('exp(cumu) / sum(f) OVER (PARTITION BY traj_id, seq)')} AS trust FROM v",
    "viterbi_opath": f"{FORWARD}, n AS (SELECT traj_id, count(*)::BIGINT AS n FROM points GROUP BY 1) SELECT v.traj_id, n.n, {sql('max(cumu)')} AS log_p FROM v JOIN n USING (traj_id) WHERE v.seq = n.n - 1 GROUP BY 1, 2",
    "match_summary": f"WITH {WHOLE}, hits AS (SELECT DISTINCT traj_id, seq, 1 AS hit FROM whole) SELECT count(*)::BIGINT AS points, count(hit)::BIGINT AS matched, count(DISTINCT points.traj_id)::BIGINT AS trajectories, {sql('100 * count(hit) / count(*)')} AS percent FROM points LEFT JOIN hits USING (traj_id, seq)",
    "realign_original_indices": f"{SP}, v AS (SELECT traj_id, seq, x FROM points WHERE event_id % 3 <> 0), m AS (SELECT traj_id, max(seq) AS last FROM v GROUP BY 1), s AS (SELECT traj_id, unnest(range(last + 1))::BIGINT AS seq FROM m) SELECT traj_id, seq, {sql('coalesce(x, -1)')} AS v FROM s LEFT JOIN v USING (traj_id, seq)",
    "duration_speed": f"{SP}, d AS (SELECT traj_id, seq, coalesce(t - lag(t) OVER (PARTITION BY traj_id ORDER BY seq), 0) AS d FROM points) SELECT traj_id, seq, {sql('d')} AS duration, {sql('CASE WHEN d > 0 THEN 1500 / d ELSE 0 END')} AS speed FROM d",
    "distinct_matched_edges": f"{T} SELECT DISTINCT edge_id FROM top",
    "matched_edges_semi_join": f"{T} SELECT edge_id, source, target FROM edges WHERE edge_id IN (SELECT edge_id FROM top)",
    "edge_match_with_reverse": f"{T}, q AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN edge_id WHEN edge_id % 4 = 0 THEN edge_id + 5 ELSE edge_id END AS truth FROM top WHERE cand = 1) SELECT traj_id, seq, (edge_id = truth OR EXISTS (SELECT 1 FROM edges e WHERE e.source = q.target AND e.target = q.source AND e.edge_id = truth)) AS correct FROM q",
    "stmatch_delta": f"{SP}, d AS (SELECT traj_id, seq, event_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS eu, t - lag(t) OVER w AS dt FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) SELECT traj_id, seq, round(CASE WHEN event_id % 3 = 0 THEN eu * 6 ELSE 120 * dt END, 4)::DOUBLE AS delta FROM d WHERE seq > 0",
    "stmatch_distances": f"{REACH} SELECT traj_id, seq, edge_id_a, edge_id_b, {sql('CASE WHEN sp <= eu * 6 THEN sp ELSE -1 END')} AS sp FROM st",
    "stmatch_viterbi": f"{LATER} SELECT c.traj_id, c.seq, w.edge_id, {sql('w.ep')} AS ep, round(c.cumu + 3.7e-7::DOUBLE, 5) AS cumu FROM chosen c JOIN whole w USING (traj_id, seq, cand)",
    "bidirectional_paths": ROUTED,
    "goal_directed_paths": ROUTED,
    "complete_path": f"{BEST} SELECT traj_id, len(opath) AS points, len(cpath) AS edges, {LISTS} FROM whole_paths",
    "tpath": f"{BEST}, t AS (SELECT p.traj_id, p.seq, array_to_string(w.cpath[lag(p.place) OVER (PARTITION BY p.traj_id ORDER BY p.seq) + 1 : p.place + 1], ',') AS part FROM placed p JOIN whole_paths w USING (traj_id)) SELECT traj_id, string_agg(part, '|' ORDER BY seq) FILTER (seq > 0) AS tpath FROM t GROUP BY 1",
    "matched_geometry": f"""{BEST}, e AS (SELECT traj_id, unnest(cpath) AS edge_id, generate_subscripts(cpath, 1) - 1 AS no, len(cpath) AS n, first_offset, last_offset FROM whole_paths),
m AS (SELECT e.traj_id, e.no, x1 + s * (x2 - x1) AS xs, y1 + s * (y2 - y1) AS ys, x1 + t * (x2 - x1) AS xt, y1 + t * (y2 - y1) AS yt FROM (SELECT *, CASE WHEN no = 0 THEN first_offset ELSE 0 END AS s, CASE WHEN no = n - 1 THEN last_offset ELSE 1 END AS t FROM e) e JOIN edges USING (edge_id))
SELECT traj_id, 0::BIGINT AS place, {sql('xs')} AS x, {sql('ys')} AS y FROM m WHERE no = 0 UNION ALL SELECT traj_id, (no + 1)::BIGINT, {sql('xt')}, {sql('yt')} FROM m""",
    "match_rows_trajectory_mode": f"{SCORED}, k AS (SELECT traj_id, arg_max(cumu, seq) AS cumu, avg(trust) AS trust FROM scored GROUP BY 1) SELECT traj_id, {LISTS}, {sql('cumu')} AS cumu, {sql('trust')} AS trust FROM whole_paths JOIN k USING (traj_id)",
    "match_rows_point_mode": f"""{SCORED} SELECT p.traj_id, p.seq, {sql('p.x')} AS x, {sql('p.y')} AS y, coalesce(s.edge_id, -1) AS edge_id, s.edge_id IS NOT NULL AS matched, coalesce(w.cpath[s.place + 1], -1) AS cpath_edge,
{", ".join(f"{sql(f'coalesce(s.{chr(34)}{c}{chr(34)}, {missing})')} AS {chr(34)}{c}{chr(34)}" for c, missing in (("ep", -1), ("tp", -1), ("sp", -1), ("eu", -1), ("dist", -1), ("offset", -1), ("cumu", -999), ("trust", -999)))}
FROM points p LEFT JOIN scored s USING (traj_id, seq) LEFT JOIN whole_paths w ON w.traj_id = p.traj_id""",
    "lag_smoothing": f"{SMOOTH}, e AS (SELECT traj_id, seq, -sum(trust * log2(trust)) FILTER (trust > 0) AS entropy FROM smooth GROUP BY 1, 2) SELECT traj_id, seq, cand, edge_id, {sql('trust')} AS trust, {sql('entropy')} AS entropy FROM smooth JOIN e USING (traj_id, seq)",
    "composite_graph_edges": f"WITH {WHOLE}, c AS (SELECT * FROM whole), a AS (SELECT traj_id, seq, \"offset\" AS cost FROM c UNION ALL SELECT traj_id, seq, length - \"offset\" FROM c UNION ALL SELECT b.traj_id, b.seq, b.\"offset\" - a.\"offset\" FROM c a JOIN c b ON b.traj_id = a.traj_id AND b.seq = a.seq + 1 AND a.edge_id = b.edge_id AND b.\"offset\" >= a.\"offset\") SELECT traj_id, seq, count(*)::BIGINT AS n, {sql('sum(cost)')} AS cost FROM a GROUP BY 1, 2",
    "hex_cell_match": f"WITH {HEX_WAYS} SELECT traj_id, seq, step, q, r, floor((2 * (3 * q + r) + 7) / 14)::BIGINT AS parent_q, floor((2 * (2 * r - q) + 7) / 14)::BIGINT AS parent_r, (q + 268435456) * 536870912 + r + 268435456 AS number FROM way",
    "hex_level_counts": f"WITH {HEX_POINTS}, up1 AS (SELECT traj_id, {HEX_UP('q', 'r')} FROM at_cell), up2 AS (SELECT traj_id, {HEX_UP('q', 'r')} FROM up1) SELECT q, r, count(*) AS points, count(DISTINCT traj_id) AS trajectories FROM up2 GROUP BY 1, 2",
    "grid_cell_match": f"{SP}, c AS (SELECT traj_id, seq, floor(x)::BIGINT AS cx, floor(y)::BIGINT AS cy FROM points), d AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM c WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) SELECT traj_id, seq, cx, cy FROM d WHERE px IS NULL OR px <> cx OR py <> cy",
    "gap_segmentation": f"{P}, d AS (SELECT traj_id, seq, CASE WHEN abs(t - lag(t) OVER w) <= 20000 THEN 0 ELSE 1 END AS s FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY seq)), n AS (SELECT traj_id, seq, sum(s) OVER (PARTITION BY traj_id ORDER BY seq)::BIGINT AS run FROM d) SELECT traj_id, seq, run FROM n QUALIFY count(*) OVER (PARTITION BY traj_id, run) >= 3",
    "speed_split": f"{P}, d AS (SELECT traj_id, seq, lag(seq) OVER w IS NULL AS head, t - lag(t) OVER w AS dt, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS way FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) SELECT traj_id, seq, sum(CASE WHEN head OR dt <= 0 OR way / dt > 0.001 THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id ORDER BY seq)::BIGINT AS run FROM d",
    "continuity_jumps": f"{P}, d AS (SELECT traj_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) SELECT traj_id, count(*) FILTER (step > 1)::BIGINT AS jumps, {sql('sum(step)')} AS total, {sql('max(step)')} AS greatest FROM d GROUP BY 1",
    "cmm_cov_floor": f"{P}, c AS (SELECT event_id, sde - 0.055::DOUBLE AS e, sdn - 0.035::DOUBLE AS n, sdne AS c FROM points), k AS (SELECT *, CASE WHEN least(e, n) < 0.03 THEN 0.03::DOUBLE / least(e, n) ELSE 1 END AS k FROM c) SELECT event_id, {sql('CASE WHEN least(e, n) > 0 THEN e * k ELSE 0.03 END')} AS sde, {sql('CASE WHEN least(e, n) > 0 THEN n * k ELSE 0.03 END')} AS sdn, {sql('CASE WHEN least(e, n) > 0 THEN c * k * k ELSE 0 END')} AS sdne FROM k",
    "mahalanobis_projection": f"{P}, c AS (SELECT event_id, x, y, sdn * sdn / d AS a, sde * sde / d AS b, -sdne / d AS c FROM (SELECT *, sde * sde * sdn * sdn - sdne * sdne AS d FROM points)), u AS (SELECT *, greatest(0, least(1, (a * 4 * x + c * (4 * y + 2 * x) + b * 2 * y) / (a * 16 + 2 * c * 8 + b * 4))) AS u FROM c), e AS (SELECT *, x - 4 * u AS ex, y - 2 * u AS ey FROM u) SELECT event_id, round(a * ex * ex + 2 * c * ex * ey + b * ey * ey + 3.7e-5::DOUBLE, 3) AS metric, {sql('sqrt(ex * ex + ey * ey)')} AS dist, {sql('u * sqrt(20::DOUBLE)')} AS \"offset\" FROM e",
    "cmm_log_emission": f"{P}, c AS (SELECT sde * sde + 0.0004::DOUBLE AS a, sdn * sdn + 0.0004::DOUBLE AS b, sdne AS c, (event_id % 7) / 20::DOUBLE AS dy, event_id FROM points), d AS (SELECT *, a * b - c * c AS det FROM c) SELECT event_id, {sql('-0.5 * (ln(2 * pi()) + ln(det + 1e-12::DOUBLE) + (b * 0.01::DOUBLE - 2 * c * 0.1::DOUBLE * dy + a * dy * dy) / det)')} AS log_ep FROM d",
    "cmm_candidates": f"WITH {CMM} SELECT traj_id, seq, edge_id, cand, {sql('dist')} AS dist, {sql(chr(34) + 'offset' + chr(34))} AS \"offset\" FROM cmm",
    "cmm_forward": f"{FILTER}, e AS (SELECT traj_id, seq, -sum(trust * log2(trust)) AS entropy FROM post GROUP BY 1, 2) SELECT traj_id, seq, 0::BIGINT AS part, 'SUCCESS' AS status, cand, edge_id, {sql('cumu')} AS cumu, {sql('trust')} AS trust, {sql('entropy')} AS entropy FROM post JOIN e USING (traj_id, seq)",
    "background_state": f"WITH {CMM} SELECT traj_id, seq, edge_id, {sql('0.95 * ep')} AS ep FROM cmm UNION ALL SELECT DISTINCT traj_id, seq, -1, {sql('0.05')} FROM cmm",
    "phmi_emission_norm": f"WITH {CMM} SELECT traj_id, seq, edge_id, {sql('ep')} AS ep FROM cmm",
    "softmax_posterior": f"{FILTER} SELECT traj_id, seq, edge_id, {sql('trust')} AS p FROM post",
    "log_sum_exp": f"{FORWARD} SELECT traj_id, seq, {sql('ln(sum(f))')} AS lse FROM v GROUP BY 1, 2",
    "entropy_bits": f"{FILTER} SELECT traj_id, seq, {sql('-sum(trust * log2(trust))')} AS bits FROM post GROUP BY 1, 2",
    "top3_scores": f"{FILTER}, q AS (SELECT traj_id, seq, {sql('trust')} AS score FROM post), k AS (SELECT *, row_number() OVER (PARTITION BY traj_id, seq ORDER BY score DESC) - 1 AS place FROM q) SELECT traj_id, seq, place::BIGINT AS place, score FROM k WHERE place < 3",
}

QUERIES = {f.__name__: f for f in (
    spatial_candidate_join, knn_candidates, candidate_complete_trajectories, emission_prob, od_table, od_incremental, od_faults, od_path_unroll, od_source_index, partial_od_semi_join, shortest_path, bounded_sssp, bounded_reverse_sssp,
    edges_within_distance, od_lookup_join, transition_matrix, fmm_sp_dist, transition_prob, transition_row_norm, fmm_viterbi, fmm_trust, viterbi_opath, complete_path, tpath, matched_geometry,
    match_rows_point_mode, match_rows_trajectory_mode, match_summary, realign_original_indices, duration_speed, distinct_matched_edges, matched_edges_semi_join, edge_match_with_reverse, stmatch_delta,
    stmatch_distances, stmatch_viterbi, bidirectional_paths, goal_directed_paths, composite_graph_edges, grid_cell_match, hex_cell_match, hex_level_counts, gap_segmentation, speed_split, continuity_jumps, cmm_cov_floor, mahalanobis_projection, cmm_log_emission, cmm_candidates,
    cmm_forward, lag_smoothing, background_state, phmi_emission_norm, softmax_posterior, log_sum_exp, entropy_bits, top3_scores,
)}
