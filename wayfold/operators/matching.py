"""Hidden-Markov map matching.

Candidates, emissions, path lengths and transitions are tables (joins and windows); only the sequential
recursion runs in a fold over each trajectory's transition rows, in Arrow batches by trajectory. The fold
needs neither network nor path table, so nothing that grows with the data is sent to the tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.candidates import counted, nearest, spatial_candidates, whole_trajectories
from wayfold.operators.covariance import Ways
from wayfold.operators.routing import bounded_paths
from wayfold.operators.shared import by_trajectory, checkpointed, importable


@dataclass(frozen=True)
class MatchConfig:
    """Fixed defaults of the method: neighbours, search radius, standard deviation, share of an edge that may be run back."""

    k: int = 8
    radius: float = 300.0
    gps_error: float = 50.0
    reverse_tolerance: float = 0.0
    max_speed: float = 80.0
    factor: float = 1.5

    def __post_init__(self) -> None:
        if self.k <= 0 or self.radius <= 0 or self.gps_error <= 0 or not 0 <= self.reverse_tolerance <= 1:
            raise ValueError(f"no valid configuration: {self}")


def emission(dist: Column, sigma: float) -> Column:
    return F.exp(-0.5 * F.pow(dist / sigma, 2))


def transition(sp: Column, eu: Column) -> Column:
    """1 if the way is no longer than the straight line, else their ratio."""
    return F.when(eu >= sp, F.lit(1.0)).otherwise(eu / sp)


def found_layers(points: DataFrame, edges: DataFrame, config: MatchConfig) -> DataFrame:
    """Candidates of complete trajectories: k nearest within the radius, with emission ep and order cand."""
    found = nearest(spatial_candidates(counted(points.select("traj_id", "seq", "x", "y")), edges, config.radius), config.k)
    return whole_trajectories(found).withColumn("ep", emission(F.col("dist"), config.gps_error))


def layers(points: DataFrame, edges: DataFrame, config: MatchConfig) -> DataFrame:
    """found_layers, materialised once for several readings."""
    return checkpointed(found_layers(points, edges, config))


def stepped(cands: DataFrame) -> DataFrame:
    """Pairs of candidates of successive points: columns *_a and *_b, and eu, the points' distance."""
    a = cands.select("traj_id", (F.col("seq") + 1).alias("seq"), *(F.col(c).alias(f"{c}_a") for c in ("cand", "edge_id", "source", "target", "length", "offset", "x", "y")))
    b = cands.select("traj_id", "seq", *(F.col(c).alias(f"{c}_b") for c in ("cand", "edge_id", "source", "target", "length", "offset", "x", "y", "ep")))
    dx, dy = F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a")
    return a.join(b, ["traj_id", "seq"]).withColumn("eu", F.sqrt(dx * dx + dy * dy))


def path_lengths(pairs: DataFrame, od: DataFrame, reverse_tolerance: float) -> DataFrame:
    """Adds sp: along one edge, over a shared node, or through the OD table; infinite where there is no way."""
    ways = od.select(F.col("source").alias("target_a"), F.col("target").alias("source_b"), F.col("distance").alias("between"))
    rest = F.col("length_a") - F.col("offset_a")
    same = F.col("edge_id_a") == F.col("edge_id_b")
    sp = (
        F.when(same & (F.col("offset_a") <= F.col("offset_b")), F.col("offset_b") - F.col("offset_a"))
        .when(same & (F.col("offset_a") - F.col("offset_b") < F.col("length_a") * reverse_tolerance), F.lit(0.0))
        .when(F.col("target_a") == F.col("source_b"), rest + F.col("offset_b"))
        .when(F.col("between").isNotNull(), F.col("between") + rest + F.col("offset_b"))
        .otherwise(F.lit(float("inf")))
    )
    return pairs.join(ways, ["target_a", "source_b"], "left").withColumn("sp", sp).drop("between")


def transitions(cands: DataFrame, od: DataFrame, config: MatchConfig) -> DataFrame:
    out = path_lengths(stepped(cands), od, config.reverse_tolerance)
    return out.withColumn("tp", transition(F.col("sp"), F.col("eu")))


def _log_sum(v: np.ndarray) -> float:
    top = v.max(initial=-math.inf)
    return top if math.isinf(top) else top + math.log(np.exp(v - top).sum())


FOLD_SCHEMA = "traj_id long, seq long, cand int, prev int, ep double, tp double, sp double, eu double, cumu double, trust double, chosen boolean"


def fold(rows: pd.DataFrame, later_wins: bool = False, stop_when_cut: bool = True) -> pd.DataFrame:
    """Viterbi and forward recursion over one trajectory.

    rows: layer 0 has a null cand_a; others are transition rows. later_wins: among equal predecessors the last
    one counts, unreachable ones too. All candidates come back with their best predecessor; chosen marks the best path.
    """
    rows = rows.sort_values(["seq", "cand_b", "cand_a"], kind="stable")
    head = rows["cand_a"].isna().to_numpy()
    columns = {"seq": rows["seq"].to_numpy(), "cand_b": rows["cand_b"].to_numpy(), "head": head, "cand_a": rows["cand_a"].fillna(0).to_numpy().astype(np.int64)}
    columns |= {c: rows[c].to_numpy(np.float64) for c in ("tp", "sp", "eu", "ep_b")}
    done = recursion(columns, later_wins, stop_when_cut)
    return pd.DataFrame({"traj_id": np.full(len(done["seq"]), int(rows["traj_id"].iloc[0])), **done})


def recursion(columns: dict[str, np.ndarray], later_wins: bool = False, stop_when_cut: bool = True) -> dict[str, np.ndarray]:
    """fold, on columns sorted by seq, cand_b and cand_a; head marks the rows of layer 0."""
    seq, b, head, a, tp, sp, eu, ep = (columns[c] for c in ("seq", "cand_b", "head", "cand_a", "tp", "sp", "eu", "ep_b"))
    with np.errstate(divide="ignore"):
        log_tp, log_ep = np.log(tp), np.log(ep)
    group = np.flatnonzero(np.concatenate([[True], (seq[1:] != seq[:-1]) | (b[1:] != b[:-1])]))
    ends = np.concatenate([group[1:], [len(seq)]])
    layer = np.flatnonzero(np.concatenate([[True], seq[group][1:] != seq[group][:-1]]))
    n, top = len(group), int(b.max()) + 1
    prev, cumu, fwd, pick = np.full(n, -1), np.full(n, -np.inf), np.full(n, -np.inf), group.copy()
    trust = np.zeros(n)
    v, f = np.full(top, -np.inf), np.full(top, -np.inf)
    cut = False
    for lo, hi in zip(layer, np.concatenate([layer[1:], [n]]), strict=True):
        start, own_ep = head[group[lo]], log_ep[group[lo:hi]]
        if start:
            cumu[lo:hi] = fwd[lo:hi] = own_ep
        elif not cut:
            # a layer is one matrix: its candidates by those of the layer before
            i, j = group[lo], ends[hi - 1]
            to = np.repeat(np.arange(hi - lo), ends[lo:hi] - group[lo:hi])
            ways, row = np.full((hi - lo, top), -np.inf), np.zeros((hi - lo, top), np.int64)
            ways[to, a[i:j]], row[to, a[i:j]] = log_tp[i:j], np.arange(i, j)
            into = f + ways
            value = (v + ways) + own_ep[:, None]
            at = top - 1 - value[:, ::-1].argmax(1) if later_wins else value.argmax(1)
            best = value[np.arange(hi - lo), at]
            linked = best > -np.inf
            cumu[lo:hi][linked], prev[lo:hi][linked], pick[lo:hi][linked] = best[linked], at[linked], row[np.flatnonzero(linked), at[linked]]
            most = into.max(1)
            base = np.where(np.isinf(most), 0.0, most)
            with np.errstate(divide="ignore"):
                fwd[lo:hi] = base + np.log(np.exp(into - base[:, None]).sum(1)) + own_ep
        total = _log_sum(fwd[lo:hi])
        own = cumu[lo:hi]
        if later_wins:
            trust[lo:hi] = ep[group[lo:hi]] * tp[pick[lo:hi]]
        elif np.isfinite(total):
            trust[lo:hi] = np.where(own - total > -745, np.exp(np.minimum(own - total, 0)), 0.0)
        cut = cut or (stop_when_cut and not start and not (own > -np.inf).any())
        v, f = np.full(top, -np.inf), np.full(top, -np.inf)
        v[b[group[lo:hi]]], f[b[group[lo:hi]]] = own, fwd[lo:hi]
    chosen = np.zeros(n, bool)
    lo, hi = int(layer[-1]), n
    if (cumu[lo:hi] > -np.inf).any():
        g = lo + int(np.argmax(cumu[lo:hi]))
        for k in range(len(layer) - 1, -1, -1):
            chosen[g] = True
            if k:
                g = int(layer[k - 1]) + int(np.searchsorted(b[group[layer[k - 1] : layer[k]]], prev[g]))
    started = prev < 0
    return {
        "seq": seq[group], "cand": b[group], "prev": prev, "ep": ep[group], "tp": np.where(started, 0.0, tp[pick]),
        "sp": np.where(started, 0.0, sp[pick]), "eu": np.where(started, 0.0, eu[pick]), "cumu": cumu, "trust": trust, "chosen": chosen,
    }


def folded(cands: DataFrame, steps: DataFrame, later_wins: bool = False, stop_when_cut: bool = True) -> DataFrame:
    """Runs the fold on every trajectory; adds the candidates' columns back."""
    first = cands.join(cands.groupBy("traj_id").agg(F.min("seq").alias("seq")), ["traj_id", "seq"], "left_semi")
    heads = first.select("traj_id", "seq", F.lit(None).cast("int").alias("cand_a"), F.col("cand").alias("cand_b"), F.col("ep").alias("ep_b"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("sp"), F.lit(0.0).alias("eu"))
    rows = heads.unionByName(steps.select("traj_id", "seq", "cand_a", "cand_b", "ep_b", "tp", "sp", "eu"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return fold(frame, later_wins, stop_when_cut)

    done = importable(by_trajectory(rows)).groupBy("traj_id").applyInPandas(run, FOLD_SCHEMA)
    return done.join(cands.drop("ep"), ["traj_id", "seq", "cand"])


#: Columns that the fold adds to a candidate's.
FOLDED = "prev int, tp double, sp double, eu double, cumu double, trust double, chosen boolean"


def transition_rows(rows: pd.DataFrame, ways: Ways, reverse_tolerance: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The recursion's columns of one trajectory's candidates, sorted by seq and cand: what path_lengths and transition
    give for all steps; and which candidates they lead to."""
    seq, n = rows["seq"].to_numpy(), len(rows)
    starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    before = np.concatenate([[0], np.where(seq[starts[1:]] == seq[starts[:-1]] + 1, sizes[:-1], 0)])
    many = np.repeat(before, sizes)
    b = np.repeat(np.arange(n), many)
    a = np.repeat(np.repeat(np.concatenate([[0], starts[:-1]]), sizes), many) + np.arange(len(b)) - np.repeat(np.cumsum(many) - many, many)
    col = {c: rows[c].to_numpy() for c in ("edge_id", "source", "target", "length", "offset", "x", "y", "cand", "ep")}
    between = ways.between(col["target"][a], col["source"][b])
    back, rest = col["offset"][a] - col["offset"][b], col["length"][a] - col["offset"][a]
    same = col["edge_id"][a] == col["edge_id"][b]
    choices = [
        (same & (back <= 0), col["offset"][b] - col["offset"][a]), (same & (back < col["length"][a] * reverse_tolerance), 0.0),
        (col["target"][a] == col["source"][b], rest + col["offset"][b]), (between >= 0, between + rest + col["offset"][b]),
    ]
    sp = np.select([c for c, _ in choices], [v for _, v in choices], np.inf)
    dx, dy = col["x"][b] - col["x"][a], col["y"][b] - col["y"][a]
    eu = np.sqrt(dx * dx + dy * dy)
    with np.errstate(divide="ignore", invalid="ignore"):
        tp = np.where(eu >= sp, 1.0, eu / sp)
    first = np.arange(sizes[0])
    nothing = np.zeros(len(first))
    out = {"seq": np.concatenate([seq[first], seq[b]]), "cand_b": np.concatenate([col["cand"][first], col["cand"][b]]), "cand_a": np.concatenate([nothing.astype(np.int64), col["cand"][a]])}
    out |= {"head": np.concatenate([nothing == 0, np.zeros(len(b), bool)]), "ep_b": np.concatenate([col["ep"][first], col["ep"][b]])}
    out |= {c: np.concatenate([nothing, v]) for c, v in (("tp", tp), ("sp", sp), ("eu", eu))}
    return out, (many > 0) | (np.arange(n) < sizes[0])


def folded_over(cands: DataFrame, od: DataFrame, reverse_tolerance: float) -> DataFrame:
    """folded, over transitions that are formed within each trajectory's fold.

    Only the candidates themselves and the ways that a trajectory asks for, each once, go to the folds. The candidates
    are read twice; where they come as a plan, both readings share the exchange by trajectory.
    """
    names = [*(c for c in cands.columns if c != "ep"), "ep", *(f.split()[0] for f in FOLDED.split(", "))]
    ends = cands.groupBy("traj_id", "seq").agg(F.collect_set("target").alias("leave"), F.collect_set("source").alias("enter"))
    w = Window.partitionBy("traj_id").orderBy("seq")
    pairs = ends.withColumn("before", F.lag("leave").over(w))
    asked = pairs.select("traj_id", F.explode("before").alias("source"), "enter").select("traj_id", "source", F.explode("enter").alias("target")).filter("source <> target").distinct()
    needed = asked.join(od.select("source", "target", "distance"), ["source", "target"]).select(F.col("traj_id").alias("of"), "source", "target", "distance")

    def run(rows: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=names)
        rows = rows.iloc[np.lexsort((rows["cand"].to_numpy(), rows["seq"].to_numpy()))]
        known = Ways(ways["source"].to_numpy(np.int64), ways["target"].to_numpy(np.int64), ways["distance"].to_numpy(np.float64))
        steps, led = transition_rows(rows, known, reverse_tolerance)
        done = recursion(steps)
        return pd.DataFrame({c: rows[c].to_numpy()[led] if c in rows else done[c] for c in names})

    types = {f.name: f.dataType.simpleString() for f in cands.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cands.columns if c != "ep"), "ep double", FOLDED])
    return importable(by_trajectory(cands)).groupBy("traj_id").cogroup(by_trajectory(needed, "of").groupBy("of")).applyInPandas(run, schema)


def fast_match(points: DataFrame, edges: DataFrame, od: DataFrame, config: MatchConfig) -> DataFrame:
    """All candidates of all points with cumu, trust and chosen: matching over a precomputed OD table."""
    return folded_over(found_layers(points, edges, config), od, config.reverse_tolerance)


def search_limit(eu: Column, dt: Column, config: MatchConfig) -> Column:
    """How far the way between two points is searched: by the time between them, or by their distance without times."""
    return F.when(dt.isNull(), eu * config.factor * 4).otherwise(config.factor * config.max_speed * dt)


def limited_steps(cands: DataFrame, points: DataFrame, edges: DataFrame, config: MatchConfig) -> DataFrame:
    """Pairs of candidates of successive points with sp, which is null where no way is within the step's own limit.

    The network is searched once from each node that a candidate leads to, no farther than the longest way that any
    step allows from there, and only until the nodes are settled that the steps from there ask for.
    """
    times = points.select("traj_id", "seq", "t") if "t" in points.columns else points.select("traj_id", "seq", F.lit(None).cast("double").alias("t"))
    before = times.select("traj_id", (F.col("seq") + 1).alias("seq"), F.col("t").alias("t_a"))
    steps = stepped(cands).join(times, ["traj_id", "seq"]).join(before, ["traj_id", "seq"])
    steps = checkpointed(steps.withColumn("limit", search_limit(F.col("eu"), F.col("t") - F.col("t_a"), config)).drop("t", "t_a"))
    ahead = (F.col("edge_id_a") == F.col("edge_id_b")) & (F.col("offset_a") <= F.col("offset_b"))
    asked = steps.filter(~ahead & (F.col("target_a") != F.col("source_b"))).select(
        F.col("target_a").alias("source"), F.col("source_b").alias("target"), (F.col("limit") - (F.col("length_a") - F.col("offset_a")) - F.col("offset_b")).alias("limit")
    )
    asked = checkpointed(asked.groupBy("source", "target").agg(F.max("limit").alias("limit")).filter("limit >= 0"))
    # a little farther, as sums of lengths round differently from one end and the other
    sources = asked.groupBy("source").agg((F.max("limit") * (1 + 1e-9) + 1e-9).alias("limit"))
    ways = bounded_paths(edges, sources, targets=asked, paths=False)
    steps = path_lengths(steps, ways, config.reverse_tolerance)
    return steps.withColumn("sp", F.when(F.col("sp") <= F.col("limit"), F.col("sp")))


def st_match(points: DataFrame, edges: DataFrame, config: MatchConfig) -> DataFrame:
    """Matching without a precomputed table: ways within each step's own limit, ties to the later candidate.

    Pairs without a way get the smallest positive probability, so a trajectory never breaks.
    """
    return st_folded(layers(points, edges, config), points, edges, config)


def st_folded(cands: DataFrame, points: DataFrame, edges: DataFrame, config: MatchConfig) -> DataFrame:
    """st_match on candidates that are already there (as `layers` makes them)."""
    sp = F.coalesce("sp", F.lit(1.7976931348623157e308))
    steps = limited_steps(cands, points, edges, config).withColumn("sp", sp).withColumn("tp", transition(F.col("sp"), F.col("eu")))
    return folded(cands, steps, later_wins=True, stop_when_cut=False)


def composite_edges(cands: DataFrame, reverse_tolerance: float = 0.0) -> DataFrame:
    """Virtual edges (traj_id, seq, from_node, to_node, cost) that tie candidates into the network.

    Node names: n<id> for network nodes, c<seq>_<cand> for candidates. A candidate is entered from its edge's
    source and left to its target; candidates of successive points on one edge are tied directly.
    """
    name = F.concat(F.lit("c"), F.col("seq").cast("string"), F.lit("_"), F.col("cand").cast("string"))
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    into = cands.select("traj_id", "seq", node("source").alias("from_node"), name.alias("to_node"), F.col("offset").alias("cost"))
    out = cands.select("traj_id", "seq", name.alias("from_node"), node("target").alias("to_node"), (F.col("length") - F.col("offset")).alias("cost"))
    pairs = stepped(cands).filter("edge_id_a = edge_id_b")
    ahead = F.col("offset_b") - F.col("offset_a")
    cost = F.when(ahead >= 0, ahead).when(-ahead < F.col("length_a") * reverse_tolerance, F.lit(0.0))
    tied = pairs.withColumn("cost", cost).filter("cost IS NOT NULL")
    named = lambda s, c: F.concat(F.lit("c"), s.cast("string"), F.lit("_"), F.col(c).cast("string"))
    return into.unionByName(out).unionByName(tied.select("traj_id", "seq", named(F.col("seq") - 1, "cand_a").alias("from_node"), named(F.col("seq"), "cand_b").alias("to_node"), "cost"))
