"""Covariance-aware matching: Mahalanobis candidates, integrity-conditioned emissions, and the forward filter.

Candidates and emissions are tables; the sequential part (splits, skips, the Viterbi and forward recursions,
fixed-lag smoothing) is a fold over one trajectory, cogrouped with just the path rows that it may need.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geodesy as D
from wayfold.functions import geometry as G
from wayfold.operators.candidates import edge_segments, projected
from wayfold.operators.shared import by_trajectory, checkpointed, importable

POINT = ("traj_id", "seq")


@dataclass(frozen=True)
class CovarianceConfig:
    """Fixed defaults of the method."""

    k: int = 8
    min_candidates: int = 3
    level_multiplier: float = 1.0
    min_sigma: float = 5e-5
    map_sigma: float = 5e-5
    phmi: float = 1e-5
    phmi_multiplier: float = 1.0
    background: float = 0.0
    reverse_tolerance: float = 0.0
    max_interval: float = 180.0
    max_speed: float = 40.0
    bridge_gaps: bool = True
    lag_steps: int = 0
    cumulative_reverse: float = 0.03


def floored(sde: Column, sdn: Column, sdne: Column, least: float) -> Column:
    """(sde, sdn, sdne) scaled so that the smaller deviation reaches `least`; without positive ones, an isotropic floor."""
    low = F.least(sde, sdn)
    scale = F.when(low < least, least / low).otherwise(F.lit(1.0))
    good = low > 0
    return F.struct(
        F.when(good, sde * scale).otherwise(F.lit(least)).alias("sde"),
        F.when(good, sdn * scale).otherwise(F.lit(least)).alias("sdn"),
        F.when(good, sdne * scale * scale).otherwise(F.lit(0.0)).alias("sdne"),
    )


def variable_radius_segments(points: DataFrame, edges: DataFrame, radius: str, cell: float) -> DataFrame:
    """points x segments of edges whose boxes lie within each point's own radius; both sides list the grid cells they touch.

    The rows are dealt out by trajectory, so that what is worked out of them needs no other shuffle.
    """
    index = lambda v: F.floor(v / cell).cast("long")
    tiles = edge_segments(edges).withColumns({"sx": index(F.least("ax", "bx")), "sy": index(F.least("ay", "by")), "tx": index(F.greatest("ax", "bx")), "ty": index(F.greatest("ay", "by"))})
    tiles = tiles.withColumn("cx", F.explode(F.sequence("sx", "tx"))).withColumn("cy", F.explode(F.sequence("sy", "ty")))
    r = F.col(radius)
    at = points.withColumn("px", index(F.col("x") - r)).withColumn("py", index(F.col("y") - r))
    at = at.withColumn("cx", F.explode(F.sequence("px", index(F.col("x") + r)))).withColumn("cy", F.explode(F.sequence("py", index(F.col("y") + r))))
    # a pair counts in the first cell that both touch, so none comes twice
    met = at.join(tiles, ["cx", "cy"]).filter((F.col("cx") == F.greatest("px", "sx")) & (F.col("cy") == F.greatest("py", "sy")))
    return by_trajectory(met.drop("cx", "cy", "px", "py", "sx", "sy", "tx", "ty"))


def weighed(rows: DataFrame) -> DataFrame:
    """Adds of each row's segment the point nearest in Mahalanobis distance: m_metric, m_dist, m_offset, m_dx, m_dy."""
    d = rows.withColumns({"see": F.col("sde") * F.col("sde"), "snn": F.col("sdn") * F.col("sdn")}).withColumn("det", F.col("see") * F.col("snn") - F.col("sdne") * F.col("sdne"))
    d = d.withColumns({"wa": F.col("snn") / F.col("det"), "wb": F.col("see") / F.col("det"), "wc": -F.col("sdne") / F.col("det")})
    d = d.withColumns({"ux": F.col("bx") - F.col("ax"), "uy": F.col("by") - F.col("ay"), "vx": F.col("x") - F.col("ax"), "vy": F.col("y") - F.col("ay")})
    u, v = (F.col("ux"), F.col("uy")), (F.col("vx"), F.col("vy"))
    dot = lambda p, q: F.col("wa") * p[0] * q[0] + F.col("wc") * (p[0] * q[1] + p[1] * q[0]) + F.col("wb") * p[1] * q[1]
    d = d.withColumns({"scale": dot(u, u), "plain": u[0] * u[0] + u[1] * u[1]})
    share = F.when(F.abs("scale") >= 1e-12, dot(u, v) / F.col("scale")).when(F.col("plain") > 0, (u[0] * v[0] + u[1] * v[1]) / F.col("plain")).otherwise(F.lit(0.0))
    d = d.withColumn("share", F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))
    d = d.withColumns({"m_dx": F.col("x") - F.col("ax") - F.col("share") * u[0], "m_dy": F.col("y") - F.col("ay") - F.col("share") * u[1]})
    e = (F.col("m_dx"), F.col("m_dy"))
    d = d.withColumns({"m_metric": dot(e, e), "m_dist": F.sqrt(e[0] * e[0] + e[1] * e[1]), "m_offset": F.col("start") + F.col("share") * F.sqrt("plain")})
    return d.drop("det", "wa", "wb", "wc", "ux", "uy", "vx", "vy", "scale", "plain", "share")


def anisotropic(line: Column, x: Column, y: Column, see: Column, snn: Column, sen: Column) -> Column:
    """(metric, dist, offset) of the point of a line that is nearest in Mahalanobis distance; the first segment wins ties."""
    det = see * snn - sen * sen
    a, b, c = snn / det, see / det, -sen / det
    start = F.struct(F.lit(float("inf")).alias("metric"), F.lit(0.0).alias("dist"), F.lit(0.0).alias("offset"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("passed"))

    def foot(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        px, py = x - s["a"]["x"], y - s["a"]["y"]
        scale = a * dx * dx + 2 * c * dx * dy + b * dy * dy
        plain = dx * dx + dy * dy
        share = F.when(F.abs(scale) >= 1e-12, (a * dx * px + c * (dx * py + dy * px) + b * dy * py) / scale).when(plain > 0, (dx * px + dy * py) / plain).otherwise(F.lit(0.0))
        return F.struct(s.alias("s"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)).alias("share"))

    def rest(f: Column) -> Column:
        s = f["s"]
        ex = x - s["a"]["x"] - f["share"] * (s["b"]["x"] - s["a"]["x"])
        ey = y - s["a"]["y"] - f["share"] * (s["b"]["y"] - s["a"]["y"])
        return F.struct(ex.alias("dx"), ey.alias("dy"), (f["share"] * s["length"]).alias("own"), s["length"].alias("length"))

    def weighed(e: Column) -> Column:
        metric = a * e["dx"] * e["dx"] + 2 * c * e["dx"] * e["dy"] + b * e["dy"] * e["dy"]
        return F.struct(metric.alias("metric"), F.sqrt(e["dx"] * e["dx"] + e["dy"] * e["dy"]).alias("dist"), e["dx"].alias("dx"), e["dy"].alias("dy"), e["own"].alias("own"), e["length"].alias("length"))

    def step(best: Column, e: Column) -> Column:
        better = e["metric"] < best["metric"]
        take = lambda new, old: F.when(better, new).otherwise(best[old]).alias(old)
        return F.struct(take(e["metric"], "metric"), take(e["dist"], "dist"), take(best["passed"] + e["own"], "offset"), take(e["dx"], "dx"), take(e["dy"], "dy"), (best["passed"] + e["length"]).alias("passed"))

    feet = F.transform(F.transform(F.transform(G.segments(line), foot), rest), weighed)
    return F.aggregate(feet, start, step, lambda v: F.struct(v["metric"].alias("metric"), v["dist"].alias("dist"), v["offset"].alias("offset"), v["dx"].alias("dx"), v["dy"].alias("dy")))


def covariance_candidates(points: DataFrame, edges: DataFrame, config: CovarianceConfig, cell: float) -> DataFrame:
    """The best candidates of each point: per edge the projection or an end point, whichever is nearest in Mahalanobis distance.

    points: traj_id, seq, t, x, y, sde, sdn, sdne, pl. Points with too few edges are searched once more at twice the radius.
    """
    cov = floored(F.col("sde"), F.col("sdn"), F.col("sdne"), config.min_sigma)
    p = points.withColumn("cov", cov).withColumns({"sde": F.col("cov.sde"), "sdn": F.col("cov.sdn"), "sdne": F.col("cov.sdne")}).drop("cov").withColumn("radius", F.col("pl") * config.level_multiplier)

    edge = [c for c in ("source", "target", "length", "oneway") if c in edges.columns]

    def found(rows: DataFrame) -> DataFrame:
        met = projected(variable_radius_segments(rows, edges, "radius", cell)).filter(F.col("dist") <= F.col("radius"))
        near = met.groupBy(*POINT, "edge_id").agg(F.first(F.struct(*rows.columns)).alias("row"), F.min("dist").alias("near_dist"))
        by_distance = Window.partitionBy(*POINT).orderBy("near_dist", "edge_id")
        near = near.withColumn("rank", F.row_number().over(by_distance)).filter(F.col("rank") <= config.k).select("edge_id", "row.*")
        # the point of least metric may lie on any segment of these edges, so all of them come back (first segment on ties)
        all_of = weighed(near.join(edge_segments(edges), "edge_id")).groupBy(*POINT, "edge_id")
        near = all_of.agg(
            F.first(F.struct(*rows.columns, *edge)).alias("row"), F.min(F.struct("m_metric", "no", "m_dist", "m_offset", "m_dx", "m_dy")).alias("m"), F.min(F.struct("no", "ax", "ay")).alias("first_end"), F.max(F.struct("no", "bx", "by")).alias("last_end")
        )
        near = near.select(*POINT, "edge_id", *(F.col(f"row.{c}").alias(c) for c in [*rows.columns, *edge] if c not in POINT), "m", "first_end", "last_end")
        see, snn, sen = F.col("sde") * F.col("sde"), F.col("sdn") * F.col("sdn"), F.col("sdne")

        def end(px: Column, py: Column, offset: Column) -> Column:
            dx, dy = F.col("x") - px, F.col("y") - py
            return F.struct(D.mahalanobis_squared(dx, dy, see, snn, sen).alias("metric"), G.distance(F.col("x"), F.col("y"), px, py).alias("dist"), offset.alias("offset"), dx.alias("dx"), dy.alias("dy"))

        own = F.struct(F.col("m.m_metric").alias("metric"), F.col("m.m_dist").alias("dist"), F.col("m.m_offset").alias("offset"), F.col("m.m_dx").alias("dx"), F.col("m.m_dy").alias("dy"))
        near = near.withColumns({"own": own, "head": end(F.col("first_end.ax"), F.col("first_end.ay"), F.lit(0.0)), "tail": end(F.col("last_end.bx"), F.col("last_end.by"), F.col("length"))})
        inside = lambda c: F.when(F.col(f"{c}.dist") <= F.col("radius"), F.col(c))
        near = near.withColumn("best", F.least("own", inside("head"), inside("tail")))
        return near.select(*rows.columns, "edge_id", *edge, "best.*")

    once = checkpointed(found(p))
    few = once.groupBy(*POINT).agg(F.count("*").alias("n")).filter(F.col("n") < config.min_candidates).select(*POINT)
    wider = found(p.join(few, list(POINT), "left_semi").withColumn("radius", 2 * F.col("radius")))
    both = once.join(few, list(POINT), "left_anti").unionByName(wider)
    order = Window.partitionBy(*POINT).orderBy("metric", "edge_id")
    return both.withColumn("cand", F.row_number().over(order)).filter(F.col("cand") <= max(config.k, config.min_candidates))


def log_emission(dx2: Column, see: Column, snn: Column, sen: Column) -> Column:
    """Log density at squared Mahalanobis distance dx2; minus infinity for a degenerate covariance."""
    det = see * snn - sen * sen
    value = -0.5 * (math.log(2 * math.pi) + F.log(det + 1e-12) + dx2)
    return F.when(det <= 1e-30, F.lit(float("-inf"))).otherwise(value)


def emissions(cands: DataFrame, config: CovarianceConfig) -> DataFrame:
    """Adds ep: densities under the covariance plus map error, normalised so that the candidates within the
    protection level share 1 - phmi and the others phmi; times 1 - background if there is a background state."""
    m = config.map_sigma**2
    see, snn, sen = F.col("sde") * F.col("sde") + m, F.col("sdn") * F.col("sdn") + m, F.col("sdne")
    log_ep = log_emission(D.mahalanobis_squared(F.col("dx"), F.col("dy"), see, snn, sen), see, snn, sen)
    d = cands.withColumn("density", F.greatest(F.exp(log_ep), F.lit(2.2250738585072014e-308)))
    inside = F.lit(True) if config.phmi <= 0 else F.col("dist") <= F.col("pl") * config.phmi_multiplier
    share = F.lit(1.0) if config.phmi <= 0 else F.when(F.col("inside"), F.lit(1 - config.phmi)).otherwise(F.lit(config.phmi))
    total = F.sum("density").over(Window.partitionBy(*POINT, "inside"))
    return d.withColumn("inside", inside).withColumn("ep", share * F.col("density") / total * (1 - config.background))


def with_background(cands: DataFrame, config: CovarianceConfig) -> DataFrame:
    """Adds to each point a state without a road, of probability `background`."""
    if not 0 < config.background < 1:
        return cands
    keep = [*POINT, "t", "x", "y"]
    last = cands.groupBy(*keep).agg((F.max("cand") + 1).alias("cand"))
    return cands.unionByName(last.withColumn("ep", F.lit(config.background)), allowMissingColumns=True)


OUT = "traj_id long, seq long, part int, status string, cand int, edge_id long, ep double, tp double, sp double, eu double, cumu double, trust double, entropy double, entropy_drop double, chosen boolean"


def _lse(v: np.ndarray) -> float:
    top = v.max(initial=-math.inf)
    return top if math.isinf(top) else top + math.log(np.exp(v - top).sum())


def _softmax(v: np.ndarray) -> np.ndarray:
    total = _lse(v)
    return np.exp(v - total) if math.isfinite(total) else np.zeros(len(v))


def _bits(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) + 0.0


#: How far a candidate may lie behind the one before on its edge, as a share of the edge (fixed values of the method).
BACK_SHARE, BACK_SLACK = 0.15, 1e-7


class Ways:
    """Lengths of ways between nodes, looked up for whole matrices of pairs."""

    def __init__(self, source: np.ndarray, target: np.ndarray, distance: np.ndarray):
        self.nodes = np.unique(np.concatenate([source, target]).astype(np.int64))
        key = self._key(source, target)
        order = np.argsort(key, kind="stable")
        self.key, self.distance = key[order], np.asarray(distance, np.float64)[order]

    @staticmethod
    def of(pairs: dict[tuple[int, int], float]) -> Ways:
        nodes = np.array(list(pairs), np.int64).reshape(-1, 2)
        return Ways(nodes[:, 0], nodes[:, 1], np.array(list(pairs.values()), np.float64))

    def _key(self, source: np.ndarray, target: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.nodes, source) * (len(self.nodes) + 1) + np.searchsorted(self.nodes, target)

    def between(self, source: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Distances of pairs (arrays of one shape); -1 where there is no way."""
        if not len(self.key):
            return np.full(np.shape(source), -1.0)
        known = lambda v: self.nodes[np.minimum(np.searchsorted(self.nodes, v), len(self.nodes) - 1)] == v
        key = self._key(source, target)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & known(source) & known(target), self.distance[at], -1.0)


class Layer:
    """Candidates of one point, and the recursion's values on them."""

    def __init__(self, seq: int, t: float, x: float, y: float, columns: dict[str, np.ndarray]):
        self.seq, self.t, self.x, self.y = seq, t, x, y
        self.cand, self.edge, self.source, self.target = (columns[c] for c in ("cand", "edge_id", "source", "target"))
        self.length, self.offset, self.ep, self.oneway = (columns[c] for c in ("length", "offset", "ep", "oneway"))
        with np.errstate(divide="ignore"):
            self.log_ep = np.log(self.ep)
        self.ready = None
        self.unlinked()

    def unlinked(self) -> None:
        n = len(self.cand)
        self.prev, self.tp, self.sp, self.eu = np.full(n, -1), np.zeros(n), np.zeros(n), 0.0
        self.reverse, self.spread = np.zeros(n), None

    def begin(self) -> None:
        states = max(1, int(np.isfinite(self.log_ep).sum()))
        self.v = self.f = self.log_ep - math.log(states)
        self.trust, prior = _softmax(self.f), math.log2(len(self.cand))
        self.entropy = _bits(self.trust)
        self.drop = max(0.0, prior - self.entropy)
        self.tp = np.ones(len(self.cand))

    def ways(self, other: Layer, od: Ways, config: CovarianceConfig) -> np.ndarray:
        """Lengths of the ways from this layer's candidates (rows) to the other's; -1 where there is none.

        Also keeps in other.reverse_to how far each pair has run back on its edge in all. On a one-way edge a pair
        that ran back more than cumulative_reverse of it has no way.
        """
        ready = other.ready is not None and other.ready[0] is self
        out, back, run_back = other.ready[1:4] if ready else _between((self,), (other,), od, config, 0)
        other.reverse_to = np.where(run_back, self.reverse[:, None] + back, 0.0)
        far = run_back & self.oneway[:, None] & (other.reverse_to > config.cumulative_reverse * self.length[:, None])
        return np.where(far, -1.0, out) if far.any() else out

    def follow(self, before: Layer, od: Ways, config: CovarianceConfig) -> bool:
        """The recursion from the layer before; false if no candidate can be reached."""
        self.eu = math.dist((before.x, before.y), (self.x, self.y))
        if self.ready is not None and self.ready[0] is before and self.ready[4]:
            sp, (raw, self.log_raw, log_a) = self.ready[1], self.ready[4]
            self.reverse_to = None
        else:
            sp = before.ways(self, od, config)
            raw, self.log_raw, log_a = _transitions(sp, self.eu)
        value, into = before.v[:, None] + log_a, before.f[:, None] + log_a
        self.prev = value.argmax(0)
        best, top = value.max(0), into.max(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.where(np.isinf(top), top, top + np.log(np.exp(into - np.where(np.isinf(top), 0.0, top)).sum(0)))
        self.v, self.f, self.spread = best + self.log_ep, spread + self.log_ep, spread
        at, linked = (self.prev, np.arange(len(self.cand))), np.isfinite(best)
        self.tp, self.sp = np.where(linked, raw[at], 0.0), np.where(linked, sp[at], -1.0)
        self.reverse = np.zeros(len(self.cand)) if self.reverse_to is None else np.where(linked, self.reverse_to[at], 0.0)
        self.ready = None
        return bool((self.f > -np.inf).any())


def _between(before: Sequence[Layer], after: Sequence[Layer], od: Ways, config: CovarianceConfig, which=slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of ways, how far they lead back on their edge, and whether they run back, for pairs of layers of one shape."""
    a = {c: np.stack([getattr(x, c) for x in before])[which][..., :, None] for c in ("edge", "source", "target", "length", "offset")}
    b = {c: np.stack([getattr(x, c) for x in after])[which][..., None, :] for c in ("edge", "source", "offset")}
    rest, reach = a["length"] - a["offset"], b["offset"]
    back = a["offset"] - reach
    same = a["edge"] == b["edge"]
    between = od.between(*np.broadcast_arrays(a["target"], b["source"]))
    around = np.where(od.between(a["target"], a["source"]) >= 0, back, -1.0)
    near = back <= np.maximum(BACK_SHARE * a["length"], a["length"] * config.reverse_tolerance + BACK_SLACK)
    on_edge = np.where(back <= 0, -back, np.where(near, 0.0, around))
    over_node = np.where(a["target"] == b["source"], rest + reach, np.where(between >= 0, between + rest + reach, -1.0))
    out = np.where(same, on_edge, over_node)
    out[(a["edge"] < 0) | (b["edge"] < 0)] = -1.0
    return out, back, same & (back > 0) & (out >= 0)


def _transitions(sp: np.ndarray, eu) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw transitions, their logarithms, and those of the transitions normalised by row."""
    with np.errstate(divide="ignore", invalid="ignore"):
        raw = np.where(sp < 0, 0.0, np.where(eu >= sp, 1.0, eu / sp))
        total = raw.sum(-1, keepdims=True)
        return raw, np.log(raw), np.log(np.where(total > 0, raw / total, 0.0))


#: Steps whose ways are worked out together.
AHEAD = 4096


def prepared(layers: list[Layer], od: Ways, config: CovarianceConfig, guarded: bool) -> None:
    """Works out the ways between successive layers, all steps of one shape at once, and their transitions unless one-way edges guard them."""
    shapes: dict[tuple[int, int], list[tuple[Layer, Layer]]] = {}
    for a, b in zip(layers, layers[1:], strict=False):
        shapes.setdefault((len(a.cand), len(b.cand)), []).append((a, b))
    for steps in shapes.values():
        out, back, run_back = _between([a for a, _ in steps], [b for _, b in steps], od, config)
        eu = np.array([math.dist((a.x, a.y), (b.x, b.y)) for a, b in steps])
        made = None if guarded else _transitions(out, eu[:, None, None])
        for i, (a, b) in enumerate(steps):
            b.ready = (a, out[i], back[i], run_back[i], made and tuple(m[i] for m in made))


def _softmaxes(v: np.ndarray) -> np.ndarray:
    """_softmax by row."""
    top = v.max(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        total = top + np.log(np.exp(v - top).sum(1, keepdims=True))
        return np.where(np.isinf(top), 0.0, np.exp(v - total))


def _all_bits(p: np.ndarray) -> np.ndarray:
    """_bits by row."""
    return -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1.0)), 0.0).sum(1) + 0.0


def settled(layers: list[Layer]) -> None:
    """Trust, entropy and its drop of the layers that follow another, all of one size at once."""
    sizes: dict[int, list[Layer]] = {}
    for layer in layers:
        if layer.spread is not None:
            sizes.setdefault(len(layer.cand), []).append(layer)
    for own in sizes.values():
        trust, before = _softmaxes(np.stack([x.f for x in own])), _softmaxes(np.stack([x.spread for x in own]))
        entropy = _all_bits(trust)
        drop = np.maximum(0.0, _all_bits(before) - entropy)
        for i, x in enumerate(own):
            x.trust, x.entropy, x.drop = trust[i], float(entropy[i]), float(drop[i])


def smoothed(layers: list[Layer], lag: int) -> None:
    """Trust and entropy of each layer with the next `lag` layers known; the last layer keeps its filter value."""
    for i, layer in enumerate(layers[:-1]):
        ahead = layers[i + 1 : i + 1 + lag]
        best = np.zeros(len(ahead[-1].cand)) if ahead else None
        for nxt in reversed(ahead):
            best = (nxt.log_raw + (nxt.log_ep + best)[None, :]).max(1)
        if best is not None:
            score = layer.v + best
            layer.trust = _softmax(score)
            layer.entropy = _bits(layer.trust)
            layer.drop = max(0.0, math.log2(max(1, int(np.isfinite(score).sum()))) - layer.entropy)


def layers_of(rows: pd.DataFrame) -> list[Layer]:
    """The layers of one trajectory's candidate rows, by seq; its columns are taken apart once."""
    rows = rows.sort_values(["seq", "cand"], kind="stable")
    whole = {c: rows[c].fillna(-1).to_numpy(np.int64) for c in ("edge_id", "source", "target")} | {c: rows[c].fillna(0).to_numpy(np.float64) for c in ("length", "offset")}
    whole |= {"cand": rows["cand"].to_numpy(), "ep": rows["ep"].to_numpy(np.float64)}
    whole["oneway"] = rows["oneway"].eq(True).to_numpy(bool) if "oneway" in rows else np.zeros(len(rows), bool)
    seq, t, x, y = (rows[c].to_numpy() for c in ("seq", "t", "x", "y"))
    starts = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if len(seq) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(starts, [*starts[1:], len(seq)], strict=True):
        out.append(Layer(int(seq[a]), float(t[a]), float(x[a]), float(y[a]), {c: v[a:b] for c, v in whole.items()}))
    return out


def fold(rows: pd.DataFrame, ways: pd.DataFrame, config: CovarianceConfig) -> pd.DataFrame:
    """Matches one trajectory in parts; rows are its candidates, ways the path lengths between their nodes."""
    names = [c.split()[0] for c in OUT.split(", ")]
    blocks: list[dict] = []
    if not len(rows):
        return pd.DataFrame([], columns=names)
    od = Ways(ways["source"].to_numpy(np.int64), ways["target"].to_numpy(np.int64), ways["distance"].to_numpy(np.float64))
    traj = int(rows["traj_id"].iloc[0])
    layers = layers_of(rows)
    guarded = any(x.oneway.any() for x in layers)
    part = 0

    def emit(sub: list[Layer]) -> None:
        nonlocal part
        settled(sub)
        if config.lag_steps > 0:
            smoothed(sub, config.lag_steps)
        status = "SUCCESS" if len(sub) == len(layers) else "PARTIAL"
        at = int(sub[-1].v.argmax())
        on_path = []
        for layer in reversed(sub):
            on_path.append(at)
            at = int(layer.prev[at])
        for layer, best in zip(sub, reversed(on_path), strict=True):
            n = len(layer.cand)
            chosen = np.zeros(n, bool)
            chosen[best] = True
            blocks.append({
                "seq": np.full(n, layer.seq), "part": np.full(n, part), "status": [status] * n, "cand": layer.cand, "edge_id": layer.edge, "ep": layer.ep, "tp": layer.tp, "sp": layer.sp,
                "eu": np.full(n, layer.eu), "cumu": layer.v, "trust": layer.trust, "entropy": np.full(n, layer.entropy), "entropy_drop": np.full(n, layer.drop), "chosen": chosen,
            })
        part += 1

    def fail(skipped: list[Layer], status: str) -> None:
        nonlocal part
        for layer in skipped:
            gap = np.full(1, np.nan)
            blocks.append({"seq": np.full(1, layer.seq), "part": np.full(1, part), "status": [status], "cand": np.full(1, -1), "edge_id": np.full(1, -1), "chosen": np.zeros(1, bool)} | dict.fromkeys(("ep", "tp", "sp", "eu", "cumu", "trust", "entropy", "entropy_drop"), gap))
            part += 1

    parts: list[list[Layer]] = []
    for layer in layers:
        if parts and abs(layer.t - parts[-1][-1].t) <= config.max_interval:
            parts[-1].append(layer)
        else:
            parts.append([layer])
    if len(layers) < 3:
        fail(layers, "FAILED_NO_CANDIDATE")
        parts = []
    for own in parts:
        if len(own) < 3:
            continue
        sub, skipped = [own[0]], []
        own[0].begin()
        for i, layer in enumerate(own[1:]):
            if i % AHEAD == 0:
                prepared(own[i : i + AHEAD + 1], od, config, guarded)
            last = sub[-1]
            gap = layer.t - last.t
            speed = math.dist((last.x, last.y), (layer.x, layer.y)) / gap if gap > 0 else math.inf
            if config.bridge_gaps and (speed > config.max_speed or gap > config.max_interval):
                emit(sub)
                fail(skipped, "FAILED_DISCONNECTED")
                sub, skipped = [layer], []
                layer.begin()
            elif layer.follow(last, od, config):
                fail(skipped, "FAILED_DISCONNECTED")
                skipped = []
                sub.append(layer)
            elif config.bridge_gaps and len(sub) >= 2:
                emit(sub)
                fail(skipped, "FAILED_DISCONNECTED")
                sub, skipped = [layer], []
                layer.unlinked()
                layer.begin()
            else:
                skipped.append(layer)
        emit(sub)
        fail(skipped, "FAILED_DISCONNECTED")
    if not blocks:
        return pd.DataFrame([], columns=names)
    done = pd.DataFrame({c: np.concatenate([b[c] for b in blocks]) for c in names[1:]})
    done["edge_id"] = done["edge_id"].astype("Int64").mask(done["edge_id"] < 0)
    done["cand"] = done["cand"].astype("Int64").mask(done["cand"] < 0)
    for c in ("ep", "tp", "sp", "eu", "cumu", "trust", "entropy", "entropy_drop"):
        done[c] = done[c].astype("Float64").mask(done["cand"].isna())
    done.insert(0, "traj_id", traj)
    return done[names]


def trusted(matched: DataFrame, threshold: float) -> DataFrame:
    """Only the points whose chosen candidate has at least this trust; a part that keeps none becomes failed points."""
    best = matched.filter("chosen").select("traj_id", "part", "seq", (F.col("trust") >= threshold).alias("__good"))
    any_good = F.max(F.col("__good")).over(Window.partitionBy("traj_id", "part"))
    d = matched.join(best.withColumn("__any", any_good), ["traj_id", "part", "seq"], "left")
    kept = d.filter("__good IS NULL OR __good").drop("__good", "__any").select(matched.columns)
    lost = d.filter("chosen AND NOT __any")
    values = {c: F.lit(None).cast(matched.schema[c].dataType) for c in matched.columns if c not in ("traj_id", "part", "seq")}
    failed = lost.withColumns(values | {"status": F.lit("FAILED_NO_CANDIDATE"), "chosen": F.lit(False)}).select(matched.columns)
    return kept.unionByName(failed)


#: Nodes that go along with a trajectory's rows when its ways are looked up, at most.
TAKEN_ALONG = 64


def covariance_match(points: DataFrame, edges: DataFrame, od: DataFrame, config: CovarianceConfig, cell: float) -> DataFrame:
    """All candidates of all points with filter posteriors (trust), entropies, the part they belong to and its status."""
    cands = checkpointed(with_background(emissions(covariance_candidates(points, edges, config, cell), config), config))
    oneway = [c for c in ("oneway",) if c in cands.columns]
    rows = cands.select("traj_id", "seq", "t", "x", "y", "cand", "edge_id", "source", "target", "length", "offset", "ep", *oneway)
    ends = rows.filter("edge_id IS NOT NULL")
    # a step may skip points, so ways between any two points of a trajectory count; those to other nodes are dropped where
    # they are found, unless the trajectory has too many nodes to go along with each of its rows
    nodes = ends.groupBy("traj_id").agg(F.collect_set("target").alias("leave"), F.collect_set("source").alias("enter"))
    ways = od.select("source", "target", "distance")
    few = nodes.filter(F.size("enter") <= TAKEN_ALONG).select("traj_id", F.explode("leave").alias("source"), "enter").join(ways, "source").filter(F.array_contains("enter", F.col("target")))
    many = nodes.filter(F.size("enter") > TAKEN_ALONG)
    enter = many.select("traj_id", F.explode("enter").alias("target"))
    rest = many.select("traj_id", F.explode("leave").alias("source")).join(ways, "source").join(enter, ["traj_id", "target"], "left_semi")
    needed = few.select("traj_id", "source", "target", "distance").unionByName(rest.select("traj_id", "source", "target", "distance"))

    def run(own: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        return fold(own, ways, config)

    needed = needed.select(F.col("traj_id").alias("of"), "source", "target", "distance")
    return importable(by_trajectory(rows)).groupBy("traj_id").cogroup(by_trajectory(needed, "of").groupBy("of")).applyInPandas(run, OUT)
