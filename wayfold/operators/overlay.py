"""Ways across a whole network by blocks: searched within blocks, and over an overlay of the blocks' border nodes.

Rounds of joins (search.py) take one round for each edge of a way, which is too slow for ways of hundreds of edges.
Here the nodes are dealt into blocks of about BLOCK neighbouring nodes. Each block is searched in a task of its own,
from its border nodes only; the overlay has an edge for each edge between blocks and for each way through a block. A
way is a stretch in its source's block, one over the overlay and one in its target's block, so the number of Spark
stages doesn't depend on its length. Of equally long ways the one of fewer edges counts, then smaller node numbers.

The overlay is sent to the tasks. It is bounded: `Overlay.of` gives None for networks whose overlay has more than
MOST edges, and these are searched in rounds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.network import node_table
from wayfold.operators.shared import by_trajectory, checkpointed, importable

#: Nodes of a block, about; edges of the overlay, at most.
BLOCK, MOST = 512, 2_000_000

NEAR = "node long, block long, inward boolean, at array<long>, d array<double>, h array<long>"
FOUND = "source long, target long, distance double, edges long, legs array<struct<a:bigint,b:bigint,e:bigint>>"


class Graph:
    """Edges (u, v, w, h, e) between any node numbers, h the number of edges that each stands for."""

    def __init__(self, u, v, w, h, e):
        u, v = np.asarray(u, np.int64), np.asarray(v, np.int64)
        self.nodes = np.unique(np.concatenate([u, v]))
        self.index = {int(n): i for i, n in enumerate(self.nodes)}
        self.out: list[list] = [[] for _ in self.nodes]
        for a, b, x, k, i in zip(np.searchsorted(self.nodes, u).tolist(), np.searchsorted(self.nodes, v).tolist(), np.asarray(w, float).tolist(), np.asarray(h).tolist(), np.asarray(e).tolist(), strict=True):
            self.out[a].append((b, x, k, i))

    def search(self, starts: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray, list]:
        """Distance and edges of the best way to each node from starts (distance, edges, node), and the step before, (index, edge) or None."""
        n = len(self.nodes)
        best: list = [(math.inf, 0)] * n
        before: list = [None] * n
        heap = []
        for d, h, node in starts:
            i = self.index.get(int(node))
            if i is not None and (d, h) < best[i]:
                best[i] = (d, h)
                heap.append((d, h, i))
        heapq.heapify(heap)
        while heap:
            d, h, i = heapq.heappop(heap)
            if best[i] != (d, h):
                continue
            for j, w, k, e in self.out[i]:
                to = (d + w, h + k)
                if to < best[j]:
                    best[j] = to
                    before[j] = (i, e)
                    heapq.heappush(heap, (*to, j))
        return np.array([b[0] for b in best]), np.array([b[1] for b in best], np.int64), before

    def steps(self, before: list, node: int) -> list[tuple[int, int, int]]:
        """(from, to, edge) of the way that a search found to a node."""
        at, out = self.index[int(node)], []
        while before[at] is not None:
            i, e = before[at]
            out.append((int(self.nodes[i]), int(self.nodes[at]), e))
            at = i
        return out[::-1]


def _inner(arcs: pd.DataFrame) -> Graph:
    return Graph(arcs["u"], arcs["v"], arcs["w"], np.ones(len(arcs), np.int64), arcs["e"])


def blocks(edges: DataFrame, size: int) -> DataFrame:
    """(node, block): nodes dealt into blocks by place, strip by strip, or by number where edges have no line."""
    if "line" in edges.columns:
        nodes = node_table(edges)
    else:
        nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().select("node", F.lit(0.0).alias("x"), F.col("node").cast("double").alias("y"))
    nodes = checkpointed(nodes)
    n, w, h = nodes.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    wanted = max(1, math.ceil((n or 0) / size))
    across = min(wanted, max(1, round(math.sqrt(wanted * (w or 0.0) / h)) if h else wanted))
    up = max(1, math.ceil(wanted / across))

    def cuts(column: str, parts: int) -> Column:
        return F.percentile_approx(column, [i / parts for i in range(1, parts)]) if parts > 1 else F.array().cast("array<double>")

    def slot(value: Column, limits: Column) -> Column:
        return F.size(F.filter(limits, lambda c: c <= value))

    strips = nodes.agg(cuts("x", across).alias("c")).first()["c"] or []
    placed = nodes.withColumn("strip", slot(F.col("x"), F.array(*(F.lit(float(c)) for c in strips)).cast("array<double>")))
    rows = placed.groupBy("strip").agg(cuts("y", up).alias("limits"))
    return placed.join(rows, "strip").select("node", (F.col("strip") * up + slot(F.col("y"), F.col("limits"))).cast("long").alias("block"))


def _near(block: int, arcs: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """For each node of a block the ways to the block's exits and from its entries."""
    out, members = {}, nodes["node"].to_numpy(np.int64)
    for inward, column in ((False, "exit"), (True, "entry")):
        ends = nodes["node"].to_numpy(np.int64)[nodes[column].to_numpy(bool)]
        u, v = ("u", "v") if inward else ("v", "u")
        g = Graph(np.concatenate([arcs[u], members]), np.concatenate([arcs[v], members]), np.concatenate([arcs["w"], np.zeros(len(members))]), np.concatenate([np.ones(len(arcs), np.int64), np.zeros(len(members), np.int64)]), np.full(len(arcs) + len(members), -1))
        places = np.searchsorted(g.nodes, members)
        d, h = np.full((len(ends), len(members)), np.inf), np.zeros((len(ends), len(members)), np.int64)
        for i, end in enumerate(ends):
            dist, hops, _ = g.search([(0.0, 0, end)])
            d[i], h[i] = dist[places], hops[places]
        for j, node in enumerate(members):
            ok = np.isfinite(d[:, j])
            out[(int(node), inward)] = (ends[ok], d[ok, j], h[ok, j])
    return pd.DataFrame([(n, block, i, *v) for (n, i), v in out.items()], columns=["node", "block", "inward", "at", "d", "h"])


class Overlay:
    """The blocks of a network and what is known of their borders; `of` makes one."""

    def __init__(self, spark, arcs: DataFrame, near: DataFrame, links: tuple):
        self.arcs, self.near = arcs, near
        self.links = spark.sparkContext.broadcast(links)

    @staticmethod
    def of(edges: DataFrame) -> Overlay | None:
        place = checkpointed(blocks(edges, BLOCK))
        best = edges.filter("source <> target").groupBy(F.col("source").alias("u"), F.col("target").alias("v")).agg(F.min(F.struct(F.col("length").cast("double").alias("w"), F.col("edge_id").cast("long").alias("e"))).alias("s"))
        arcs = best.join(place.select(F.col("node").alias("u"), F.col("block").alias("bu")), "u").join(place.select(F.col("node").alias("v"), F.col("block").alias("bv")), "v")
        arcs = checkpointed(arcs.select("u", "v", "s.w", "s.e", "bu", "bv"))
        cross, inner = arcs.filter("bu <> bv"), arcs.filter("bu = bv").select(F.col("bu").alias("block"), "u", "v", "w", "e")
        if cross.count() > MOST:
            return None
        exits, entries = cross.select(F.col("u").alias("node")).distinct(), cross.select(F.col("v").alias("node")).distinct()
        marked = place.join(exits.withColumn("exit", F.lit(True)), "node", "left").join(entries.withColumn("entry", F.lit(True)), "node", "left").fillna(False, ["exit", "entry"])

        def run(key: tuple, own: pd.DataFrame, inside: pd.DataFrame) -> pd.DataFrame:
            return _near(int(key[0]), inside, own)

        near = importable(by_trajectory(marked, "block")).groupBy("block").cogroup(by_trajectory(inner, "block").groupBy("block")).applyInPandas(run, NEAR)
        near = checkpointed(near)
        through = near.filter("NOT inward").join(entries, "node", "left_semi")
        if cross.count() + (through.agg(F.sum(F.size("at"))).first()[0] or 0) > MOST:
            return None
        over = through.select(F.col("node").alias("u"), F.explode(F.arrays_zip("at", "d", "h")).alias("z")).select("u", F.col("z.at").alias("v"), F.col("z.d").alias("w"), F.col("z.h").alias("h"), F.lit(-1).cast("long").alias("e")).filter("u <> v")
        links = over.unionByName(cross.select("u", "v", "w", F.lit(1).cast("long").alias("h"), "e")).toPandas().sort_values(["u", "v", "e"])
        return Overlay(edges.sparkSession, inner, near, tuple(links[c].to_numpy() for c in ("u", "v", "w", "h", "e")))

    def _ends(self, inward: bool, node: str, prefix: str) -> DataFrame:
        return self.near.filter(F.col("inward") == inward).select(F.col("node").alias(node), *(F.col(c).alias(f"{prefix}_{c}") for c in ("block", "at", "d", "h")))

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """FOUND for pairs (source, target) of different nodes that have a way; legs: from, to and the edge, -1 for a way within a block."""
        met = pairs.select("source", "target").distinct().filter("source <> target").join(self._ends(False, "source", "s"), "source").join(self._ends(True, "target", "t"), "target")
        met = checkpointed(met)

        def local(own: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
            g, out = _inner(arcs), []
            for source, targets in own.groupby("source")["target"]:
                if int(source) in g.index:
                    d, h, _ = g.search([(0.0, 0, source)])
                    for t in targets:
                        i = g.index.get(int(t))
                        if i is not None and d[i] < math.inf:
                            out.append((source, t, d[i], h[i]))
            return pd.DataFrame(out, columns=["source", "target", "own_d", "own_h"])

        same = met.filter("s_block = t_block").select(F.col("s_block").alias("block"), "source", "target")
        inside = importable(by_trajectory(same, "block")).groupBy("block").cogroup(by_trajectory(self.arcs, "block").groupBy("block")).applyInPandas(local, "source long, target long, own_d double, own_h long")
        rows = met.join(inside, ["source", "target"], "left").withColumn("own_h", F.coalesce("own_h", F.lit(0)))
        links = self.links

        def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, known, block = None, {}, None
            for part in parts:
                g, out = g or Graph(*links.value), []
                for r in part.itertuples(index=False):
                    if r.s_block != block:
                        block, known = r.s_block, {}
                    out.append(_across(g, known, r))
                yield pd.DataFrame([x for x in out if x is not None], columns=["source", "target", "distance", "edges", "legs"])

        return importable(by_trajectory(rows, "s_block").sortWithinPartitions("s_block")).mapInPandas(run, FOUND)

    def ways(self, pairs: DataFrame) -> DataFrame:
        """(source, target, distance, path) of pairs of different nodes."""
        found = checkpointed(self.pairs(pairs))
        legs = found.select("source", "target", F.posexplode("legs").alias("pos", "leg")).select("source", "target", "pos", "leg.a", "leg.b", "leg.e")
        asked = legs.filter("e < 0").select("a", "b").distinct().join(self.near.filter("inward").select(F.col("node").alias("a"), "block"), "a")

        def unpacked(own: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
            g, out = _inner(arcs), []
            for a, ends in own.groupby("a")["b"]:
                _, _, before = g.search([(0.0, 0, a)])
                out += [(a, b, [e for _, _, e in g.steps(before, b)]) for b in ends]
            return pd.DataFrame(out, columns=["a", "b", "part"])

        parts = importable(by_trajectory(asked, "block")).groupBy("block").cogroup(by_trajectory(self.arcs, "block").groupBy("block")).applyInPandas(unpacked, "a long, b long, part array<bigint>")
        whole = legs.join(parts, ["a", "b"], "left").select("source", "target", F.struct("pos", F.when(F.col("e") >= 0, F.array("e")).otherwise(F.col("part")).alias("part")).alias("p"))
        paths = whole.groupBy("source", "target").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"])).alias("path"))
        return found.select("source", "target", "distance").join(paths, ["source", "target"])

    def reach(self, sources: DataFrame) -> DataFrame:
        """(source, target, distance) of all nodes that each source has a way to, itself included."""
        starts = checkpointed(sources.select("source").distinct().join(self._ends(False, "source", "s"), "source"))
        links = self.links

        def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = None
            for part in parts:
                g = g or Graph(*links.value)
                for r in part.itertuples(index=False):
                    d, _, _ = g.search(list(zip(r.s_d, r.s_h, r.s_at, strict=True)))
                    ok = np.isfinite(d)
                    yield pd.DataFrame({"source": r.source, "node": g.nodes[ok], "d": d[ok]})

        over = importable(starts).mapInPandas(run, "source long, node long, d double")
        place = self.near.filter("inward").select("node", "block")
        seeds = over.unionByName(starts.select("source", F.col("source").alias("node"), F.lit(0.0).alias("d"))).join(place, "node")

        def spread(own: pd.DataFrame, arcs: pd.DataFrame) -> pd.DataFrame:
            g, out = _inner(arcs), []
            for source, seed in own.groupby("source"):
                d, _, _ = g.search([(x, 0, n) for x, n in zip(seed["d"], seed["node"], strict=True)])
                ok = np.isfinite(d)
                alone = seed[~seed["node"].isin(g.nodes)].groupby("node", as_index=False)["d"].min()
                out.append(pd.DataFrame({"source": source, "target": np.concatenate([g.nodes[ok], alone["node"]]), "distance": np.concatenate([d[ok], alone["d"]])}))
            return pd.concat(out) if out else pd.DataFrame([], columns=["source", "target", "distance"])

        return importable(by_trajectory(seeds, "block")).groupBy("block").cogroup(by_trajectory(self.arcs, "block").groupBy("block")).applyInPandas(spread, "source long, target long, distance double")


def _across(g: Graph, known: dict, r) -> tuple | None:
    """A row of FOUND: the way within the block, or over one of the exits and one of the entries."""
    best, choice = (math.inf, 0) if math.isnan(r.own_d) else (r.own_d, int(r.own_h)), None
    ends = np.array([g.index[int(b)] for b in r.t_at], np.int64)
    for d, h, a in zip(r.s_d, r.s_h, r.s_at, strict=True):
        if not len(ends):
            break
        a = int(a)
        if a not in known:
            known[a] = g.search([(0.0, 0, a)])
        dist, hops, _ = known[a]
        total, edges = d + dist[ends] + r.t_d, h + hops[ends] + r.t_h
        least = total.min()
        if least > best[0]:
            continue
        i = int(np.where(total == least, edges, np.iinfo(np.int64).max).argmin())
        if (least, int(edges[i])) < best:
            best, choice = (float(least), int(edges[i])), (a, int(r.t_at[i]))
    if best[0] == math.inf:
        return None
    if choice is None:
        legs = [(r.source, r.target, -1)]
    else:
        a, b = choice
        legs = [(r.source, a, -1), *g.steps(known[a][2], b), (b, r.target, -1)]
    return r.source, r.target, float(best[0]), int(best[1]), [{"a": int(a), "b": int(b), "e": int(e)} for a, b, e in legs if a != b]
