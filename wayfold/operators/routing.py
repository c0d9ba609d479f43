"""Bounded shortest paths as relational relaxation, and what is built on them.

All sources advance together (see search.py). Ties are broken by the path's edge ids in order, which makes every
result deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.overlay import Overlay
from wayfold.operators.path_table import od_rows
from wayfold.operators.search import NO_EDGES, Search
from wayfold.operators.shared import checkpointed


def bounded_paths(edges: DataFrame, sources: DataFrame, limit: float = 1.0, stop_at: DataFrame | None = None, targets: DataFrame | None = None, paths: bool = True) -> DataFrame:
    """(source, target, distance, path): all nodes within the limit of each source, the source itself included.

    sources has a column source, and may have one named limit, each source's own (else `limit` holds for all; the
    largest counts where a source comes twice). stop_at (node), if given, are nodes that are reached but not passed.
    targets (source, target), if given, are the only pairs that come back, and a source isn't searched from any more
    once they are all settled. Without paths, only distances are kept.
    """
    unit = F.max("limit") if "limit" in sources.columns else F.lit(float(limit))
    starts = sources.groupBy("source").agg(unit.alias("unit")).withColumn("node", F.col("source"))
    wanted = None if targets is None else targets.select("source", F.col("target").alias("node"))
    if wanted is not None:
        starts = starts.join(wanted.select("source"), "source", "left_semi")
    search = Search(edges, starts, paths=paths, stop_at=stop_at, wanted=wanted).to()
    found = search.reached()
    if wanted is not None:
        found = found.join(wanted.distinct(), ["source", "node"], "left_semi")
    return search.ended(found.withColumnRenamed("node", "target"))


def od_table(edges: DataFrame, limit: float, sources: DataFrame | None = None) -> DataFrame:
    """Origin-destination rows (source, target, next_n, prev_n, next_e, distance, path) of different nodes within the limit."""
    starts = edges.select("source").distinct() if sources is None else sources
    return od_rows(bounded_paths(edges, starts, limit).filter("source <> target"), edges)


def turned(edges: DataFrame) -> DataFrame:
    """The edges the other way round."""
    return edges.withColumns({"source": F.col("target"), "target": F.col("source")})


def reverse_paths(edges: DataFrame, targets: DataFrame, limit: float) -> DataFrame:
    """(source, target, distance): nodes from which each target is within the limit."""
    found = bounded_paths(turned(edges), targets.select(F.col("target").alias("source")), limit, paths=False)
    return found.select(F.col("target").alias("source"), F.col("source").alias("target"), "distance")


def far_distances(edges: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """(source, target, distance): bounded_paths without paths for limits of very many edges; ways of any length take the same number of stages."""
    over = Overlay.of(edges)
    if over is None:
        return bounded_paths(edges, sources, limit, paths=False)
    return over.reach(sources).filter(F.col("distance") <= limit)


#: Pairs still open after so many circles, or widenings of their limits, are settled over the network's blocks (see overlay.py).
CIRCLES, WIDENINGS = 2, 2
#: Pairs whose straight line is longer than so many edges of mean length are not searched for step by step.
FAR = 8


def two_sided_paths(edges: DataFrame, pairs: DataFrame, radius: float, stats: dict | None = None) -> DataFrame:
    """(source, target, distance, path) of given pairs, however long, by searches from both ends that meet.

    Both searches go on in circles that double, from all open sources and to all open targets at once. A way of twice
    the radius or less has an edge from a node within the radius of its source to a node within the radius of its
    target (or ends within the first), so what meets over such edges settles all pairs up to that length. A pair is
    also settled, or without a way, once its source or its target has no more to offer. Pairs without a way are
    absent, and so are pairs of a node with itself. stats, if given, gets rounds and states.

    Ways of many edges would take as many rounds, so pairs that are open after CIRCLES circles are settled over the
    network's blocks, unless their overlay is too large to be sent to the tasks.
    """
    open_ = checkpointed(pairs.select("source", "target").filter("source <> target").distinct())
    circles, over_blocks = 0, None
    ends = {"source": Search(edges, _starts(open_, "source")), "target": Search(turned(edges), _starts(open_, "target"), ("target",))}
    found = None
    while open_.head(1):
        beyond = {}
        for end, search in ends.items():
            beyond[end] = checkpointed(search.to(radius, open_.select(end).distinct()).parked(open_.select(end).distinct()).groupBy(end, "node").agg(F.min("s").alias("s")))
        ahead = ends["source"].reached().unionByName(beyond["source"].select("source", "node", "s.distance", "s.path"))
        back = ends["target"].reached().select("target", "node", F.col("distance").alias("rest"), F.reverse("path").alias("end"))
        met = open_.join(ahead, "source").join(back, ["target", "node"])
        way = F.min(F.struct((F.col("distance") + F.col("rest")).alias("distance"), F.concat("path", "end").alias("path"))).alias("s")
        best = checkpointed(met.groupBy("source", "target").agg(way))
        over = [open_.join(beyond[end].select(end).distinct(), end, "left_anti") for end in ends]
        over = over[0].unionByName(over[1]).distinct()
        done = checkpointed(best.filter(F.col("s.distance") <= 2 * radius).unionByName(best.join(over, ["source", "target"], "left_semi")).distinct())
        found = done if found is None else found.unionByName(done)
        open_ = checkpointed(open_.join(done, ["source", "target"], "left_anti").join(over, ["source", "target"], "left_anti"))
        radius *= 2
        circles += 1
        if circles == CIRCLES and open_.head(1):
            over_blocks = Overlay.of(edges)
            if over_blocks is not None:
                found = found.unionByName(_across_blocks(over_blocks, open_))
                break
    if stats is not None and found is not None:
        stats |= {"rounds": sum(x.rounds for x in ends.values()), "states": sum(x.known().count() for x in ends.values())}
    if found is None:
        return pairs.select("source", "target", F.lit(0.0).alias("distance"), F.expr(NO_EDGES).alias("path")).filter("false")
    for search in ends.values():
        search.dropped()
    return found.select("source", "target", "s.distance", "s.path")


def _across_blocks(over: Overlay, pairs: DataFrame) -> DataFrame:
    """(source, target, s): the ways of pairs, in the form of a search's states."""
    return checkpointed(over.ways(pairs).select("source", "target", F.struct("distance", "path").alias("s")))


def _starts(pairs: DataFrame, end: str) -> DataFrame:
    return pairs.select(end).distinct().withColumn("node", F.col(end))


#: Lower bounds are taken this much smaller, against rounding.
SLACK = 1e-9


def goal_directed_paths(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, widening: float = 1.5, stats: dict | None = None) -> DataFrame:
    """(source, target, distance, path) of given pairs by searches that look towards their goals.

    nodes (node, x, y) give the straight line from a node to the goal, which no way is shorter than. A state is
    expanded only while its distance and that line are within the pair's limit, which starts as the straight line
    between both ends and grows by the factor `widening` for pairs still open; a pair's search ends when its goal is
    settled. Pairs without a way are absent, and so are pairs of a node with itself.

    A search takes a round for each edge, so pairs whose straight line is longer than FAR edges, and those that are open
    after WIDENINGS, are settled over the network's blocks, unless their overlay is too large to be sent to the tasks.
    """
    open_ = checkpointed(pairs.select("source", F.col("target").alias("goal")).filter("source <> goal").distinct())
    if not open_.head(1):
        return pairs.select("source", "target", F.lit(0.0).alias("distance"), F.expr(NO_EDGES).alias("path")).filter("false")
    place = lambda n, x, y: nodes.select(F.col("node").alias(n), F.col("x").alias(x), F.col("y").alias(y))
    line = F.sqrt(F.pow(F.col("gx") - F.col("nx"), 2) + F.pow(F.col("gy") - F.col("ny"), 2)) * (1 - SLACK)
    ahead = lambda d: d.join(place("node", "nx", "ny"), "node").withColumn("h", line).drop("nx", "ny")
    starts = open_.join(place("goal", "gx", "gy"), "goal").withColumn("node", F.col("source"))
    first = starts.join(place("node", "nx", "ny"), "node").withColumn("unit", F.greatest(line * (1 + 2 * SLACK), F.lit(1e-9))).drop("nx", "ny")
    mean = edges.agg(F.avg("length")).first()[0] or 0.0
    far = checkpointed(first.filter(F.col("unit") > FAR * mean).select("source", "goal"))
    over_blocks = Overlay.of(edges) if far.head(1) else None
    parts = []
    if over_blocks is not None:
        parts.append(_goals_across(over_blocks, far))
        open_ = checkpointed(open_.join(far, ["source", "goal"], "left_anti"))
        first = first.join(far, ["source", "goal"], "left_anti")
    search = Search(edges, first, ("source", "goal"), ahead=ahead, wanted=open_.withColumn("node", F.col("goal")))
    factor, widened = 1.0, 0
    while open_.head(1):
        search.to(factor, open_)
        best = search.reached().filter("node = goal").join(open_, ["source", "goal"], "left_semi")
        unit = first.select("source", "goal", "unit")
        more = search.parked(open_).select("source", "goal").distinct()
        over = checkpointed(open_.join(more, ["source", "goal"], "left_anti"))
        done = checkpointed(best.join(unit, ["source", "goal"]).filter(F.col("distance") <= F.col("unit") * factor).drop("unit").unionByName(best.join(over, ["source", "goal"], "left_semi")).distinct())
        parts.append(done.select("source", "goal", "distance", "path"))
        open_ = checkpointed(open_.join(done, ["source", "goal"], "left_anti").join(over, ["source", "goal"], "left_anti"))
        factor *= widening
        widened += 1
        if widened == WIDENINGS and open_.head(1):
            over_blocks = over_blocks or Overlay.of(edges)
            if over_blocks is not None:
                parts.append(_goals_across(over_blocks, open_))
                break
    if stats is not None:
        stats |= {"rounds": search.rounds, "states": search.known().count() if search.rounds else 0}
    search.dropped()
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.select("source", F.col("goal").alias("target"), "distance", "path")


def _goals_across(over: Overlay, open_: DataFrame) -> DataFrame:
    return _across_blocks(over, open_.withColumnRenamed("goal", "target")).select("source", F.col("target").alias("goal"), "s.distance", "s.path")


def routed_pairs(edges: DataFrame, pairs: DataFrame, limit: float) -> DataFrame:
    """(source, target, distance, path) of given pairs, however long; `limit` is the radius that both ends start with."""
    return two_sided_paths(edges, pairs, limit)


def unrolled(od: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, path): edges of each pair's path by following first hops; null where the table has no way.

    For tables without a path column, as they are read from files. Every round advances all pairs by one edge.
    """
    hop = od.select(F.col("source").alias("at"), "target", "next_n", "next_e")
    state = pairs.select("source", "target").distinct().select("source", "target", F.col("source").alias("at"), F.expr("cast(array() as array<bigint>)").alias("path"))
    done = state.filter("at = target")
    state = state.filter("at <> target")
    parts = [done]
    while state.head(1):
        moved = checkpointed(state.join(hop, ["at", "target"], "left").select("source", "target", F.col("next_n").alias("at"), F.when(F.col("next_e").isNotNull(), F.concat("path", F.array("next_e"))).alias("path")))
        parts.append(moved.filter("at IS NULL OR at = target"))
        state = moved.filter("at <> target")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("source", "target", "path")


def edges_within(edges: DataFrame, node: DataFrame, limit: float, backward: bool = False) -> DataFrame:
    """(node, edge_id): edges that lie wholly within the limit from (or, backward, to) each node."""
    near = "target" if backward else "source"
    if backward:
        found = reverse_paths(edges, node.select(F.col("node").alias("target")), limit).select(F.col("target").alias("node"), F.col("source").alias("at"), "distance")
    else:
        found = bounded_paths(edges, node.select(F.col("node").alias("source")), limit, paths=False).select(F.col("source").alias("node"), F.col("target").alias("at"), "distance")
    return found.join(edges.select("edge_id", F.col(near).alias("at"), "length"), "at").filter(F.col("distance") + F.col("length") <= limit).select("node", "edge_id").distinct()


def partial_od(od: DataFrame, edges: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """OD rows whose source is an end of an edge that meets the box."""
    from wayfold.operators.network import in_box

    nodes = in_box(edges, *box).select(F.explode(F.array("source", "target")).alias("source")).distinct()
    return od.join(nodes, "source", "left_semi")


def source_index(od: DataFrame) -> DataFrame:
    """(source, rows): numbers of rows of each source, which is what a sorted OD file is looked up by."""
    return od.groupBy("source").agg(F.count("*").alias("rows"))
