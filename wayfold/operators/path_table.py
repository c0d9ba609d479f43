"""A table of bounded ways that is laid out for look-ups, checked, and repaired when the network grows.

The rows are the states of a search (see search.py): bucketed by source and target, so that a look-up by both shuffles
the pairs that ask and never the table. More edges or sources append what they change as further rounds; look-ups
take the best row of each pair within its bucket, and compaction writes these anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.search import Search

#: Costs may differ by so much from the sum of their parts (lengths in files are rounded).
TOLERANCE = 1e-6


class PathTable:
    """Ways within `limit` of the sources of `edges` (or of the given ones: column source)."""

    def __init__(self, edges: DataFrame, limit: float, sources: DataFrame | None = None, paths: bool = True):
        self.edges, self.limit = edges, float(limit)
        self.search = Search(edges, self._starts(edges if sources is None else sources), paths=paths).to()

    def _starts(self, sources: DataFrame) -> DataFrame:
        return sources.select("source").distinct().withColumns({"unit": F.lit(self.limit), "node": F.col("source")})

    def ways(self) -> DataFrame:
        """(source, target, distance[, path]) of different nodes."""
        return self.search.reached().withColumnRenamed("node", "target").filter("source <> target")

    def rows(self) -> DataFrame:
        """Origin-destination rows as they are written to files (needs paths)."""
        return od_rows(self.ways(), self.edges)

    def add_edges(self, more: DataFrame) -> int:
        """Repairs the table after more edges, whose sources become sources, too; returns the number of rows written."""
        before, known = self.search.rounds, self.search.known().select("source").distinct()
        self.edges = self.edges.unionByName(more, allowMissingColumns=True)
        self.search.add_edges(more)
        self.search.add_starts(self._starts(more).join(known, "source", "left_anti"))
        return self.search.known().filter(F.col("round") >= before).count()

    def add_sources(self, more: DataFrame) -> int:
        """Searches from further sources; returns the number of rows written."""
        before = self.search.rounds
        self.search.add_starts(self._starts(more))
        return self.search.known().filter(F.col("round") >= before).count()

    def compacted(self) -> PathTable:
        self.search.compacted()
        return self

    def dropped(self) -> None:
        self.search.dropped()


def od_rows(ways: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, next_n, prev_n, next_e, distance, path) of ways with paths."""
    ends = edges.select(F.col("edge_id").cast("long").alias("next_e"), F.col("target").alias("next_n"))
    last = edges.select(F.col("edge_id").cast("long").alias("last_e"), F.col("source").alias("prev_n"))
    out = ways.withColumn("next_e", F.try_element_at("path", F.lit(1))).withColumn("last_e", F.try_element_at("path", F.lit(-1)))
    return out.join(ends, "next_e").join(last, "last_e").select("source", "target", "next_n", "prev_n", "next_e", "distance", "path")


def faults(od: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, fault) of every row of a path table (source, target, next_n, prev_n, next_e, distance) that can't be right.

    Faults: `null`, `loop` (from a node to itself), `twice`, `negative`, `first edge` (next_e doesn't lead from the
    source to next_n), `last node` (no edge leads from prev_n to the target), `rest` (the way from next_n is missing,
    or its length and that of the first edge don't add up).
    """
    first = edges.select(F.col("edge_id").cast("long").alias("next_e"), F.col("source").alias("e_source"), F.col("target").alias("e_target"), F.col("length").alias("e_length"))
    last = edges.select(F.col("source").alias("prev_n"), F.col("target")).distinct().withColumn("ends", F.lit(True))
    rest = od.groupBy(F.col("source").alias("next_n"), "target").agg(F.min("distance").alias("rest"))
    counts = od.groupBy("source", "target").agg(F.count("*").alias("rows"))
    d = od.join(counts, ["source", "target"], "left").join(first, "next_e", "left").join(last, ["prev_n", "target"], "left").join(rest, ["next_n", "target"], "left")
    left = F.when(F.col("next_n") == F.col("target"), F.lit(0.0)).otherwise(F.col("rest"))
    none = F.lit(False)
    for c in ("source", "target", "next_n", "prev_n", "next_e", "distance"):
        none = none | F.col(c).isNull()
    found = {
        "null": none,
        "loop": F.col("source") == F.col("target"),
        "twice": F.col("rows") > 1,
        "negative": F.col("distance") < 0,
        "first edge": ~none & ~F.coalesce((F.col("e_source") == F.col("source")) & (F.col("e_target") == F.col("next_n")), F.lit(False)),
        "last node": ~none & F.col("ends").isNull(),
        "rest": ~none & ~F.coalesce(F.abs(F.col("e_length") + left - F.col("distance")) <= TOLERANCE, F.lit(False)),
    }
    named = F.filter(F.array(*(F.when(hit, F.lit(name)) for name, hit in found.items())), lambda x: x.isNotNull())
    return d.select("source", "target", F.explode(named).alias("fault"))
