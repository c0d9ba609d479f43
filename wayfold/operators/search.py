"""Shortest ways from many starts at once, as rounds of joins that can be carried on to larger limits.

A state is the best (distance, path) of a start at a node. States lie in one table that is bucketed by start and node
and partitioned by round, in the folder that all executors share: a round joins the states of the last one with the
edges, and only these offers are shuffled, to the buckets; earlier states are compared where they lie and are never
written again. When a limit grows, what the edges out of known states offer beyond the old one is taken up, so a
search goes on where it stopped. Ties are broken by the path's edge ids in order (by nothing, where no paths are kept: distances are equal).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.shared import checkpointed, deleted, exists, shared_folder

NO_EDGES = "cast(array() as array<bigint>)"


class Search:
    """starts: the key columns, node, and unit (the limit at factor 1; by default 1.0); other columns go along.

    ahead: a table with these columns -> the same with h, a lower bound of the rest of the way (default 0.0); rows are
    expanded while distance + h is within the limit. stop_at (node): nodes that are reached but not passed.
    wanted (keys, node): a start whose wanted nodes are all settled is not carried on.
    """

    def __init__(self, edges: DataFrame, starts: DataFrame, keys: tuple[str, ...] = ("source",), paths: bool = True, ahead: Callable[[DataFrame], DataFrame] | None = None, stop_at: DataFrame | None = None, wanted: DataFrame | None = None):
        self.spark, self.keys, self.at, self.paths, self.stop_at = edges.sparkSession, list(keys), [*keys, "node"], paths, stop_at
        self.ahead = ahead or (lambda d: d.withColumn("h", F.lit(0.0)))
        self.steps = steps_of(edges)
        starts = starts if "unit" in starts.columns else starts.withColumn("unit", F.lit(1.0))
        self.along = [c for c in starts.columns if c not in self.at]
        self.starts = self.begun(starts)
        self.wanted = None if wanted is None else checkpointed(wanted.select(*self.at).distinct().withColumn("best", F.lit(float("inf"))))
        self.rounds, self.factor = 0, None
        self.rename()

    def rename(self) -> None:
        mark = uuid.uuid4().hex
        self.name, self.path = f"wayfold_search_{mark}", f"{shared_folder(self.spark)}/search-{mark}"

    def begun(self, starts: DataFrame) -> DataFrame:
        return self.ahead(starts.withColumn("s", self.state(F.lit(0.0), F.expr(NO_EDGES))))

    def state(self, distance: Column, path: Column) -> Column:
        return F.struct(distance.alias("distance"), path.alias("path")) if self.paths else F.struct(distance.alias("distance"))

    def known(self) -> DataFrame:
        """All states that were ever the best ones."""
        return self.spark.table(self.name)

    def stored(self, better: DataFrame) -> DataFrame | None:
        """Appends the states of a round, and reads just these; None if there are none."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        better.withColumn("round", F.lit(self.rounds)).write.partitionBy("round").bucketBy(n, *self.at).option("path", self.path).mode("append").saveAsTable(self.name)
        front = self.known().filter(F.col("round") == self.rounds).drop("round")
        self.rounds += 1
        return front if exists(self.spark, f"{self.path}/round={self.rounds - 1}") else None

    def better(self, offers: DataFrame) -> DataFrame:
        """Of each start and node the best offer, if it beats all states there."""
        rest = [F.first(c).alias(c) for c in ("h", *self.along)]
        best = offers.groupBy(*self.at).agg(F.min("s").alias("s"), *rest)
        if not self.rounds:
            return best
        known = self.known().select(*(F.col(c).alias(f"known_{c}") for c in [*self.at, "s"]))
        same = F.col("known_s") <= F.col("s")
        for c in self.at:
            same = same & (F.col(c) == F.col(f"known_{c}"))
        return best.join(known, same, "left_anti")

    def expanded(self, front: DataFrame) -> DataFrame:
        """What the edges out of these states offer."""
        if self.stop_at is not None:
            front = front.join(self.stop_at.select("node"), "node", "left_anti")
        path = F.concat("s.path", F.array("e")) if self.paths else F.expr(NO_EDGES)
        met = front.join(self.steps, front["node"] == self.steps["u"])
        return self.ahead(met.select(*self.keys, F.col("v").alias("node"), *self.along, self.state(F.col("s.distance") + F.col("w"), path).alias("s")))

    def open_only(self, front: DataFrame) -> DataFrame:
        """Without states that can't improve any wanted node of their start."""
        if self.wanted is None:
            return front
        self.wanted = checkpointed(self.wanted.join(front.select(*self.at, "s.distance"), self.at, "left").withColumn("best", F.least("best", "distance")).drop("distance"))
        bounds = self.wanted.groupBy(*self.keys).agg(F.max("best").alias("bound"))
        return front.join(bounds, self.keys).filter(F.col("s.distance") + F.col("h") <= F.col("bound")).drop("bound")

    def parked(self, only: DataFrame | None = None) -> DataFrame:
        """Offers beyond the limit so far. only: the starts (keys) that still count."""
        states = self.starts if self.factor is None else self.best()
        if only is not None:
            states = states.join(only, self.keys, "left_semi")
        return states if self.factor is None else self.expanded(states).filter(~self.within(self.factor))

    def within(self, factor: float) -> Column:
        return F.col("s.distance") + F.col("h") <= F.col("unit") * factor

    def to(self, factor: float = 1.0, only: DataFrame | None = None) -> Search:
        """Carries on until every start has all nodes within unit * factor."""
        offers, self.factor = self.parked(only), factor
        return self.relaxed(offers)

    def relaxed(self, offers: DataFrame) -> Search:
        """Takes up offers, and what follows from them within the limit."""
        while True:
            front = self.stored(self.better(offers.filter(self.within(self.factor))))
            if front is None:
                return self
            offers = self.expanded(self.open_only(front))

    def best(self) -> DataFrame:
        """The best state of each start and node with all its columns; states of a start and node lie in one bucket."""
        return self.known().groupBy(*self.at).agg(F.min("s").alias("s"), *(F.first(c).alias(c) for c in ("h", *self.along)))

    def add_edges(self, more: DataFrame) -> Search:
        """Repairs all states after more edges: only what these offer, and what follows from that, is worked out."""
        every, self.steps = self.steps, steps_of(more)
        offers = self.expanded(self.best())
        self.steps = every.unionByName(self.steps)
        return self.relaxed(offers)

    def add_starts(self, more: DataFrame) -> Search:
        """Searches from further starts, too (columns as at the beginning)."""
        return self.relaxed(self.begun(more))

    def compacted(self) -> None:
        """Writes the best states anew, without those that they superseded."""
        name, path, best = self.name, self.path, self.best()
        self.rename()
        self.rounds = 0
        self.stored(best)
        drop(self.spark, name, path)

    def reached(self) -> DataFrame:
        """(keys, node, distance[, path]): the best state of each start and node."""
        best = self.known().groupBy(*self.at).agg(F.min("s").alias("s"))
        return best.select(*self.at, "s.distance", *(["s.path"] if self.paths else []))

    def ended(self, result: DataFrame) -> DataFrame:
        """Writes a result made of the states, and drops these."""
        done = checkpointed(result)
        self.dropped()
        return done

    def dropped(self) -> None:
        drop(self.spark, self.name, self.path)


def steps_of(edges: DataFrame) -> DataFrame:
    """What a round needs of the edges, worked out once."""
    return checkpointed(edges.select(F.col("edge_id").cast("long").alias("e"), F.col("source").alias("u"), F.col("target").alias("v"), F.col("length").alias("w")))


def drop(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    deleted(spark, path)
