"""Mixing sources to target weights by hash-threshold histograms.

`mix_targets` shares a budget over sources by weight, with a ceiling for each (water filling in closed form).
`mix_to_targets` takes, for each source, whole copies of all its rows as often as the target allows, and for
the rest the rows whose hash lies below a threshold. The threshold is found without sorting the rows: sizes
are summed by (source, leading hash digits), a running sum over those at most 4,096 buckets finds the bucket in
which the budget is used up, only that bucket is summed again by its next digits, and so on until the rows of
a bucket share their whole 60-bit hash. Those rows are taken together if that brings the sum nearer to the
target. The thresholds of nested budgets are nested: a smaller target takes a subset of a larger one's rows.

The hash is of the row's key, so reruns agree, rows with equal keys are taken together, and no order of rows
matters. Shuffles move bucket sums that are aggregated before the shuffle; a hot source makes no large task.

Defined cases: a null source is a source of its own, after all others; a null text has size 0; a source whose
rows are all empty has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hash digits (hexadecimal) of the nested histograms; at nine digits a bucket holds 1 of 7e10 rows.
LEVELS = (3, 6, 9, 15)
#: Sources whose table may be broadcast; beyond, the joins shuffle (and Spark splits a hot source).
MOST_BROADCAST = 100_000


def mix_targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size) -> adds target. One row per source.

    Weights repeat over the sources in code-point order, null last. The budget is share x all sizes; a target
    stops at ceiling x its source's size and the excess goes to the others by weight. In order of
    ceiling/weight the sources that stop are a prefix, so the level is a running sum and one comparison.
    """
    cut = lambda c: F.col(c).cast("double")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    t = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("budget", F.lit(share) * F.sum(cut("source_size")).over(everything)).withColumn("cap", F.lit(ceiling) * cut("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    t = t.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    # the first source whose ceiling lies above its level is where stopping ends; all after it share that level
    rest = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("rank", "level"))).over(everything)["level"]
    return t.select("source", "source_size", F.least(F.coalesce(rest * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def row_hash(*keys: Column) -> Column:
    """15 hexadecimal digits, the same in any engine with MD5."""
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))), 1, LEVELS[-1])


def _by_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Joins on the source (null equals null); the table with a row per source is broadcast only if counted as small."""
    return rows.alias("d").join((F.broadcast(per_source) if few else per_source).alias("s"), F.expr("d.source <=> s.source"))


def _thresholds(sized: DataFrame, need: DataFrame, few: bool) -> DataFrame:
    """(source, need) -> (source, below, last): hashes under `below` are taken, and those equal to it if `last`."""
    at = need.select("source", F.lit("").alias("prefix"), F.col("need").alias("left"))
    for known, digits in zip((0, *LEVELS), LEVELS, strict=False):
        if known:
            inside = _by_source(sized, at, few).filter(F.substring("d.h", 1, known) == F.col("s.prefix"))
            sums = inside.groupBy(F.col("d.source").alias("source"), "s.left", F.substring("d.h", 1, digits).alias("bucket")).agg(F.sum("d.size").alias("size"))
        else:
            sums = sized.groupBy("source", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("size").alias("size"))
            sums = _by_source(sums, at, few).select("d.source", "s.left", "d.bucket", "d.size")
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        reached = sums.withColumn("upto", upto).filter("upto >= left").withColumn("left", F.expr("left - (upto - size)"))
        edge = reached.groupBy("source").agg(F.min(F.struct("bucket", "left", "size")).alias("e"))
        at = edge.select("source", F.col("e.bucket").alias("prefix"), F.col("e.left").alias("left"), F.col("e.size").alias("size"))
    return at.select("source", F.col("prefix").alias("below"), F.expr("size - left < left").alias("last"))


def mix_to_targets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized (key columns, source, size, h) x targets (source, source_size, target) -> adds source_size, target, taken.

    `sized` is read several times: give a checkpointed table of small rows.
    """
    goal = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    few = goal.count() <= MOST_BROADCAST
    edge = _thresholds(sized, goal.filter("need > 0").select("source", "need"), few)
    goal = goal.alias("g").join(edge.alias("e"), F.expr("g.source <=> e.source"), "left").select("g.*", "e.below", "e.last")
    below = F.coalesce((F.col("d.h") < F.col("s.below")) | (F.col("s.last") & (F.col("d.h") == F.col("s.below"))), F.lit(False))
    return _by_source(sized, goal, few).select("d.*", "s.source_size", "s.target", (F.col("d.size") * (F.col("s.copies") + below.cast("long"))).alias("taken"))
