"""Joins that align result tables: nearest in time, exact or rounded, full outer, intervals, sets of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, key: str, t: str, value: str, tolerance: float) -> DataFrame:
    """Adds right_t and value of the row of `right` that is nearest in time within the tolerance (the earlier one on ties).

    One union and two windows over the key's rows in time order; no pairs are formed. Times repeated on the right
    count once (smallest value).
    """
    once = right.groupBy(key, t).agg(F.min(value).alias(value))
    columns = left.columns
    l = left.select(F.col(key), F.col(t).alias("__t"), F.lit(1).alias("__side"), F.struct(*columns).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    r = once.select(F.col(key), F.col(t).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    both = l.unionByName(r)
    seen = F.when(F.col("__side") == 0, F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")))
    order = Window.partitionBy(key).orderBy("__t", "__side")
    back = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.withColumn("b", F.last(seen, ignorenulls=True).over(back)).withColumn("a", F.first(seen, ignorenulls=True).over(ahead)).filter("__side = 1")
    gap_b, gap_a = F.col("__t") - F.col("b.t"), F.col("a.t") - F.col("__t")
    best = F.when(F.col("a").isNull() | (gap_b <= gap_a), F.col("b")).otherwise(F.col("a"))
    found = found.withColumn("n", best).withColumn("n", F.when(F.abs(F.col("n.t") - F.col("__t")) <= tolerance, F.col("n")))
    return found.select("__row.*", F.col("n.t").alias("right_t"), F.col("n.v").alias(value))


def exact_or_rounded(left: DataFrame, right: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """Adds value of the row with the same time, else of one with the same rounded time."""
    exact = right.groupBy(*keys, t).agg(F.max(value).alias("__exact"))
    rounded = right.groupBy(*keys, F.round(t).alias("__r")).agg(F.max(value).alias("__rounded"))
    d = left.join(exact, [*keys, t], "left").withColumn("__r", F.round(t)).join(rounded, [*keys, "__r"], "left")
    return d.withColumn(value, F.coalesce("__exact", "__rounded")).drop("__exact", "__rounded", "__r")


def full_outer_align(tables: dict[str, DataFrame], keys: list[str], order: str) -> DataFrame:
    """All rows of all tables by key, with a dense number uni_seq within the first key.

    Each table has the keys, `order` (its own row order) and value; of repeated keys the last row counts.
    """
    out = None
    for name, df in tables.items():
        last = df.groupBy(*keys).agg(F.max_by("value", order).alias(name))
        out = last if out is None else out.join(last, keys, "full_outer")
    return out.withColumn("uni_seq", F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:])) - 1)


def interval_join(rows: DataFrame, spans: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Adds the value of the span (key, first, last, no, value) that holds seq; of several the latest one counts.

    Spans are laid out by their own positions, so this is an equi-join.
    """
    places = spans.select(key, F.explode(F.sequence("first", "last")).alias(seq), F.struct("no", value).alias("__s"))
    return rows.join(places.groupBy(key, seq).agg(F.max("__s").alias("__s")), [key, seq], "left").withColumn(value, F.col(f"__s.{value}")).drop("__s")


def overwrite(left: DataFrame, right: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Replaces the column where `right` (unique by keys) has a value."""
    return left.join(right.select(*keys, F.col(column).alias("__new")), keys, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def sessions(rows: DataFrame, key: str, order: list[str], starts: Column) -> DataFrame:
    """Adds run, the number (from 1) of the stretch a row belongs to; `starts` tells first rows (null: also)."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("run", F.sum(F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def time_gaps(points: DataFrame, max_interval: float, least: int = 3) -> DataFrame:
    """Splits trajectories where more than max_interval seconds pass; drops pieces of fewer than `least` points. Adds run."""
    w = Window.partitionBy("traj_id").orderBy("seq")
    cut = sessions(points, "traj_id", ["seq"], F.abs(F.col("t") - F.lag("t").over(w)) > max_interval)
    return cut.withColumn("__n", F.count("*").over(Window.partitionBy("traj_id", "run"))).filter(F.col("__n") >= least).drop("__n")


def speed_cuts(points: DataFrame, max_speed: float) -> DataFrame:
    """Adds run: a new one wherever the straight-line speed exceeds the bound (no time between points counts as infinite)."""
    w = Window.partitionBy("traj_id").orderBy("seq")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    dt = F.col("t") - F.lag("t").over(w)
    fast = F.when(dt > 0, F.sqrt(dx * dx + dy * dy) / dt > max_speed).when(dt.isNotNull(), F.lit(True))
    return sessions(points, "traj_id", ["seq"], fast)
