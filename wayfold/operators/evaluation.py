"""Quality of matches: errors, calibration, ROC, integrity, accuracy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.geometry import first_beyond
from wayfold.operators.shared import checkpointed


def error_stats(rows: DataFrame, error: str, *by: str) -> DataFrame:
    """Mean, median, RMSE, P95, sample deviation, least and greatest error."""
    e = F.col(error)
    return rows.groupBy(*by).agg(
        F.count(e).alias("n"), F.avg(e).alias("mean"), F.median(e).alias("median"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(e, 0.95).alias("p95"), F.stddev_samp(e).alias("std"), F.min(e).alias("least"), F.max(e).alias("greatest")
    )


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, n): bin i counts values from edge i - 1 up to edge i, bin 0 those under the first edge."""
    bin_no = sum((F.when(F.col(value) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return rows.filter(F.col(value).isNotNull()).groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"))


def reliability(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy, gap); the last bin is closed, empty bins are absent."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    g = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return g.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row: expected and greatest calibration error."""
    g = reliability(rows, confidence, correct, bins)
    return g.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def brier_logloss(rows: DataFrame, confidence: str, correct: str) -> DataFrame:
    p = F.least(F.greatest(F.col(confidence), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col(correct).cast("double")
    return rows.agg(F.avg(F.pow(F.col(confidence) - y, 2)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("logloss"))


def roc_curve(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """(score, tp, fp, tpr, fpr) by descending score; equal scores are one point.

    Equal scores are summed before the running sums, so the single window sees distinct scores only. Those are
    summed up range by range of scores first: no window runs over all of them at once.
    """
    y = F.col(positive).cast("long")
    g = checkpointed(rows.groupBy(F.col(score).alias("score")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q")))
    # 256 slots of about equally many scores, whatever the scores' scale
    cuts = g.agg(F.percentile_approx("score", [i / 256 for i in range(1, 256)], 10_000).alias("cuts"))
    g = g.withColumn("cuts", cuts.scalar()).withColumn("slot", first_beyond(F.col("cuts"), lambda c: c > F.col("score")) - 1).drop("cuts")
    own = Window.partitionBy("slot").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = g.groupBy("slot").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    above = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    slots = slots.select("slot", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("sp", "sq")), F.sum("sp").over(every).alias("all_p"), F.sum("sq").over(every).alias("all_q"))
    # at most 256 rows
    d = g.join(F.broadcast(slots), "slot").withColumn("tp", F.col("sp0") + F.sum("p").over(own)).withColumn("fp", F.col("sq0") + F.sum("q").over(own))
    return d.select("score", "tp", "fp", (F.col("tp") / F.col("all_p")).alias("tpr"), (F.col("fp") / F.col("all_q")).alias("fpr"), "p", "q", "all_p", "all_q")


def roc_auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row: area under the curve by trapezoids (equal scores share credit)."""
    c = roc_curve(rows, score, positive)
    # a step of q negatives adds q * (tp before + half of the step's p)
    return c.agg((F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0)) / F.max(F.col("all_p").cast("double") * F.col("all_q"))).alias("auc"))


def accuracy_coverage(rows: DataFrame, score: str, correct: str, thresholds: list[float]) -> DataFrame:
    """(threshold, coverage, accuracy) for scores at or above each threshold; one pass over the rows."""
    per = [F.struct(F.lit(t).alias("threshold"), F.avg((F.col(score) >= t).cast("double")).alias("coverage"), F.avg(F.when(F.col(score) >= t, F.col(correct).cast("double"))).alias("accuracy")) for t in thresholds]
    return rows.agg(F.array(*per).alias("all")).select(F.explode("all").alias("a")).select("a.*")


def stanford_metrics(rows: DataFrame, error: str, level: str, alarm: float = 0.95) -> DataFrame:
    """One row: alarm_limit (that percentile of the errors), p_md (share of errors beyond their level) and p_fa (beyond the limit).

    Rows whose error or level is missing or not finite are left out; without any row all three are 0.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c).cast("double")) != float("inf"))
    d = rows.filter(finite(error) & finite(level)).select(F.col(error).cast("double").alias("e"), (F.col(error) > F.col(level)).cast("double").alias("beyond"))
    limit = d.agg(F.percentile("e", alarm).alias("alarm_limit"))
    out = d.withColumn("alarm_limit", limit.scalar()).agg(F.max("alarm_limit").alias("alarm_limit"), F.avg("beyond").alias("p_md"), F.avg((F.col("e") > F.col("alarm_limit")).cast("double")).alias("p_fa"))
    return out.na.fill(0.0)


def segment_accuracy(rows: DataFrame, correct: str, by: str) -> DataFrame:
    """Accuracy of each group and, with a null group, of all rows."""
    return rows.rollup(by).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def ks_statistic(rows: DataFrame, value: str, cdf: Column, by: str) -> DataFrame:
    """Greatest difference between the empirical distribution i / n of each group and a given one."""
    w = Window.partitionBy(by)
    d = rows.withColumn("__i", F.row_number().over(w.orderBy(value)) / F.count("*").over(w)).withColumn("__gap", F.abs(F.col("__i") - cdf))
    return d.groupBy(by).agg(F.max("__gap").alias("ks"))


def density_grid(points: DataFrame, cell: float) -> DataFrame:
    return points.groupBy(F.floor(F.col("x") / cell).cast("long").alias("cx"), F.floor(F.col("y") / cell).cast("long").alias("cy")).agg(F.count("*").alias("n"))


def blurred(grid: DataFrame, sigma: float, reach: int = 3) -> DataFrame:
    """Gaussian blur of (cx, cy, n): each cell spreads to its neighbourhood, and what arrives is summed."""
    steps = F.array(*(F.lit(i) for i in range(-reach, reach + 1)))
    spread = grid.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    weight = F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (2 * sigma * sigma))
    total = sum(math.exp(-(i * i + j * j) / (2 * sigma * sigma)) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1))
    return spread.groupBy((F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy")).agg(F.sum(F.col("n") * weight / total).alias("n"))


def error_ellipse(rows: DataFrame, dx: str, dy: str, by: str, scale: float = 2.0) -> DataFrame:
    """(by, major, minor, angle): axes and orientation in degrees of each group's sample covariance ellipse."""
    g = rows.groupBy(by).agg(F.var_samp(dx).alias("a"), F.var_samp(dy).alias("b"), F.covar_samp(dx, dy).alias("c"))
    middle, spread = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.col("c") * F.col("c"))
    return g.select(by, (scale * F.sqrt(middle + spread)).alias("major"), (scale * F.sqrt(F.greatest(middle - spread, F.lit(0.0)))).alias("minor"), F.degrees(0.5 * F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))).alias("angle"))


def entropy_bits(p: Column) -> Column:
    """Sum of -p log2 p over an array."""
    return F.aggregate(p, F.lit(0.0), lambda s, v: s + F.when(v > 0, -v * F.log2(v)).otherwise(F.lit(0.0)))


def credibility(log_p: Column) -> Column:
    """exp(log p), from -50 up; 1 for values of 0 or more; null if not finite."""
    finite = log_p.isNotNull() & ~F.isnan(log_p) & (F.abs(log_p) != float("inf"))
    return F.when(finite, F.when(log_p >= 0, F.lit(1.0)).otherwise(F.exp(F.greatest(log_p, F.lit(-50.0)))))


def combined_score(rows: DataFrame, features: list[str], label: str, key: str, folds: int = 5) -> DataFrame:
    """Adds score: the probability by logistic regression on the features, fitted without the row's own fold (by key hash)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = VectorAssembler(inputCols=features, outputCol="__x").transform(rows).withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    out = None
    for i in range(folds):
        model = LogisticRegression(featuresCol="__x", labelCol=label, maxIter=50).fit(d.filter(F.col("__fold") != i))
        part = model.transform(d.filter(F.col("__fold") == i)).select(*rows.columns, vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
