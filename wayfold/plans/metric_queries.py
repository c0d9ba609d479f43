"""Queries on alignment and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as G
from wayfold.operators import alignment, evaluation
from wayfold.plans import demo
from wayfold.plans.checks import r, sql

Spark, Frame = SparkSession, DataFrame


def _scored(spark: Spark, sf: str) -> Frame:
    return demo.scored(spark, sf)


def asof_nearest_join(spark: Spark, sf: str) -> Frame:
    """Each third event against the others of its user, within two hours."""
    e = demo.table(spark, sf, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    left = e.filter("event_id % 3 = 0")
    right = e.filter("event_id % 3 <> 0").select("user_id", "t", F.col("event_id").alias("other"))
    d = alignment.asof_nearest(left, right, "user_id", "t", "other", 7200.0)
    return d.select("event_id", "other")


def exact_or_rounded_join(spark: Spark, sf: str) -> Frame:
    e = F.col("event_id")
    left = demo.table(spark, sf, "events").select("event_id", "user_id", ((e % 500) / 4.0 + 0.1).alias("t"))
    right = demo.table(spark, sf, "events").filter("event_id % 2 = 0").select("user_id", ((e % 500) / 4.0 + F.when(e % 4 == 0, 0.1).otherwise(0.15)).alias("t"), e.alias("other"))
    return alignment.exact_or_rounded(left, right, ["user_id"], "t", "other").select("event_id", "other")


def full_outer_align(spark: Spark, sf: str) -> Frame:
    e = demo.table(spark, sf, "events").withColumn("k", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long"))
    part = lambda m: e.filter(F.col("event_id") % 3 == m).select("user_id", "k", F.col("event_id").alias("n"), F.col("event_id").alias("value"))
    d = alignment.full_outer_align({"a": part(0), "b": part(1), "c": part(2)}, ["user_id", "k"], "n")
    return d.select("user_id", "k", F.col("uni_seq").cast("long").alias("uni_seq"), "a", "b", "c")


def truth_join(spark: Spark, sf: str) -> Frame:
    """Events against a second numbering of their users' events, by user and number."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = Window.partitionBy("user_id").orderBy("value", "event_id")
    e = demo.table(spark, sf, "events")
    a = e.select("user_id", "event_id", (F.row_number().over(w) - 1).cast("long").alias("seq"))
    b = e.filter("event_id % 5 <> 0").select("user_id", F.col("event_id").alias("truth"), (F.row_number().over(v) - 1).cast("long").alias("seq"))
    return a.join(b, ["user_id", "seq"]).select("event_id", "truth")


def interval_join(spark: Spark, sf: str) -> Frame:
    """Line items of an order against spans of line numbers that the order lays down; later spans win."""
    o = F.col("o_orderkey")
    orders = demo.table(spark, sf, "orders")
    first = orders.select(o.alias("l_orderkey"), F.lit(1).alias("first"), (o % 5 + 1).cast("int").alias("last"), F.lit(0).alias("no"), (o % 97).alias("edge"))
    second = orders.select(o.alias("l_orderkey"), F.lit(3).alias("first"), F.lit(4).alias("last"), F.lit(1).alias("no"), (o % 89 + 100).alias("edge"))
    rows = demo.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber"))
    return alignment.interval_join(rows, first.unionByName(second), "l_orderkey", "l_linenumber", "edge").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "edge")


def coalesce_left_join(spark: Spark, sf: str) -> Frame:
    left = demo.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("level"))
    right = demo.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("level"))
    return alignment.overwrite(left, right, ["c_custkey"], "level").select("c_custkey", r("level").alias("level"))


def id_intersect(spark: Spark, sf: str) -> Frame:
    a = demo.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return a.intersect(demo.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")))


def id_except(spark: Spark, sf: str) -> Frame:
    a = demo.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return a.subtract(demo.table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id")))


def sort_by_id(spark: Spark, sf: str) -> Frame:
    """Rows by number, text that is none last."""
    e = demo.table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string")).alias("id"))
    return e.orderBy(F.col("id").try_cast("long").asc_nulls_last(), "id")


def subsample(spark: Spark, sf: str) -> Frame:
    return demo.points(spark, sf).filter(F.col("seq") % 5 == 0).select("traj_id", "seq", "event_id")


def error_stats(spark: Spark, sf: str) -> Frame:
    d = evaluation.error_stats(_scored(spark, sf), "error", "correct")
    return d.select(F.col("correct").cast("long").alias("correct"), "n", *(r(c).alias(c) for c in d.columns[2:]))


def error_histogram(spark: Spark, sf: str) -> Frame:
    d = evaluation.histogram(_scored(spark, sf), "error", [5, 10, 20, 50])
    return d.select(F.col("bin").cast("long").alias("bin"), "n")


def reliability_bins(spark: Spark, sf: str) -> Frame:
    d = evaluation.reliability(_scored(spark, sf), "confidence", "correct")
    return d.select(F.col("bin").cast("long").alias("bin"), "n", *(r(c).alias(c) for c in ("confidence", "accuracy", "gap")))


def ece(spark: Spark, sf: str) -> Frame:
    d = evaluation.calibration_error(_scored(spark, sf), "confidence", "correct")
    return d.select(r("ece").alias("ece"), r("mce").alias("mce"))


def brier_logloss(spark: Spark, sf: str) -> Frame:
    d = evaluation.brier_logloss(_scored(spark, sf), "confidence", "correct")
    return d.select(r("brier").alias("brier"), r("logloss").alias("logloss"))


def roc_curve(spark: Spark, sf: str) -> Frame:
    d = evaluation.roc_curve(_scored(spark, sf), "confidence", "correct")
    return d.select(r("score").alias("score"), r("tpr").alias("tpr"), r("fpr").alias("fpr"))


def roc_auc(spark: Spark, sf: str) -> Frame:
    return evaluation.roc_auc(_scored(spark, sf), "confidence", "correct").select(r("auc").alias("auc"))


CUTS = [i / 10 for i in range(10)]


def accuracy_coverage(spark: Spark, sf: str) -> Frame:
    d = evaluation.accuracy_coverage(_scored(spark, sf), "confidence", "correct", CUTS)
    return d.select(*(r(c).alias(c) for c in d.columns))


def stanford_metrics(spark: Spark, sf: str) -> Frame:
    d = evaluation.stanford_metrics(_scored(spark, sf), "error", "level")
    return d.select(*(r(c).alias(c) for c in d.columns))


def segment_accuracy_rollup(spark: Spark, sf: str) -> Frame:
    d = evaluation.segment_accuracy(_scored(spark, sf), "correct", "user_id")
    return d.select("user_id", "n", r("accuracy").alias("accuracy"))


def trust_separation(spark: Spark, sf: str) -> Frame:
    d = _scored(spark, sf).agg(F.avg(F.when(F.col("correct") == 1, F.col("confidence"))).alias("a"), F.avg(F.when(F.col("correct") == 0, F.col("confidence"))).alias("b"))
    return d.select(r(F.col("a") - F.col("b")).alias("separation"))


def ks_statistic(spark: Spark, sf: str) -> Frame:
    d = evaluation.ks_statistic(_scored(spark, sf).withColumn("g", F.col("user_id") % 4), "error", 1 - F.exp(-F.col("error") / 2), "g")
    return d.select("g", r("ks").alias("ks"))


def density_grid(spark: Spark, sf: str) -> Frame:
    return evaluation.density_grid(demo.points(spark, sf), 0.5)


def density_blur(spark: Spark, sf: str) -> Frame:
    d = evaluation.blurred(evaluation.density_grid(demo.points(spark, sf), 0.5), 1.0)
    return d.select("cx", "cy", r("n").alias("n"))


def running_mean(spark: Spark, sf: str) -> Frame:
    """Mean of the values so far, missing ones left out."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _scored(spark, sf).withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("error"))).select("event_id", r(F.avg("v").over(w)).alias("mean"))


def pl_coverage(spark: Spark, sf: str) -> Frame:
    """Users whose events lie within their level all, none or in part, with the mean share."""
    d = _scored(spark, sf).groupBy("user_id").agg(F.avg((F.col("error") <= F.col("level")).cast("double")).alias("share"))
    return d.agg(F.count(F.when(F.col("share") == 1, 1)).alias("every"), F.count(F.when(F.col("share") == 0, 1)).alias("none"), F.count(F.when((F.col("share") > 0) & (F.col("share") < 1), 1)).alias("part"), r(F.avg("share")).alias("mean"))


def smooth_ratio(spark: Spark, sf: str) -> Frame:
    """Step between snapped points by step between raw points, 1 for raw steps of up to a tenth."""
    w = Window.partitionBy("traj_id").orderBy("seq")
    p = demo.points(spark, sf).withColumns({"sx": F.round("x"), "sy": F.round("y")})
    step = lambda x, y: G.distance(F.lag(x).over(w), F.lag(y).over(w), F.col(x), F.col(y))
    d = p.withColumn("raw", step("x", "y")).withColumn("snap", step("sx", "sy"))
    return d.select("traj_id", "seq", r(F.when(F.col("raw") > 0.1, F.col("snap") / (F.col("raw") + 0.1)).otherwise(F.lit(1.0))).alias("ratio"))


def filter_strategy_compare(spark: Spark, sf: str) -> Frame:
    """How many rows each rule keeps, and their mean error."""
    rules = {"all": F.lit(True), "confident": F.col("confidence") >= 0.5, "level": F.col("level") <= 30, "both": (F.col("confidence") >= 0.5) & (F.col("level") <= 30), "strict": F.col("confidence") >= 0.9}
    d = _scored(spark, sf).select("error", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("rule"))
    return d.groupBy("rule").agg(F.count("*").alias("n"), r(F.avg("error")).alias("mean"))


def sp_eu_abs_diff(spark: Spark, sf: str) -> Frame:
    """|way - straight line| over two lists of a user, cut to the shorter; statistics of those within a range."""
    d = _scored(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "error", "level"))).alias("v"))
    a = F.transform("v", lambda s: s["error"])
    b = F.transform(F.filter("v", lambda s: s["event_id"] % 3 != 0), lambda s: s["level"])
    n = F.least(F.size(a), F.size(b))
    d = d.select(F.explode(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.abs(x - y))).alias("d")).filter("d <= 40")
    return d.agg(F.count("*").alias("n"), r(F.avg("d")).alias("mean"), r(F.stddev_pop("d")).alias("std"), r(F.min("d")).alias("least"), r(F.median("d")).alias("median"), r(F.max("d")).alias("greatest"))


def error_ellipse(spark: Spark, sf: str) -> Frame:
    p = demo.points(spark, sf).withColumn("g", F.col("traj_id") % 7).withColumns({"dx": F.col("x") - F.round("x"), "dy": F.col("y") - F.round("y") + F.col("x") / 10})
    d = evaluation.error_ellipse(p, "dx", "dy", "g")
    return d.select("g", *(r(c).alias(c) for c in ("major", "minor", "angle")))


def error_by_sigma(spark: Spark, sf: str) -> Frame:
    p = demo.points(spark, sf).withColumn("e", F.abs(F.col("x") - F.round("x")))
    return p.groupBy(r("sde").alias("sigma")).agg(r(F.avg("e")).alias("mean"), r(F.percentile("e", 0.9)).alias("p90"))


def ecdf(spark: Spark, sf: str) -> Frame:
    w = Window.partitionBy("correct").orderBy("error")
    return _scored(spark, sf).select("event_id", r(F.cume_dist().over(w)).alias("share"))


def improvement_outliers(spark: Spark, sf: str) -> Frame:
    """Rows of which one method is better by more than the bound, best first."""
    d = _scored(spark, sf).withColumn("gain", F.col("level") - F.col("error")).filter("gain > 40")
    return d.orderBy(F.desc("gain"), "event_id").select("event_id", r("gain").alias("gain"))


def exact_path_accuracy(spark: Spark, sf: str) -> Frame:
    """Users whose list of events by time equals their list by number."""
    e = demo.table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("a"), F.array_sort(F.collect_list("event_id")).alias("b"))
    return e.select("user_id", (F.transform("a", lambda s: s["event_id"]) == F.col("b")).alias("exact"))


def credibility(spark: Spark, sf: str) -> Frame:
    e = F.col("event_id")
    v = F.when(e % 10 == 0, F.lit(float("-inf"))).when(e % 10 == 1, F.lit(0.5)).otherwise(-(e % 80).cast("double"))
    return demo.table(spark, sf, "events").select("event_id", F.round(evaluation.credibility(v) * 1e6, 4).alias("c"))


def per_trajectory_accuracy(spark: Spark, sf: str) -> Frame:
    """Accuracy by user without events of unknown truth; a missing or zero score counts as a half."""
    d = _scored(spark, sf).filter("event_id % 6 NOT IN (0, 5)").withColumn("w", F.coalesce(F.nullif(F.when(F.col("event_id") % 7 == 0, F.lit(0.0)).otherwise(F.col("confidence")), F.lit(0.0)), F.lit(0.5)))
    return d.groupBy("user_id").agg(F.count("*").alias("n"), r(F.avg("correct")).alias("accuracy"), r(F.avg("w")).alias("score"))


S = f"WITH {demo.SCORED}"
P = f"WITH {demo.POINTS}"
TIMED = "t AS (SELECT event_id, user_id, epoch(ts)::DOUBLE AS t FROM events)"

ORACLE_SQL = {
    "asof_nearest_join": f"WITH {TIMED}, o AS (SELECT user_id, t, min(event_id) AS other FROM t WHERE event_id % 3 <> 0 GROUP BY 1, 2), m AS (SELECT l.event_id, o.other, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(o.t - l.t), o.t) AS k FROM t l JOIN o ON o.user_id = l.user_id AND abs(o.t - l.t) <= 7200 WHERE l.event_id % 3 = 0) SELECT t.event_id, m.other FROM t LEFT JOIN m ON m.event_id = t.event_id AND k = 1 WHERE t.event_id % 3 = 0",
    "exact_or_rounded_join": "WITH l AS (SELECT event_id, user_id, (event_id % 500)::DOUBLE / 4::DOUBLE + 0.1::DOUBLE AS t FROM events), r AS (SELECT user_id, (event_id % 500)::DOUBLE / 4::DOUBLE + CASE WHEN event_id % 4 = 0 THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END AS t, event_id AS other FROM events WHERE event_id % 2 = 0), e AS (SELECT user_id, t, max(other) AS other FROM r GROUP BY 1, 2), q AS (SELECT user_id, round(t) AS t, max(other) AS other FROM r GROUP BY 1, 2) SELECT l.event_id, coalesce(e.other, q.other) AS other FROM l LEFT JOIN e ON e.user_id = l.user_id AND e.t = l.t LEFT JOIN q ON q.user_id = l.user_id AND q.t = round(l.t)",
    "full_outer_align": "WITH e AS (SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS k, event_id, event_id % 3 AS m FROM events), g AS (SELECT user_id, k, max(event_id) FILTER (m = 0) AS a, max(event_id) FILTER (m = 1) AS b, max(event_id) FILTER (m = 2) AS c FROM e GROUP BY 1, 2) SELECT user_id, k, (row_number() OVER (PARTITION BY user_id ORDER BY k) - 1)::BIGINT AS uni_seq, a, b, c FROM g",
    "truth_join": "WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), b AS (SELECT user_id, event_id AS truth, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS seq FROM events WHERE event_id % 5 <> 0) SELECT event_id, truth FROM a JOIN b USING (user_id, seq)",
    "interval_join": "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN o_orderkey IS NULL THEN NULL WHEN l_linenumber BETWEEN 3 AND 4 THEN o_orderkey % 89 + 100 WHEN l_linenumber <= o_orderkey % 5 + 1 THEN o_orderkey % 97 END AS edge FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey",
    "coalesce_left_join": f"SELECT c_custkey, {sql('coalesce(max(o_totalprice), any_value(c_acctbal))')} AS level FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "id_intersect": "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders",
    "id_except": "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0",
    "sort_by_id": "SELECT CASE WHEN c_custkey % 9 = 0 THEN 'x' || c_custkey ELSE c_custkey::VARCHAR END AS id FROM customer",
    "subsample": f"{P} SELECT traj_id, seq, event_id FROM points WHERE seq % 5 = 0",
    "error_stats": f"{S} SELECT correct::BIGINT AS correct, count(*)::BIGINT AS n, {sql('avg(error)')} AS mean, {sql('median(error)')} AS median, {sql('sqrt(avg(error * error))')} AS rmse, {sql('quantile_cont(error, 0.95)')} AS p95, {sql('stddev_samp(error)')} AS std, {sql('min(error)')} AS least, {sql('max(error)')} AS greatest FROM scored GROUP BY 1",
    "error_histogram": f"{S} SELECT (CASE WHEN error < 5 THEN 0 WHEN error < 10 THEN 1 WHEN error < 20 THEN 2 WHEN error < 50 THEN 3 ELSE 4 END)::BIGINT AS bin, count(*)::BIGINT AS n FROM scored GROUP BY 1",
    "reliability_bins": f"{S} SELECT least(floor(confidence * 10), 9)::BIGINT AS bin, count(*)::BIGINT AS n, {sql('avg(confidence)')} AS confidence, {sql('avg(correct)')} AS accuracy, {sql('abs(avg(confidence) - avg(correct))')} AS gap FROM scored GROUP BY 1",
    "ece": f"{S}, b AS (SELECT count(*) AS n, abs(avg(confidence) - avg(correct)) AS gap FROM scored GROUP BY least(floor(confidence * 10), 9)) SELECT {sql('sum(n * gap) / sum(n)')} AS ece, {sql('max(gap)')} AS mce FROM b",
    "brier_logloss": f"{S}, p AS (SELECT confidence, correct, least(greatest(confidence, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS p FROM scored) SELECT {sql('avg((confidence - correct) ** 2)')} AS brier, {sql('avg(-(correct * ln(p) + (1 - correct) * ln(1 - p)))')} AS logloss FROM p",
    "roc_curve": f"{S}, g AS (SELECT confidence AS score, sum(correct) AS p, sum(1 - correct) AS q FROM scored GROUP BY 1) SELECT {sql('score')} AS score, {sql('sum(p) OVER (ORDER BY score DESC) / sum(p) OVER ()')} AS tpr, {sql('sum(q) OVER (ORDER BY score DESC) / sum(q) OVER ()')} AS fpr FROM g",
    "roc_auc": f"{S}, g AS (SELECT confidence AS score, sum(correct)::DOUBLE AS p, sum(1 - correct)::DOUBLE AS q FROM scored GROUP BY 1), c AS (SELECT p, q, sum(p) OVER (ORDER BY score DESC) AS tp FROM g) SELECT {sql('sum(q * (tp - p / 2)) / (sum(p) * sum(q))')} AS auc FROM c",
    "accuracy_coverage": f"{S}, t AS (SELECT unnest({CUTS}::DOUBLE[]) AS threshold) SELECT {sql('threshold')} AS threshold, {sql('avg((confidence >= threshold)::INT)')} AS coverage, {sql('avg(correct) FILTER (confidence >= threshold)')} AS accuracy FROM scored, t GROUP BY threshold",
    "stanford_metrics": f"{S}, l AS (SELECT quantile_cont(error, 0.95) AS l FROM scored) SELECT {sql('max(l)')} AS alarm_limit, {sql('avg((error > level)::INT)')} AS p_md, {sql('avg((error > l)::INT)')} AS p_fa FROM scored, l",
    "segment_accuracy_rollup": f"{S} SELECT user_id, count(*)::BIGINT AS n, {sql('avg(correct)')} AS accuracy FROM scored GROUP BY ROLLUP (user_id)",
    "trust_separation": f"{S} SELECT {sql('avg(confidence) FILTER (correct = 1) - avg(confidence) FILTER (correct = 0)')} AS separation FROM scored",
    "ks_statistic": f"{S}, i AS (SELECT user_id % 4 AS g, error, row_number() OVER (PARTITION BY user_id % 4 ORDER BY error) / (count(*) OVER (PARTITION BY user_id % 4))::DOUBLE AS i FROM scored) SELECT g, {sql('max(abs(i - (1 - exp(-error / 2))))')} AS ks FROM i GROUP BY 1",
    "density_grid": f"{P} SELECT floor(x / 0.5)::BIGINT AS cx, floor(y / 0.5)::BIGINT AS cy, count(*)::BIGINT AS n FROM points GROUP BY 1, 2",
    "density_blur": f"{P}, g AS (SELECT floor(x / 0.5)::BIGINT AS cx, floor(y / 0.5)::BIGINT AS cy, count(*) AS n FROM points GROUP BY 1, 2), k AS (SELECT a.d AS dx, b.d AS dy, exp(-(a.d * a.d + b.d * b.d) / 2::DOUBLE) AS w FROM (SELECT unnest(range(-3, 4)) AS d) a, (SELECT unnest(range(-3, 4)) AS d) b) SELECT cx + dx AS cx, cy + dy AS cy, {sql('sum(n * w / (SELECT sum(w) FROM k))')} AS n FROM g, k GROUP BY 1, 2",
    "running_mean": f"{S} SELECT event_id, {sql('avg(CASE WHEN event_id % 4 <> 0 THEN error END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)')} AS mean FROM scored",
    "pl_coverage": f"{S}, u AS (SELECT avg((error <= level)::INT) AS share FROM scored GROUP BY user_id) SELECT count(*) FILTER (share = 1)::BIGINT AS every, count(*) FILTER (share = 0)::BIGINT AS none, count(*) FILTER (share > 0 AND share < 1)::BIGINT AS part, {sql('avg(share)')} AS mean FROM u",
    "smooth_ratio": f"{P}, d AS (SELECT traj_id, seq, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS raw, sqrt((round(x) - lag(round(x)) OVER w) ** 2 + (round(y) - lag(round(y)) OVER w) ** 2) AS snap FROM points WINDOW w AS (PARTITION BY traj_id ORDER BY seq)) SELECT traj_id, seq, {sql('CASE WHEN raw > 0.1 THEN snap / (raw + 0.1) ELSE 1 END')} AS ratio FROM d",
    "filter_strategy_compare": f"{S}, r AS (SELECT error, unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN confidence >= 0.5 THEN 'confident' END, CASE WHEN level <= 30 THEN 'level' END, CASE WHEN confidence >= 0.5 AND level <= 30 THEN 'both' END, CASE WHEN confidence >= 0.9 THEN 'strict' END], lambda x: x IS NOT NULL)) AS rule FROM scored) SELECT rule, count(*)::BIGINT AS n, {sql('avg(error)')} AS mean FROM r GROUP BY 1",
    "sp_eu_abs_diff": f"{S}, a AS (SELECT user_id, error, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM scored), b AS (SELECT user_id, level, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM scored WHERE event_id % 3 <> 0), d AS (SELECT abs(error - level) AS d FROM a JOIN b USING (user_id, k) WHERE abs(error - level) <= 40) SELECT count(*)::BIGINT AS n, {sql('avg(d)')} AS mean, {sql('stddev_pop(d)')} AS std, {sql('min(d)')} AS least, {sql('median(d)')} AS median, {sql('max(d)')} AS greatest FROM d",
    "error_ellipse": f"{P}, d AS (SELECT traj_id % 7 AS g, x - round(x) AS dx, y - round(y) + x / 10 AS dy FROM points), v AS (SELECT g, var_samp(dx) AS a, var_samp(dy) AS b, covar_samp(dx, dy) AS c FROM d GROUP BY 1) SELECT g, {sql('2 * sqrt((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c))')} AS major, {sql('2 * sqrt(greatest((a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c), 0))')} AS minor, {sql('degrees(0.5 * atan2(2 * c, a - b))')} AS angle FROM v",
    "error_by_sigma": f"{P} SELECT {sql('sde')} AS sigma, {sql('avg(abs(x - round(x)))')} AS mean, {sql('quantile_cont(abs(x - round(x)), 0.9)')} AS p90 FROM points GROUP BY 1",
    "ecdf": f"{S} SELECT event_id, {sql('cume_dist() OVER (PARTITION BY correct ORDER BY error)')} AS share FROM scored",
    "improvement_outliers": f"{S} SELECT event_id, {sql('level - error')} AS gain FROM scored WHERE level - error > 40",
    "exact_path_accuracy": "WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, bool_and(a = b) AS exact FROM n GROUP BY 1",
    "credibility": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 1000000 ELSE round(1e6::DOUBLE * exp(greatest(-(event_id % 80)::DOUBLE, -50)), 4) END::DOUBLE AS c FROM events",
    "per_trajectory_accuracy": f"{S} SELECT user_id, count(*)::BIGINT AS n, {sql('avg(correct)')} AS accuracy, {sql('avg(CASE WHEN event_id % 7 = 0 OR confidence = 0 THEN 0.5 ELSE confidence END)')} AS score FROM scored WHERE event_id % 6 NOT IN (0, 5) GROUP BY 1",
}

QUERIES = {f.__name__: f for f in (
    asof_nearest_join, exact_or_rounded_join, full_outer_align, truth_join, interval_join, coalesce_left_join, id_intersect, id_except, sort_by_id, subsample, error_stats, error_histogram, reliability_bins, ece,
    brier_logloss, roc_curve, roc_auc, accuracy_coverage, stanford_metrics, segment_accuracy_rollup, trust_separation, ks_statistic, density_grid, density_blur, running_mean, pl_coverage, smooth_ratio,
    filter_strategy_compare, sp_eu_abs_diff, error_ellipse, error_by_sigma, ecdf, improvement_outliers, exact_path_accuracy, credibility, per_trajectory_accuracy,
)}
