"""Path tables: repaired ones equal ones built anew, look-ups don't move the table, broken rows are reported."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import matching, routing
from wayfold.operators.path_table import PathTable, faults


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(40), rng.randrange(40), rng.choice([0.5, 1.0, 1.0, 2.5])) for i in range(130)]
    return spark.createDataFrame([r for r in rows if r[1] != r[2]], "edge_id long, source long, target long, length double").cache()


def rows_of(df):
    return sorted((r.source, r.target, r.distance, r.path) for r in df.select("source", "target", "distance", "path").collect())


def test_repaired_equals_built_anew(spark, edges):
    new = edges.filter("edge_id % 9 = 0")
    table = PathTable(edges.filter("edge_id % 9 <> 0"), 3.0)
    first = table.search.known().count()
    redone = table.add_edges(new)
    want = rows_of(PathTable(edges, 3.0).ways())
    assert rows_of(table.ways()) == want
    assert 0 < redone < first
    held = table.search.known().count()
    assert rows_of(table.compacted().ways()) == want
    assert table.search.known().count() < held == first + redone
    assert table.add_edges(new.filter("false")) == 0 and rows_of(table.ways()) == want
    table.dropped()


def test_further_sources(spark, edges):
    few = edges.select("source").filter("source < 10")
    table = PathTable(edges, 2.0, few)
    assert table.ways().filter("source >= 10").count() == 0
    assert table.add_sources(edges.select("source")) > 0
    assert rows_of(table.ways()) == rows_of(PathTable(edges, 2.0).ways())


def test_look_up_moves_only_what_asks(spark, edges):
    table = PathTable(edges, 2.0)
    pairs = spark.createDataFrame([(1, 1, 2, 3, 4, 1.0, 0.5, 0.5, 0.1)], "edge_id_a long, edge_id_b long, target_a long, source_b long, cand_a long, length_a double, offset_a double, offset_b double, eu double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = matching.path_lengths(pairs, table.ways(), 0.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    scan = plan.index("Bucketed: true")
    above = plan[:scan].split("\n")
    depth = len(above[-1]) - len(above[-1].lstrip(" :+-"))
    ancestors = []
    for line in reversed(above[:-1]):
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            ancestors.append(line.strip(" :+-"))
            depth = d
    assert any("Join" in a for a in ancestors), plan
    below = ancestors[: next(i for i, a in enumerate(ancestors) if "Join" in a)]
    assert not any(a.startswith("Exchange") for a in below), plan


def test_faults_are_reported(spark, edges):
    od = routing.od_table(edges, 3.0).drop("path")
    assert faults(od, edges).count() == 0
    row = od.orderBy(F.desc("distance"), "source", "target").first()
    same = (F.col("source") == row.source) & (F.col("target") == row.target)
    spoil = lambda c, v: od.withColumn(c, F.when(same, F.lit(v)).otherwise(F.col(c)))
    found = lambda d: {r.fault for r in faults(d, edges).filter(same).collect()}
    assert found(spoil("distance", row.distance + 0.1)) == {"rest"}
    assert found(spoil("distance", -1.0)) == {"negative", "rest"}
    assert "first edge" in found(spoil("next_e", 10_000))
    assert found(spoil("prev_n", 10_000)) == {"last node"}
    assert found(spoil("next_n", None)) == {"null"}
    assert found(od.unionByName(od.filter(same))) == {"twice"}
    loop = od.unionByName(od.filter(same).withColumn("target", F.col("source")))
    assert "loop" in {r.fault for r in faults(loop, edges).collect()}
