"""Hexagonal cells against plain geometry, and matching to them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import hexagons as H
from wayfold.operators.cells import cell_rows, match_cells

SIZE = 0.3


def centre(q, r, level=0):
    z = complex(q + r / 2, r * math.sqrt(3) / 2) * complex(2.5, math.sqrt(3) / 2) ** level
    return SIZE * math.sqrt(3) * z


@pytest.fixture(scope="module")
def spots(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(400)], "i int, x double, y double")


@pytest.mark.parametrize("level", [0, 1, 3])
def test_cells_hold_their_points(spots, level):
    c = H.at(F.col("x"), F.col("y"), SIZE, level)
    for row in spots.select("x", "y", c.alias("c"), H.middle(c, SIZE, level).alias("m"), H.outline(c, SIZE, level).alias("o")).collect():
        here, m = complex(row.x, row.y), complex(row.m.x, row.m.y)
        assert abs(m - centre(row.c.q, row.c.r, level)) < 1e-9
        far = SIZE * 7 ** (level / 2)
        assert abs(here - m) <= far * (1 + 1e-9 if level == 0 else 1.6)
        assert len(row.o) == 7 and row.o[0] == row.o[6]
        assert all(abs(abs(complex(p.x, p.y) - m) - far) < 1e-9 for p in row.o)
        if level == 0:  # no other centre is nearer
            assert all(abs(here - m) <= abs(here - centre(row.c.q + q, row.c.r + r)) + 1e-9 for q, r in H.AROUND)


def test_families(spots):
    c = H.at(F.col("x"), F.col("y"), SIZE)
    p = H.parent(c)
    d = spots.select(c.alias("c"), p.alias("p"), H.children(p).alias("all"), F.transform(H.children(p), H.parent).alias("back"))
    for row in d.collect():
        assert row.c in row["all"] and len(set(row["all"])) == 7
        assert set(row.back) == {row.p}


def test_numbers_and_disks(spots):
    c = H.at(F.col("x"), F.col("y"), SIZE)
    n = H.number(c, 4)
    d = spots.select(c.alias("c"), H.from_number(n).alias("again"), H.level_of(n).alias("level"), H.disk(c, 2).alias("disk"), H.neighbours(c).alias("around"), F.transform(H.disk(c, 2), lambda o: H.steps(o, c)).alias("far"))
    for row in d.collect():
        assert row.again == row.c and row.level == 4
        assert len(set(row.disk)) == 19 and set(row.around) < set(row.disk)
        assert sorted(row.far) == [0] + [1] * 6 + [2] * 12


def test_nulls_and_range(spark):
    d = spark.createDataFrame([(None, 1.0), (1.0, None), (1e12, 0.0)], "x double, y double")
    c = H.at(F.col("x"), F.col("y"), SIZE)
    got = d.select(c.alias("c"), H.number(c).alias("n"), H.parent(c).alias("p"), H.children(c).alias("k"), H.outline(c, SIZE).alias("o")).collect()
    assert [tuple(r) for r in got[:2]] == [(None,) * 5] * 2
    assert got[2].n is None and got[2].c is not None


def test_paths_are_connected_and_straight(spots):
    a, b = H.at(F.col("x"), F.col("y"), SIZE), H.at(-F.col("y") * 2, F.col("x") / 3, SIZE)
    for row in spots.select(a.alias("a"), b.alias("b"), H.path(a, b).alias("way"), H.steps(a, b).alias("n")).collect():
        assert row.way[0] == row.a and row.way[-1] == row.b and len(row.way) == row.n + 1
        for s, t in zip(row.way, row.way[1:], strict=False):
            assert (t.q - s.q, t.r - s.r) in H.AROUND
        start, end = centre(*row.a), centre(*row.b)
        for c in row.way:
            if row.n:
                off = ((centre(*c) - start) * (end - start).conjugate()).imag / abs(end - start)
                assert abs(off) <= SIZE * (1 + 1e-3)


def test_matching(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 0.01, 0.01), (1, 2, 3.0, 0.1), (1, 3, None, 1.0), (1, 4, 3.0, 0.1), (2, 0, -1.0, -1.0)]
    p = spark.createDataFrame(rows, "traj_id long, seq long, x double, y double")
    full, bare = match_cells(p, SIZE).collect(), match_cells(p, SIZE, fill=False).collect()
    assert {(r.traj_id, r.seq, r.cell) for r in bare} == {(r.traj_id, r.seq, r.cell) for r in full if (r.traj_id, r.seq, r.step) in {(1, 0, 0), (1, 2, 6), (2, 0, 0)}}
    assert sorted(r.step for r in full if r.traj_id == 1 and r.seq == 2) == [1, 2, 3, 4, 5, 6]
    texts = {r.traj_id: r for r in cell_rows(match_cells(p, SIZE), SIZE).collect()}
    assert len(texts[1].cells.split(",")) == 7 and texts[1].geom.count("((") == 7 and texts[2].geom.startswith("MULTIPOLYGON(((")
    assert match_cells(p.limit(0), SIZE).count() == 0
