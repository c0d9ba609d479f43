"""Geometry on long lines: right against a plain version, and in time that grows about linearly."""

import bisect
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry as G


def line_of(n, seed=1):
    rng = random.Random(seed)
    out = [(0.0, 0.0)]
    while len(out) < n:
        x, y = out[-1]
        out.append((x, y) if rng.random() < 0.05 else (x + rng.uniform(-1, 2), y + rng.uniform(-1, 1)))
    return out


def frame(spark, *lines):
    return spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "id long, line array<struct<x:double,y:double>>")


def plain_at(line, offset):
    ends = [0.0]
    for p, q in zip(line, line[1:], strict=False):
        ends.append(ends[-1] + math.dist(p, q))
    if offset <= 0:
        return line[0]
    if offset >= ends[-1]:
        return line[-1]
    i = bisect.bisect_left(ends, offset, 1)
    share = (offset - ends[i - 1]) / (ends[i] - ends[i - 1])
    return tuple(a + share * (b - a) for a, b in zip(line[i - 1], line[i], strict=True))


@pytest.mark.parametrize("n", [2, 129, 300])
def test_equal_to_plain(spark, n):
    line = line_of(n)
    total = sum(math.dist(p, q) for p, q in zip(line, line[1:], strict=False))
    offsets = [-1.0, total * 0.3, total]
    d = frame(spark, line).select(*(G.locate("line", F.lit(o)).alias(f"o{i}") for i, o in enumerate(offsets)), G.substring("line", F.lit(total * 0.2), F.lit(total * 0.9)).alias("part"), G.split_every("line", F.lit(total / 7)).alias("pieces"), G.without_repeats("line").alias("kept"))
    r = d.first()
    for i, o in enumerate(offsets):
        assert (r[f"o{i}"].x, r[f"o{i}"].y) == pytest.approx(plain_at(line, o))
    ends = [0.0]
    for p, q in zip(line, line[1:], strict=False):
        ends.append(ends[-1] + math.dist(p, q))
    want = [plain_at(line, total * 0.2), *(p for p, e in zip(line[1:], ends[1:], strict=True) if total * 0.2 < e < total * 0.9), plain_at(line, total * 0.9)]
    assert [v for p in r.part for v in (p.x, p.y)] == pytest.approx([v for p in want for v in p])
    assert len(r.pieces) in (7, 8)
    whole = sum(math.dist((p.x, p.y), (q.x, q.y)) for piece in r.pieces for p, q in zip(piece, piece[1:], strict=False))
    assert whole == pytest.approx(total)
    assert [(p.x, p.y) for p in r.kept] == [p for i, p in enumerate(line) if not i or p != line[i - 1]]


def test_lines_without_segments(spark):
    d = frame(spark, [(1.0, 2.0)], [], None, [(3.0, 3.0), (3.0, 3.0)])
    got = d.filter("size(line) > 0").orderBy("id").select(G.without_repeats("line").alias("kept"), G.measured("line").alias("m"), G.locate("line", F.lit(1.0)).alias("at")).collect()
    assert [len(r.kept) for r in got] == [1, 1] and [len(r.m) for r in got] == [0, 1] and [(r["at"].x, r["at"].y) for r in got] == [(1.0, 2.0), (3.0, 3.0)]
    empty = d.filter("id IN (1, 2)").orderBy("id").select(G.without_repeats("line").alias("kept"), G.measured("line").alias("m")).collect()
    assert [(r.kept, r.m) for r in empty] == [([], []), (None, None)]


def test_long_lines_take_about_linear_time(spark):
    def seconds(n):
        d = frame(spark, line_of(n)).cache()
        d.count()
        best = math.inf
        for _ in range(2):
            began = time.perf_counter()
            d.select(F.size(G.split_every("line", F.lit(0.7))), G.locate("line", F.lit(n / 2.0)), F.size(G.without_repeats("line")), F.size(G.points_every("line", F.lit(0.5)))).collect()
            best = min(best, time.perf_counter() - began)
        return best

    seconds(100)
    short, long = seconds(4000), seconds(16000)
    assert long < 8 * short + 1 and long < 20
