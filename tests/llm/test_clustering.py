"""Exponion search against plain rounds that compute every distance."""

import hashlib
import math
import random

import numpy as np
import pytest

from wayfold.llm import clustering
from wayfold.llm.common import table


def plain(rows: list[tuple], k: int, rounds: int, dims: int) -> list[tuple]:
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(256 * x) < 1 << 28 for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def nearest(v: list[int]) -> tuple[int, int]:
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in kept]
        for c in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [nearest(v) for _, v in kept]
    total = {c: sum(d for o, d in last if o == c) for c in range(len(cents))}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(i), c, d, total[c], sum(total.values()), hashes[c]) for (i, _), (c, d) in zip(kept, last, strict=True))


def rows_of(df) -> list[tuple]:
    return sorted((str(r[0]), *r[1:6]) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS id", "3 AS cluster")


def test_query_equals_plain(spark, small):
    rows = [tuple(r) for r in table(spark, small, "embeddings").select("vec_id", "embedding").collect()]
    assert rows_of(clustering.exponion(table(spark, small, "embeddings"))) == plain(rows, 40, 5, 64)


@pytest.mark.parametrize("k,spread", [(1, 9), (2, 1), (7, 2), (25, 3), (300, 9)])
def test_ties_and_copies(spark, k, spread):
    """Few distinct integer places, so distances tie and centroids fall together."""
    rng = random.Random(k)
    rows = [(i // 2, [rng.randint(-spread, spread) / 256 for _ in range(3)]) for i in range(240)] + [(7, [0.0, 0.0, 0.0])] * 60
    got = clustering.exponion(frame(spark, rows).repartition(3), k, 6, 3)
    assert rows_of(got) == plain(rows, k, 6, 3)


def test_unusable_vectors_are_left_out(spark):
    good = [(i, [i / 100, -i / 7]) for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [1.0, float("inf")]), (106, [-float("inf"), 0.0]), (107, [1e300, 0.0])]
    rows = [*good, *bad, (None, [0.5, 0.25]), (3, [0.03, -3 / 7]), (200, [9e5, -1e6]), (201, [-9e5, 1e6])]
    assert rows_of(clustering.exponion(frame(spark, rows), 4, 3, 2)) == plain(rows, 4, 3, 2)


def test_empty(spark):
    got = clustering.exponion(frame(spark, [(1, None)]), 4, 3, 2)
    assert got.count() == 0 and dict(got.dtypes)["cluster"] == "int" and dict(got.dtypes)["inertia"] == "bigint"


def test_bounds_save_distances(spark):
    """Far fewer distances than vectors x centroids x passes, on vectors in groups."""
    rng = np.random.default_rng(3)
    places = rng.uniform(-4, 4, (30, 8))
    rows = [(i, (places[i % 30] + rng.normal(0, 0.05, 8)).tolist()) for i in range(3000)]
    got = clustering.exponion(frame(spark, rows), 30, 6, 8)
    assert got.agg({"scanned": "sum"}).first()[0] < 0.5 * 3000 * 30 * 7
    assert rows_of(got) == plain(rows, 30, 6, 8)


@pytest.mark.parametrize("top", [1 << 10, 1 << 27])
def test_squares_are_exact(top):
    rng = np.random.default_rng(1)
    x, c = rng.integers(-top, top, (20, 64)), rng.integers(-top, top, (5, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in c] for r in x]
    assert clustering.squares(x, c).tolist() == want
