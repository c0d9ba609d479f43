"""Centroid clustering with Exponion search, exact on integer vectors.

Every vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to any
other. A round moves the bounds with the centroids. Where the upper bound stays below the lower one, or below half
the way to the nearest other centroid, nothing is computed. Else the distance u to the vector's centroid is computed,
and if the bounds still don't decide, only centroids inside the ball of radius 2 u + s around that centroid are
scanned (s: the way to its nearest other one): the first ones of its list of centroids sorted by distance. The
nearest and the second nearest lie inside. The radius is inclusive and decisions are strict, so ties are all seen
and go to the smaller number.

Vectors are never shuffled: a round is one pass that writes the vectors with their bounds to the shared folder, and
one that sums each task's vectors by cluster before Spark adds up those sums. Centroids (k rows) go through the driver.

Components are scaled to integers first, floor(scale * x); sums, squares and distances are exact. A vector is left
out if it is null, has another length, a null or non-finite component, or one of 2^28 and more after scaling (its
squared distances wouldn't fit a long). Fewer vectors than k give fewer centroids; none give no rows. Repeated
vectors and ids stay, each row with its result; a null id counts as empty text in the order of the start. Sums of
distances that don't fit a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import Scratch, arrow_map, dropped, stored

#: Relative slack that covers the rounding of bounds; largest component; largest one of exact float products.
SLACK, MOST, MOST_FLOAT = 1e-9, 1 << 28, 1 << 22
#: Vectors that are compared at once.
AT_ONCE = 1 << 13

STATE = "v array<int>, cluster int, upper double, lower double, distance long, scanned long"


def integer_vectors(df: DataFrame, dims: int, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): usable vectors as integers."""
    x = F.col(vector).cast("array<double>")
    fits = (F.size(x) == dims) & F.forall(x, lambda c: F.coalesce(F.abs(c * scale) < MOST, F.lit(False)))  # NaN is above all numbers
    return df.filter(F.col(vector).isNotNull()).filter(fits).select(F.col(key).alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def start_rank(prefix: str, key: str = "id") -> Column:
    return F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)


class Centroids:
    """k integer centroids, the ways between them, and each one's list of all, nearest first."""

    def __init__(self, c: np.ndarray, before: Centroids | None = None):
        self.c = c
        self.apart = np.sqrt(squares(c, c).astype(np.float64))
        order = np.argsort(self.apart, axis=1, kind="stable")
        # a centroid comes first in its own list, whatever lies in the same place
        self.order = np.array([np.concatenate([[i], row[row != i]]) for i, row in enumerate(order)], np.int64).reshape(len(c), len(c))
        self.ways = np.take_along_axis(self.apart, self.order, axis=1)
        self.gap = self.ways[:, 1] if len(c) > 1 else np.full(len(c), np.inf)
        moved = np.zeros(len(c)) if before is None else np.sqrt(((c - before.c) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        self.moved = moved
        top = np.argsort(moved)[::-1][:2]
        #: The farthest that any other centroid moved.
        self.others = np.array([moved[top[0]] if i != top[0] else (moved[top[1]] if len(c) > 1 else 0.0) for i in range(len(c))])


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) <= MOST_FLOAT:  # all intermediate numbers are integers below 2^53
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def two_nearest(d: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest (ties: the smaller number), and the second smallest distance."""
    by_number = np.argsort(numbers)
    d, numbers = d[:, by_number], numbers[by_number]
    at = d.argmin(1)
    first = d[np.arange(len(d)), at]
    if d.shape[1] == 1:
        return numbers[at], first, np.full(len(d), np.inf)
    rest = d.copy()
    rest[np.arange(len(d)), at] = np.iinfo(np.int64).max
    return numbers[at], first, np.sqrt(rest.min(1).astype(np.float64))


def assign(v: np.ndarray, own: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, ...]:
    """(cluster, upper, lower, scanned) of integer vectors after the centroids' move; own: the centroids so far."""
    k, n = len(centroids.c), len(v)
    if own is None:
        near, d, second = two_nearest(squares(v, centroids.c), np.arange(k))
        return near, np.sqrt(d.astype(np.float64)), second, np.full(n, k)
    own, upper, lower = own.copy(), upper + centroids.moved[own], lower - centroids.others[own]
    scanned = np.zeros(n, np.int64)
    bound = np.maximum(lower, centroids.gap[own] / 2)
    open_ = np.flatnonzero(~(upper * (1 + SLACK) < bound * (1 - SLACK)))
    upper[open_] = np.sqrt(((v[open_] - centroids.c[own[open_]]) ** 2).sum(1).astype(np.float64))
    scanned[open_] += 1
    open_ = open_[~(upper[open_] * (1 + SLACK) < bound[open_] * (1 - SLACK))]
    radius = (2 * upper[open_] + centroids.gap[own[open_]]) * (1 + SLACK)
    if k == 1:
        return own, upper, lower, scanned
    home = own[open_]
    for c in np.unique(home):
        rows, ball = open_[home == c], radius[home == c]
        inside = np.searchsorted(centroids.ways[c], ball, side="right")
        inside = np.maximum(inside, 2)
        step = np.minimum(k, 2 ** np.ceil(np.log2(inside)).astype(np.int64))  # rows of like balls are scanned together
        for s in np.unique(step):
            these = rows[step == s]
            most = int(inside[step == s].max())
            numbers = centroids.order[c][:most]
            own[these], d, lower[these] = two_nearest(squares(v[these], centroids.c[numbers]), numbers)
            upper[these] = np.sqrt(d.astype(np.float64))
            scanned[these] += most
    return own, upper, lower, scanned


def with_id(kind: str) -> str:
    return f"id {kind}, {STATE}"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def assigned(vectors: DataFrame, dims: int, centroids: Centroids, first: bool, last: bool) -> DataFrame:
    """The vectors with centroids and bounds; exact distances in the last pass."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # k centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(at, AT_ONCE)
                v = _matrix(b.column("v"), dims)
                own = None if first else b.column("cluster").to_numpy().astype(np.int64)
                bounds = [np.zeros(0)] * 2 if first else [b.column(c).to_numpy().copy() for c in ("upper", "lower")]
                own, upper, lower, scanned = assign(v, own, *bounds, shared.value)
                before = 0 if first else b.column("scanned").to_numpy()
                d = ((v - shared.value.c[own]) ** 2).sum(1) if last else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("v"), *(pa.array(x, t) for x, t in ((own, pa.int32()), (upper, pa.float64()), (lower, pa.float64()), (d, pa.int64()), (scanned + before, pa.int64())))],
                    ["id", "v", "cluster", "upper", "lower", "distance", "scanned"],
                )

    return arrow_map(vectors, run, with_id(vectors.schema["id"].dataType.simpleString()))


def cluster_sums(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Cluster -> number and componentwise sum of its vectors; tasks sum their own first. A row for each cluster and component comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for b in batches:
            v, own = _matrix(b.column("v"), dims), b.column("cluster").to_numpy()
            for c in np.unique(own).tolist():
                mine = v[own == c]
                n[c] = n.get(c, 0) + len(mine)
                total[c] = total.get(c, 0) + mine.sum(0)
        columns = np.repeat(list(n), dims), np.tile(np.arange(dims), len(n)), np.repeat(list(n.values()), dims), np.concatenate([np.zeros(0, np.int64), *total.values()])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(columns, (np.int32, np.int32, np.int64, np.int64), strict=True)], ["cluster", "dim", "n", "s"])

    sums = arrow_map(state.select("v", "cluster"), run, "cluster int, dim int, n long, s long")
    out: dict[int, tuple[int, list[int]]] = {}
    for c, _, n, s in sorted(sums.groupBy("cluster", "dim").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)"))).collect()):
        out.setdefault(c, (n, []))[1].append(int(s))
    return out


def exponion(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, prefix: str = "2:", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256, scanned) of every usable vector.

    Centroids start as the k vectors of smallest SHA-256 of prefix and key (equal ones by their components). scanned:
    distances between the vector and a centroid that were computed in all passes.
    """
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        state = scratch.stored(integer_vectors(df, dims, scale, key, vector))
        begun = [r["v"] for r in state.orderBy(start_rank(prefix), "v").limit(k).collect()]
        centroids = Centroids(np.array(begun, np.int64).reshape(-1, dims))
        for turn in range(rounds + 1 if begun else 0):
            after = scratch.stored(assigned(state, dims, centroids, turn == 0, turn == rounds))
            dropped(state)
            state = after
            if turn < rounds:
                new = centroids.c.copy()
                for c, (n, sums) in cluster_sums(state, dims).items():
                    new[c] = [s // n for s in sums]
                centroids = Centroids(new, centroids)
        if not begun:
            state = spark.createDataFrame([], with_id(df.schema[key].dataType.simpleString()))
        inertia = {r[0]: int(r[1]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
        fits = lambda x: x if x < 1 << 63 else None
        facts = [(c, fits(inertia.get(c, 0)), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.c.tolist())]
        known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        out = state.join(F.broadcast(known), "cluster")  # k rows
        return stored(out.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned"))
