"""Satellite geometry and integrity, epoch by epoch: dilution of precision, weighted position fixes, fault exclusion.

An epoch has a few dozen satellites at most. Rows come sorted by epoch in Arrow batches, and all epochs of a chunk that
have equally many satellites are one stack of matrices, so no epoch costs a call of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.shared import by_trajectory, importable

#: Normal quantile of the false-alarm rate 1e-5, exclusions tried, satellites that must remain, DOP of a singular geometry.
Z_FALSE_ALARM, MOST_EXCLUDED, LEAST_LEFT, NO_DOP = 4.264890793922825, 3, 5, 20.0
#: Rows that are worked out together, besides those of an epoch that has begun.
TOGETHER = 1 << 16

DOP = "epoch long, n int, hdop double, pdop double"
FIX = "epoch long, n int, east double, north double, up double, clock double, sse double, threshold double, passed boolean, excluded int, hpl double"


def directions(azimuth: np.ndarray, elevation: np.ndarray) -> np.ndarray:
    """Rows (east, north, up, 1) of the geometry matrix, angles in degrees."""
    a, e = np.radians(azimuth), np.radians(elevation)
    return np.stack([np.cos(e) * np.sin(a), np.cos(e) * np.cos(a), np.sin(e), np.ones(np.shape(a))], axis=-1)


def cofactors(g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse normal matrices of geometries (epochs, n, 4) with weights (epochs, n), and which of the epochs have one."""
    m = g.transpose(0, 2, 1) @ (w[:, :, None] * g)
    good = np.isfinite(m).all((1, 2)) & (g.shape[1] >= 4)
    good[good] = np.linalg.cond(m[good]) < 1e12
    q = np.zeros_like(m)
    q[good] = np.linalg.inv(m[good])
    return q, good


def whole_epochs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by epoch put together so that no epoch is cut."""
    held, n, least = [], 0, TOGETHER
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = int(_starts(*_keys(t))[-1])
        if last:
            yield t.slice(0, last)
        held, n = t.slice(last).to_batches(), len(t) - last
        least = max(TOGETHER, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _keys(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Epochs, and which of them are null."""
    c = t.column("epoch")
    return c.fill_null(0).to_numpy(), c.is_null().to_numpy()


def _starts(epoch: np.ndarray, null: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (epoch[1:] != epoch[:-1]) | (null[1:] != null[:-1])]))


def by_epoch(df: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """run(counts, stack): a row's fields but `epoch` for each epoch. stack(column, n): the column's values in all epochs of n rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_epochs(batches):
            epoch, null = _keys(t)
            starts = _starts(epoch, null)
            counts = np.diff(np.concatenate([starts, [len(epoch)]]))
            values = {c: t.column(c).to_numpy().astype(np.float64) for c in columns}
            fields = run(counts, lambda c, n: values[c][starts[counts == n][:, None] + np.arange(n)])  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(epoch[starts], mask=null[starts]), *fields], names=names)

    rows = df.select(F.col("epoch").cast("long").alias("epoch"), *(F.col(c).cast("double").alias(c) for c in columns))
    return importable(by_trajectory(rows, "epoch").sortWithinPartitions("epoch", *columns)).mapInArrow(chunks, schema)


def dop(sats: DataFrame) -> DataFrame:
    """(epoch, n, hdop, pdop) of satellites (epoch, azimuth, elevation)."""

    def run(counts: np.ndarray, stack) -> list[pa.Array]:
        h, p = np.full(len(counts), NO_DOP), np.full(len(counts), NO_DOP)
        for n in np.unique(counts):
            g = directions(stack("azimuth", n), stack("elevation", n))
            q, good = cofactors(g, np.ones(g.shape[:2]))
            at = np.flatnonzero(counts == n)[good]
            h[at], p[at] = np.sqrt(q[good, 0, 0] + q[good, 1, 1]), np.sqrt(q[good, 0, 0] + q[good, 1, 1] + q[good, 2, 2])
        return [pa.array(counts, pa.int32()), pa.array(h), pa.array(p)]

    return by_epoch(sats, ["azimuth", "elevation"], run, DOP)


def threshold(degrees: int) -> float:
    """Chi-square quantile (Wilson-Hilferty) of the false-alarm rate; infinite without redundancy."""
    if degrees <= 0:
        return math.inf
    return degrees * (1 - 2 / (9 * degrees) + Z_FALSE_ALARM * math.sqrt(2 / (9 * degrees))) ** 3


def solve(g: np.ndarray, y: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted fixes, sums of squared residuals, normalised residuals and slope-based horizontal levels of a stack of epochs (epochs, n, ...), and which of them aren't singular."""
    with np.errstate(divide="ignore", invalid="ignore"):
        w = 1 / sigma**2
        q, good = cofactors(g, w)
        a = q @ (g.transpose(0, 2, 1) * w[:, None, :])
        x = (a @ y[:, :, None])[:, :, 0]
        rest = y - (g @ x[:, :, None])[:, :, 0]
        free = np.maximum(1 - np.einsum("mij,mji->mi", g, a), 1e-12)
        slope = np.sqrt(a[:, 0] ** 2 + a[:, 1] ** 2) * sigma / np.sqrt(free)
        limit = threshold(y.shape[1] - 4)
        hpl = slope.max(1) * math.sqrt(limit) if math.isfinite(limit) else np.full(len(y), math.inf)
        return x, (w * rest * rest).sum(1), np.abs(rest) / (sigma * np.sqrt(free)), hpl, good


class Fixes:
    """Fixes of epochs, as they are settled; without a fix its values stay NaN."""

    def __init__(self, n: int):
        self.n, self.excluded, self.passed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        self.found, self.x, self.sse, self.threshold, self.hpl = np.zeros(n, bool), np.zeros((n, 4)), np.zeros(n), np.zeros(n), np.zeros(n)

    def take(self, stacks: dict[int, tuple]) -> Fixes:
        """stacks: by number of satellites the epochs' places, geometries, residuals and sigmas. Solves, and while an
        epoch's residuals are too large leaves out its satellite with the largest normalised one."""
        for n in range(max(stacks, default=0), 0, -1):
            if n not in stacks:
                continue
            at, g, y, sigma = stacks.pop(n)
            x, sse, share, hpl, good = solve(g, y, sigma)
            limit = threshold(n - 4)
            passed = good & (sse <= limit)
            done = ~good | passed | (self.excluded[at] == MOST_EXCLUDED) | (n - 1 < LEAST_LEFT)
            end, own = at[done], good[done]
            self.n[end], self.threshold[end], self.passed[end], self.found[end] = n, limit, passed[done], own
            self.x[end], self.sse[end], self.hpl[end] = x[done], sse[done], hpl[done]
            if not done.all():
                rest = np.flatnonzero(~done)
                kept = np.ones((len(rest), n), bool)
                kept[np.arange(len(rest)), share[rest].argmax(1)] = False
                self.excluded[at[rest]] += 1
                less = (at[rest], g[rest][kept].reshape(-1, n - 1, 4), y[rest][kept].reshape(-1, n - 1), sigma[rest][kept].reshape(-1, n - 1))
                stacks[n - 1] = tuple(np.concatenate(p) for p in zip(stacks[n - 1], less, strict=True)) if n - 1 in stacks else less
        return self


def fix_with_exclusion(g: np.ndarray, y: np.ndarray, sigma: np.ndarray) -> tuple:
    """The fix of one epoch, as in FIX without the epoch."""
    f = Fixes(1).take({len(y): (np.zeros(1, np.int64), g[None], y[None], sigma[None])})
    values = [*map(float, f.x[0]), float(f.sse[0])] if f.found[0] else [None] * 5
    return int(f.n[0]), *values, float(f.threshold[0]), bool(f.passed[0]), int(f.excluded[0]), float(f.hpl[0]) if f.found[0] else None


def position_fixes(sats: DataFrame) -> DataFrame:
    """Fixes of satellites (epoch, azimuth, elevation, residual, sigma): residuals of a first guess, solved for its error."""

    def run(counts: np.ndarray, stack) -> list[pa.Array]:
        f = Fixes(len(counts)).take({int(n): (np.flatnonzero(counts == n), directions(stack("azimuth", n), stack("elevation", n)), stack("residual", n), stack("sigma", n)) for n in np.unique(counts)})
        known = lambda v: pa.array(v, mask=~f.found)
        return [
            pa.array(f.n, pa.int32()), *(known(np.ascontiguousarray(c)) for c in f.x.T), known(f.sse), pa.array(f.threshold), pa.array(f.passed), pa.array(f.excluded, pa.int32()), known(f.hpl),
        ]

    return by_epoch(sats, ["azimuth", "elevation", "residual", "sigma"], run, FIX)
