"""Epochs of all sizes in stacks, in few calls, against one epoch at a time."""

import numpy as np
import pyarrow as pa
import pytest

from wayfold.operators import integrity


def alone(g, y, sigma):
    """Fault exclusion on one epoch, step by step: satellites, east, passed, excluded."""
    kept, out = np.arange(len(y)), 0
    while True:
        w, n = 1 / sigma[kept] ** 2, len(kept)
        m = g[kept].T @ (w[:, None] * g[kept])
        if n < 4 or np.linalg.cond(m) >= 1e12:
            return n, None, False, out
        a = np.linalg.inv(m) @ (g[kept].T * w)
        x = a @ y[kept]
        rest = y[kept] - g[kept] @ x
        sse = (w * rest * rest).sum()
        if sse <= integrity.threshold(n - 4) or out == integrity.MOST_EXCLUDED or n - 1 < integrity.LEAST_LEFT:
            return n, pytest.approx(x[0], rel=1e-6, abs=1e-6), bool(sse <= integrity.threshold(n - 4)), out
        free = np.maximum(1 - np.diag(g[kept] @ a), 1e-12)
        kept, out = np.delete(kept, (np.abs(rest) / (sigma[kept] * np.sqrt(free))).argmax()), out + 1


def test_epochs_in_stacks_equal_epochs_alone(spark, monkeypatch):
    monkeypatch.setattr(integrity, "TOGETHER", 50)
    rng = np.random.default_rng(7)
    rows = []
    for epoch in [*range(300), None]:
        for k in range(300 if epoch == 17 else int(rng.integers(1, 13))):
            rows.append((epoch, float(k * 7 % 360 if epoch == 17 else rng.integers(0, 12) * 30), float(rng.integers(10, 80)), float(rng.normal(0, 1) + 70 * (rng.random() < 0.1)), 1.0 + k % 3 / 2))
    sats = spark.createDataFrame(rows, "epoch long, azimuth double, elevation double, residual double, sigma double")
    own = {}
    for e, *v in sorted(rows, key=lambda r: r[1:]):
        own.setdefault(e, []).append(v)
    fixes = {r.epoch: (r.n, r.east, r.passed, r.excluded) for r in integrity.position_fixes(sats).collect()}
    dops = {r.epoch: r.n for r in integrity.dop(sats).collect()}
    assert fixes.keys() == dops.keys() == own.keys()
    for e, v in own.items():
        v = np.array(v)
        assert fixes[e] == alone(integrity.directions(v[:, 0], v[:, 1]), v[:, 2], v[:, 3]) and dops[e] == len(v)


def test_many_epochs_take_few_calls(monkeypatch):
    """The inverses of a chunk's epochs are taken by numbers of satellites, not one by one."""
    calls, inverse = [], np.linalg.inv
    monkeypatch.setattr(np.linalg, "inv", lambda m: calls.append(len(m)) or inverse(m))
    rng = np.random.default_rng(1)
    sizes = rng.integers(4, 12, 2000)
    stacks = {int(n): (np.flatnonzero(sizes == n), integrity.directions(rng.uniform(0, 360, (k, n)), rng.uniform(10, 80, (k, n))), rng.normal(0, 1, (k, n)), np.ones((k, n))) for n, k in zip(*np.unique(sizes, return_counts=True), strict=True)}
    f = integrity.Fixes(2000).take(stacks)
    assert f.found.sum() > 1900 and len(calls) <= 8


def test_an_epoch_over_many_batches_stays_whole(monkeypatch):
    monkeypatch.setattr(integrity, "TOGETHER", 10)
    epoch = np.repeat([1, 2, 3, 4], [3, 200, 1, 25])
    t = pa.table({"epoch": epoch, "v": np.arange(len(epoch))})
    got = list(integrity.whole_epochs(t.to_batches(max_chunksize=7)))
    assert pa.concat_tables(got).equals(t)
    assert sorted(e for x in got for e in set(x.column("epoch").to_pylist())) == [1, 2, 3, 4]
