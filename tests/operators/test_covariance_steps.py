"""The ways of a trajectory's steps are looked up together, with the values of one step at a time."""

import numpy as np
import pandas as pd

from wayfold.operators import covariance as C


def test_steps_together_equal_single_steps(monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(1, s, s * 10.0, 0.1 * s, 0.0, k + 1, (s // 10 + k) * 4, s // 10 + k, s // 10 + k + 1, 1.0, rng.random(), rng.random()) for s in range(60) for k in range(3 + s % 2)]
    frame = pd.DataFrame(rows, columns="traj_id seq t x y cand edge_id source target length offset ep".split())
    ways = pd.DataFrame([(a, b, float(abs(a - b))) for a in range(12) for b in range(12) if a != b], columns=["source", "target", "distance"])
    config = C.CovarianceConfig(max_interval=1e9, max_speed=1e9)
    calls, between = [], C.Ways.between
    monkeypatch.setattr(C.Ways, "between", lambda self, s, t: calls.append(1) or between(self, s, t))
    got = C.fold(frame, ways, config)
    assert len(got) == len(frame) and len(calls) <= 8
    monkeypatch.setattr(C, "prepared", lambda *_: None)
    pd.testing.assert_frame_equal(got, C.fold(frame, ways, config))
    assert len(calls) > 100
