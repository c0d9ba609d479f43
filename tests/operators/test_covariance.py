"""The covariance fold against plain sums over all paths, and its splits."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from wayfold.operators.covariance import CovarianceConfig, Ways, fold, trusted

CONFIG = CovarianceConfig(max_interval=10.0, max_speed=100.0)


def chain(n=4, seed=1, dt=1.0):
    """n points along a line of edges 0 -> 1 -> 2 ..., with three candidates each."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n):
        ep = rng.dirichlet([1, 1, 1])
        for c in range(3):
            edge = max(0, s - 1 + c)
            rows.append({"traj_id": 7, "seq": s, "t": s * dt, "x": float(s), "y": 0.0, "cand": c + 1, "edge_id": edge, "source": edge, "target": edge + 1, "length": 1.0, "offset": float(rng.uniform(0.1, 0.9)), "ep": ep[c]})
    return pd.DataFrame(rows)


WAYS = pd.DataFrame([(a, b, float(b - a)) for a in range(12) for b in range(a + 1, 12)], columns=["source", "target", "distance"])


def way(a, b):
    if a.edge_id == b.edge_id:
        back = a.offset - b.offset
        return -back if back <= 0 else 0.0 if back <= 0.15 else -1.0
    if b.edge_id < a.edge_id:
        return -1.0
    return (1 - a.offset) + b.offset + (b.source - a.target)


def test_forward_and_viterbi_are_sums_and_maxima_over_all_paths():
    rows = chain()
    layers = [list(g.itertuples()) for _, g in rows.groupby("seq")]
    got = fold(rows, WAYS, CONFIG)
    norm = []
    for one, two in itertools.pairwise(layers):
        raw = np.array([[0.0 if way(a, b) < 0 else min(1.0, 1.0 / max(way(a, b), 1e-300)) for b in two] for a in one])
        norm.append(raw / np.where(raw.sum(1, keepdims=True) > 0, raw.sum(1, keepdims=True), 1))
    weight = {}
    for path in itertools.product(range(3), repeat=len(layers)):
        p = layers[0][path[0]].ep / 3
        for i in range(1, len(path)):
            p *= norm[i - 1][path[i - 1], path[i]] * layers[i][path[i]].ep
        weight[path] = p
    last = got[got["seq"] == len(layers) - 1].sort_values("cand")
    total = [sum(w for p, w in weight.items() if p[-1] == c) for c in range(3)]
    assert last["trust"].to_numpy() == pytest.approx(np.array(total) / sum(total))
    best = [max(w for p, w in weight.items() if p[-1] == c) for c in range(3)]
    assert np.exp(last["cumu"].to_numpy()) == pytest.approx(best)
    path = max(weight, key=weight.get)
    assert [int(r.cand) - 1 for r in got[got["chosen"]].sort_values("seq").itertuples()] == list(path)
    assert (got["status"] == "SUCCESS").all()
    assert got.groupby("seq")["trust"].sum().to_numpy() == pytest.approx(1)


def test_lag_smoothing_is_the_best_continuation():
    from dataclasses import replace

    rows = chain()
    plain, smooth = fold(rows, WAYS, CONFIG), fold(rows, WAYS, replace(CONFIG, lag_steps=1))
    assert smooth[smooth["seq"] == 3]["trust"].to_numpy() == pytest.approx(plain[plain["seq"] == 3]["trust"].to_numpy())
    layers = [list(g.itertuples()) for _, g in rows.groupby("seq")]
    v = plain[plain["seq"] == 1].sort_values("cand")["cumu"].to_numpy()
    score = []
    for i, a in enumerate(layers[1]):
        ahead = [math.log(min(1.0, 1.0 / max(way(a, b), 1e-300))) + math.log(b.ep) for b in layers[2] if way(a, b) >= 0]
        score.append(math.exp(v[i] + max(ahead)) if ahead else 0.0)
    assert smooth[smooth["seq"] == 1].sort_values("cand")["trust"].to_numpy() == pytest.approx(np.array(score) / sum(score))


def test_splits_and_failures():
    few = fold(chain(2), WAYS, CONFIG)
    assert list(few["status"]) == ["FAILED_NO_CANDIDATE"] * 2
    gap = chain(8)
    gap.loc[gap["seq"] >= 4, "t"] += 100
    got = fold(gap, WAYS, CONFIG)
    assert got["part"].nunique() == 2 and set(got["status"]) == {"PARTIAL"}
    stuck = chain(4)
    stuck.loc[stuck["seq"] == 2, ["edge_id", "source", "target"]] = [99, 99, 100]
    got = fold(stuck, WAYS, CovarianceConfig(max_interval=10.0, bridge_gaps=False))
    assert list(got[got["seq"] == 2]["status"]) == ["FAILED_DISCONNECTED"]
    assert len(fold(chain(1).head(0), WAYS, CONFIG)) == 0


def test_running_back_on_a_one_way_edge_adds_up():
    """Small steps back are no way of length 0 for ever on a one-way edge, and are on others."""
    rows = chain(6).query("cand == 1").reset_index(drop=True)
    rows[["edge_id", "source", "target"]] = [3, 3, 4]
    rows["x"], rows["length"], rows["ep"] = 0.0, 1.0, 1.0
    rows["offset"] = [0.9, 0.886, 0.872, 0.858, 0.844, 0.83]
    free = fold(rows.assign(oneway=False), WAYS, CONFIG)
    assert set(free["status"]) == {"SUCCESS"}
    bound = fold(rows.assign(oneway=True), WAYS, CONFIG)
    assert set(bound["status"]) == {"PARTIAL"} and list(bound.groupby("part")["seq"].min()) == [0, 3]


def test_ways_are_looked_up_in_matrices():
    pairs = {(1, 2): 5.0, (2, 9): 1.5, (9, 1): 0.0}
    ways = Ways.of(pairs)
    a, b = np.meshgrid([0, 1, 2, 9, 12], [0, 1, 2, 9, 12], indexing="ij")
    assert ways.between(a, b).tolist() == [[pairs.get((int(x), int(y)), -1.0) for x, y in zip(r, s, strict=True)] for r, s in zip(a, b, strict=True)]
    assert Ways.of({}).between(a, b).max() == -1


def test_points_of_little_trust_are_left_out(spark):
    rows = [(1, 0, 0, "SUCCESS", 1, 0.9, True), (1, 1, 0, "SUCCESS", 1, 0.2, True), (1, 1, 0, "SUCCESS", 2, 0.8, False), (1, 2, 1, "PARTIAL", 1, 0.1, True), (1, 3, 2, "FAILED_DISCONNECTED", None, None, False)]
    df = spark.createDataFrame(rows, "traj_id long, seq long, part int, status string, cand int, trust double, chosen boolean")
    got = sorted((r.seq, r.status, r.cand) for r in trusted(df, 0.5).collect())
    assert got == [(0, "SUCCESS", 1), (2, "FAILED_NO_CANDIDATE", None), (3, "FAILED_DISCONNECTED", None)]
