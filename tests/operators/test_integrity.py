import numpy as np
import pytest

from wayfold.operators import integrity
from wayfold.plans import integrity_queries


def test_dop_equals_numpy(spark, small):
    got = {r.epoch: r for r in integrity_queries.dilution_of_precision(spark, small).collect()}
    rows = integrity_queries.satellites(spark, small).toPandas()
    for epoch, own in list(rows.groupby("epoch"))[:50]:
        g = integrity.directions(own["azimuth"].to_numpy(), own["elevation"].to_numpy())
        if np.linalg.matrix_rank(g) < 4 or got[epoch].hdop == integrity.NO_DOP:
            assert got[epoch].hdop == integrity.NO_DOP
        else:
            q = np.linalg.inv(g.T @ g)
            assert got[epoch].pdop == pytest.approx(np.sqrt(np.trace(q[:3, :3])), rel=1e-6)


def test_a_faulty_satellite_is_left_out():
    rng = np.random.default_rng(2)
    g = integrity.directions(rng.uniform(0, 360, 9), rng.uniform(10, 85, 9))
    truth = np.array([3.0, -2.0, 5.0, 1.0])
    y = g @ truth + rng.normal(0, 0.5, 9)
    y[4] += 80
    n, *x, sse, limit, passed, excluded, hpl = integrity.fix_with_exclusion(g, y, np.full(9, 0.5))
    assert (n, excluded, passed) == (8, 1, True) and sse <= limit and hpl > 0
    assert np.abs(np.array(x) - truth).max() < 5
    assert integrity.fix_with_exclusion(g[:3], y[:3], np.full(3, 0.5))[7] is False
