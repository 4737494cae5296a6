"""The filter of five states and three measurements: its noise against numerical integrals, the query against a filter one measurement at a time."""

import math

import numpy as np
import pytest

from quillon.operators import phase
from quillon.plans import registry
from quillon.sources import tables

START = 1_704_067_200_000_000


@pytest.mark.parametrize("dt", [0.0, 0.3, 1.0, 7.5])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_noise_is_the_integral_of_the_step(order, dt):
    a = np.diag(np.ones(order - 1), 1)
    nodes, weights = np.polynomial.legendre.leggauss(12)
    total = np.zeros((order, order))
    for u, w in zip(nodes, weights, strict=True):
        t = dt * (u + 1) / 2
        step = sum(np.linalg.matrix_power(a, k) * t**k / math.factorial(k) for k in range(order))
        assert np.allclose(phase.integrated_step(order, t), step)
        total += w * dt / 2 * np.outer(step[:, -1], step[:, -1])
    assert np.allclose(phase.integrated_noise(order, 2.5, dt), 2.5 * total, rtol=1e-10, atol=1e-14)


def _wrap(x):
    return (x + 0.5) % 1 - 0.5


def _filtered(rows, c):
    x = p = before = None
    turned = -math.inf
    for ident, t, z, coherence in rows:
        if x is None:
            x = np.array([z[0], z[1], 0, z[2], 0])
            p = np.diag([c.deviations[0] ** 2, c.deviations[1] ** 2, c.acceleration**2, c.deviations[2] ** 2, c.densities[1]])
        else:
            d, (q, w) = t - before, c.densities
            f = np.array([[1, d, d * d / 2, 0, 0], [0, 1, d, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, d], [0, 0, 0, 0, 1.0]])
            noise = np.zeros((5, 5))
            noise[:3, :3] = q * np.array([[d**5 / 20, d**4 / 8, d**3 / 6], [d**4 / 8, d**3 / 3, d * d / 2], [d**3 / 6, d * d / 2, d]])
            noise[3:, 3:] = w * np.array([[d**3 / 3, d * d / 2], [d * d / 2, d]])
            x, p = f @ x, f @ p @ f.T + noise
        off = [_wrap(z[0] - x[0]), z[1] - x[1], z[2] - x[3]]
        taken = coherence >= c.least
        slip, corrected = taken and abs(off[0]) >= c.slip, taken and abs(off[1]) >= c.turn and t - turned >= c.apart
        turned = t if corrected else turned
        if taken:
            # one measurement after another: the same as all at once, for their errors are independent
            seen = np.array([x[0] + off[0], z[1], z[2]])
            for k, place in enumerate((0, 1, 3)):
                gain = p[:, place] / (p[place, place] + (c.deviations[k] / coherence) ** 2)
                x, p = x + gain * (seen[k] - x[place]), p - np.outer(gain, p[place])
        before = t
        yield ident, taken, off, x.copy(), math.sqrt(p[0, 0]), slip, corrected


def test_query_against_one_measurement_at_a_time(spark, sf_dir):
    by = {}
    for r in tables.observations(spark, sf_dir).collect():
        by.setdefault(r.path, []).append((r.t_us, r.id, r.cents, r.k))
    got = {r.id: r for r in registry.queries()["k27_frame_filter"](spark, sf_dir).collect()}
    work, marks = phase.FrameFilter(), 0
    for own in by.values():
        rows = [(i, (t - START) / 3.6e9, (v % 1000 / 1000, v % 517 / 517 - 0.5, v % 733 / 733), (k or 0) / 100) for t, i, v, k in sorted(own)]
        for ident, taken, off, x, sigma, slip, corrected in _filtered(rows, work):
            r = got.pop(ident)
            assert (r.taken, r.slip, r.corrected) == (taken, slip, corrected)
            assert [r.phase_off, r.rate_off, r.frame_off] == pytest.approx(off, abs=2e-5, rel=1e-5)
            assert [r.phase, r.rate, r.acceleration, r.frame, r.drift, r.phase_sigma] == pytest.approx([*x, sigma], abs=2e-5, rel=1e-5)
            marks += slip + corrected
    assert not got and marks > 10
