"""Components with potentials from few links, against all links."""

import numpy as np
import pytest

from quillon.operators import fitting


@pytest.mark.parametrize("at_once", [7, 1 << 17])
def test_forest_says_what_all_links_say(at_once):
    rng = np.random.default_rng(4)
    n = 120
    height, met = rng.integers(-3, 4, n), np.triu(rng.random((n, n)) < 0.08, 1)
    met[(np.arange(n) % 5)[:, None] != np.arange(n) % 5] = False
    delta = height - height[:, None] + ((np.arange(n) % 5 == 0) & (rng.random((n, n)) < 0.2))  # the component of 0 contradicts itself
    met, delta = met | met.T, np.where(met, delta, -delta.T)
    asked = 0

    def links(i, j):
        nonlocal asked
        asked += len(i) * len(j)
        return met[np.ix_(i, j)], delta[np.ix_(i, j)]

    root, potential, (a, b, d) = fitting.forest(n, links, at_once)
    want = np.arange(n)
    for _ in range(n):
        want = np.minimum(want, np.where(met, want, n).min(axis=1))
    assert (root == want).all() and (root[root] == root).all()
    off = met & (potential - potential[:, None] != delta)
    assert set(root[off.any(axis=1)]) == set(root[a]) and off[a, b].all() and (delta[a, b] == d).all() and len(a) >= 1


def test_forest_of_one_contradictory_component_asks_little():
    n, asked = 4000, 0

    def links(i, j):
        nonlocal asked
        asked += len(i) * len(j)
        return i[:, None] != j, np.ones((len(i), len(j)), np.int64) * (i[:, None] < j) - (i[:, None] > j)

    root, _, (a, _, _) = fitting.forest(n, links, 1 << 14)
    assert (root == 0).all() and len(a) == 1 and asked < 20 * n
