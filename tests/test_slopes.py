"""Windows of slopes against all pairs, and how many pairs are compared."""

import numpy as np
import pytest

from quillon.operators import blocks, slopes

HOUR = 3.6e9


def _made(n, seed, copies=1):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, int(20 * HOUR), n)
    b = a + 1 + (rng.exponential(3 * HOUR, n)).astype(np.int64)
    s = rng.laplace(0, 5000, n) / ((b - a) / HOUR)
    t = {"a": a, "b": b, "s": s, "m": (a + b) / 2}
    t = {k: np.tile(v, copies) for k, v in t.items()}
    return t | {"c": (np.arange(n * copies) % 7 - 3) * 40.0, "id": np.arange(n * copies)}


def _score(x, y, shifts=(0.0,)):
    u, v = np.maximum(x["a"], y["a"]), np.minimum(x["b"], y["b"])
    best = np.inf
    for s in shifts:
        d0, d1 = (x["s"] - y["s"] + 2 * (x["c"] * (t - x["m"]) - y["c"] * (t + s * HOUR - y["m"])) / HOUR for t in (u, v))
        best = np.minimum(best, np.sqrt((d0 * d0 + d0 * d1 + d1 * d1) / 3) + (v - u) / HOUR * np.abs(2 * (x["c"] - y["c"])))
    return np.where((u < v) & (x["id"] != y["id"]), best, np.inf)


def _cost(x, y):
    score = _score(x, y)
    score[(x["id"] >= y["id"]) | (score > 1500)] = np.inf
    return np.floor(score * 1000 + 0.5) / 1000


@pytest.mark.parametrize("shifts", [(0.0,), (-2 / 6, -1 / 6, 0.0, 1 / 6, 2 / 6)])
def test_windows_hold_the_near_once(shifts):
    t = _made(400, 1)
    near = slopes.Near(t, shifts)
    all_pairs = _score({k: v[:, None] for k, v in t.items()}, t, shifts)
    most = near.bound(t, 3, "id")
    assert (np.partition(all_pairs, 2, axis=1)[:, 2] <= most * (1 + 1e-9) + 1e-6).all()
    found = []
    for rows, x in slopes.alike(t):
        for part, windows in slopes.stretches(near.windows(x, most[rows]), 500):
            found += [(rows[part][i], j) for i, j in near.pairs({c: v[part] for c, v in x.items()}, windows)]
    i, j = (np.concatenate(f) for f in zip(*found, strict=True))
    listed = set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(listed) == len(i)
    assert set(zip(*(k.tolist() for k in np.nonzero(np.isfinite(all_pairs) & (all_pairs <= most[:, None]))), strict=True)) <= listed


@pytest.mark.parametrize(("n", "copies", "at_once"), [(500, 1, 1 << 20), (500, 1, 2000), (60, 9, 300), (3, 1, 10)])
def test_greedy_by_windows_is_that_of_all_pairs(n, copies, at_once):
    t = _made(n, n, copies)
    i, j, value = slopes.taken(_cost, t, t, 1500.0, 0.001, at_once)
    whole = _cost({k: v[:, None] for k, v in t.items()}, t)
    a, b = blocks.matched(whole)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(a.tolist(), b.tolist(), strict=True))
    assert (whole[i, j] == value).all()


def test_greedy_compares_few_pairs():
    t, seen = _made(100, 5, 40), 0

    def counted(x, y):
        nonlocal seen
        seen += len(x["id"])
        return _cost(x, y)

    i, _, _ = slopes.taken(counted, t, t, 1500.0, 0.001, 1 << 16)
    assert len(i) > 3000 and seen < 4000 * 4000 / 8


def test_large_keys_are_searched(spark):
    """Keys larger than a block go to the search, others and the largest to blocks: one matching."""
    rng = np.random.default_rng(2)
    rows = [(k, 1000 * k + i, float(v)) for k, n in ((0, 5), (1, 30), (2, 90)) for i, v in enumerate(rng.integers(0, 40, n))]
    frame = lambda s: spark.createDataFrame(rows, f"key long, {s} long, {s}v double")

    def cost(x, y):
        c = np.abs(x["lv"] - y["rv"])
        c[(c > 6) | (x["l"] == y["r"])] = np.inf
        return c

    def search(one, other):
        if not 8 < len(one["l"]) <= 50:
            raise ValueError("neither a block nor too large")
        whole = cost({c: v[:, None] for c, v in one.items()}, other)
        i, j = blocks.matched(whole)
        return i, j, whole[i, j]

    got = {tuple(r) for r in blocks.greedy(frame("l"), frame("r"), ["key"], ("l", "r"), cost, "c", 8, 4, search, 50).collect()}
    assert got == {tuple(r) for r in blocks.greedy(frame("l"), frame("r"), ["key"], ("l", "r"), cost, "c", 8, 4).collect()} and len(got) > 80
