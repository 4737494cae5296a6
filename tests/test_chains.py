import itertools
import math
import random

import numpy as np
import pytest

from quillon.operators import chains
from quillon.plans import chain_queries, registry


def _least(edges, ends, nodes):
    """Cost of the best cover by trying everything, one source after another."""
    by = {}
    for u, v, c in edges:
        if c < ends:
            by.setdefault(u, []).append((v, c))
    sources = sorted(by)

    def rest(i, used):
        if i == len(sources):
            return 0.0
        return min([ends + rest(i + 1, used), *(c + rest(i + 1, used | {v}) for v, c in by[sources[i]] if v not in used)])

    return rest(0, frozenset()) + ends * (nodes - len(sources))


def _cost(edges, follow, ends, nodes):
    price = {(u, v): c for u, v, c in edges}
    assert len(set(follow.values())) == len(follow)
    return sum(price[e] for e in follow.items()) + ends * (nodes - len(follow))


@pytest.mark.parametrize("seed", range(60))
def test_matching_is_the_cheapest(seed):
    rng = random.Random(seed)
    n = rng.randrange(2, 9)
    edges = [(u, v, rng.choice([0.0, 0.5, 1.0, rng.random() * 3])) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.6]
    follow = chains.matched(edges, 1.5)
    assert _cost(edges, follow, 1.5, n) == pytest.approx(_least(edges, 1.5, n))


def test_order_along_links(spark):
    rng = random.Random(1)
    names = list(range(30_000))
    rng.shuffle(names)
    chain = names[:10_000]
    links = [*itertools.pairwise(chain), *[(names[i], names[i + 1]) for i in range(10_000, 20_000, 2)]]
    nodes = spark.createDataFrame([(x,) for x in names], "node long")
    jobs = spark.sparkContext.statusTracker()
    got = {r.node: (r.head, r.place) for r in chains.linked_order(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert jobs is not None and len(got) == 30_000
    assert [got[x] for x in chain] == [(chain[0], i) for i in range(10_000)]
    assert all(got[names[i + 1]] == (names[i], 1) for i in range(10_000, 20_000, 2)) and got[names[-1]] == (names[-1], 0)


@pytest.mark.parametrize("links", [[(1, 2), (1, 3)], [(1, 3), (2, 3)], [(1, 2), (2, 3), (3, 1)]])
def test_wrong_links_are_told(spark, links):
    with pytest.raises(ValueError):
        chains.linked_order(spark.createDataFrame([(1,), (2,), (3,)], "node long"), spark.createDataFrame(links, "a long, b long"))


# --- the cover, with hints refitted, by plain Python ---------------------------------------------------------------


def _edges(points):
    out = []
    reach, step, w, most, ends = (chain_queries.COVER[k] for k in ("reach", "step", "weights", "most", "ends"))
    for a, b in itertools.permutations(points, 2):
        if 0 < b["t"] - a["t"] <= reach:
            dt = (b["t"] - a["t"]) / step
            off = abs(b["f"] - a["f"] - a["slope"] * dt - 0.5 * a["acceleration"] * dt * dt)
            turn, bend = abs(b["slope"] - a["slope"]), abs(b["acceleration"] - a["acceleration"])
            cost = w[0] * off / most[0] + w[1] * turn / most[1] + w[2] * bend / most[2] + w[3] * max(0.0, round(dt) - 1)
            if off <= most[0] and turn <= most[1] and bend <= most[2] and cost < ends:
                out.append((a["id"], b["id"], cost))
    return out


def _parts(edges):
    """Edges by component of the graph of sources and targets: only these compete."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v, _ in edges:
        root[find(("a", u))] = find(("b", v))
    out = {}
    for e in edges:
        out.setdefault(find(("a", e[0])), []).append(e)
    return out.values()


def _chains(points, follow):
    after = set(follow.values())
    for p in points:
        if p["id"] not in after:
            chain = [p["id"]]
            while chain[-1] in follow:
                chain.append(follow[chain[-1]])
            yield chain


def _cover(points):
    before = None
    points = [dict(p) for p in points]
    for k in range(1, 13):
        edges, follow = _edges(points), {}
        for part in _parts(edges):
            found = chains.matched(part, chain_queries.COVER["ends"])
            n = len({e[0] for e in part})
            if math.prod(1 + sum(e[0] == u for e in part) for u in {e[0] for e in part}) <= 20_000:
                assert _cost(part, found, 1.5, n) == pytest.approx(_least(part, 1.5, n))
            follow |= found
        if follow == before or k == 12:
            return list(_chains(points, follow)), follow == before, k
        before, by = follow, {p["id"]: p for p in points}
        for chain in _chains(points, follow):
            if len(chain) > 1:
                t = np.array([(by[i]["t"] - by[chain[0]]["t"]) / 3.6e9 for i in chain])
                fit = np.polyfit(t, [by[i]["f"] for i in chain], 2 if len(chain) > 2 else 1)
                for i, u in zip(chain, t, strict=True):
                    by[i]["slope"] = float(np.polyval(np.polyder(fit), u))
                    by[i]["acceleration"] = 2 * float(fit[0]) if len(chain) > 2 else 0.0
    return None


def test_cover_against_python(spark, sf_dir):
    rows = [r.asDict() for r in chain_queries.cover_points(spark, sf_dir).collect()]
    by_path = {}
    for r in sorted(rows, key=lambda r: (r["t"], r["id"])):
        by_path.setdefault(r["path"], []).append(r)
    got = registry.queries()["k23_covered_paths"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    every, told = [], {}
    for path, points in by_path.items():
        branches, *told[path] = _cover(points)
        every += branches
    want = {i: (b[0], k) for b in every for k, i in enumerate(b)}
    assert {r.id: (r.branch, r.place) for r in got} == want
    assert {r.path: [r.converged, r.rounds] for r in got} == told and len({k for _, k in told.values()}) > 1
    assert max(len(b) for b in every) > 2


# --- track before detect by plain Python ---------------------------------------------------------------------------


def _chain(points, slope, c):
    best, back = {}, {}
    for i, (ident, t, f, w) in enumerate(points):
        top = (w - c["point"], 1, 0)
        for j in range(i):
            bid, bt, bf, _ = points[j]
            dt = t - bt
            if 0 < dt <= c["gap"]:
                off = abs((f - bf - slope * dt + c["period"] / 2) % c["period"] - c["period"] / 2)
                if off <= c["gate"]:
                    found = (best[bid][0] + w - c["point"] - c["bend"] * (off / c["gate"]) ** 2 - c["wait"] * dt, best[bid][1] + 1, -bid)
                    if found > top:
                        top, back[ident] = found, bid
        best[ident] = top[:2]
    end = max(best, key=lambda x: (*best[x], -x))
    chain = [end]
    while chain[-1] in back:
        chain.append(back[chain[-1]])
    return chain[::-1], best[end][0]


def _tracks(points, c):
    points, out = sorted(points, key=lambda p: (p[1], p[0])), []
    for _ in range(c["tracks"]):
        found = []
        for s, slope in enumerate(c["slopes"] if points else []):
            chain, total = _chain(points, slope, c)
            by = {p[0]: p for p in points}
            t0, f0 = by[chain[0]][1:3]
            dt = np.array([by[i][1] - t0 for i in chain])
            v = np.array([by[i][2] for i in chain])
            x = (f0 + slope * dt - v) / c["period"]
            lifted = v + c["period"] * np.sign(x) * np.floor(np.abs(x) + 0.5)
            if len(chain) >= c["support"] and dt[-1] >= c["span"]:
                m, b = np.polyfit(dt, lifted, 1)
                off = lifted - b - m * dt
                if np.abs(off).max() <= c["gate"]:
                    found.append((total, len(chain), -s, chain, t0, dt[-1], m, b, math.sqrt((off**2).mean())))
        if not found:
            break
        _, _, _, chain, t0, span, m, b, rms = max(found, key=lambda x: x[:3])
        out.append((chain, m, rms))
        near = lambda p: 0 <= p[1] - t0 <= span and abs((p[2] - b - m * (p[1] - t0) + c["period"] / 2) % c["period"] - c["period"] / 2) <= c["gate"]  # noqa: B023, E731
        points = [p for p in points if p[0] not in chain and not near(p)]
    return out


def test_tracks_against_python(spark, sf_dir):
    by_path = {}
    for r in chain_queries.track_points(spark, sf_dir).collect():
        by_path.setdefault(r.path, []).append((r.id, r.t, r.f, r.w))
    got = {}
    for r in registry.queries()["k07_detected_tracks"](spark, sf_dir).collect():
        got.setdefault((r.path, r.track), []).append((r.place, r.id, r.slope, r.rms))
    want = {(p, k): t for p, points in by_path.items() for k, t in enumerate(_tracks(points, chain_queries.TRACKS), 1)}
    assert want and max(k for _, k in want) > 1 and set(got) == set(want)
    for key, (chain, slope, rms) in want.items():
        rows = sorted(got[key])
        assert [r[1] for r in rows] == chain and [r[0] for r in rows] == list(range(1, len(chain) + 1))
        assert rows[0][2] == pytest.approx(slope, abs=1e-5) and rows[0][3] == pytest.approx(rms, abs=1e-3)


# --- slopes of all pairs -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_median_slope_is_that_of_all_pairs(seed):
    from quillon.operators import fitting

    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    t, v = rng.integers(0, 40 if seed % 3 == 0 else 10**9, n).astype(float), rng.integers(0, 30 if seed % 2 else 10**6, n).astype(float)
    slopes = [(v[j] - v[i]) / (t[j] - t[i]) for i, j in itertools.permutations(range(n), 2) if t[j] > t[i]]
    for listed in (0, 4096):
        found, pairs = fitting.median_slope(t, v, listed)
        assert pairs == len(slopes)
        assert math.isnan(found) if not slopes else found == pytest.approx(float(np.median(slopes)), rel=1e-12, abs=1e-15)


def test_median_slope_of_many_points():
    from quillon.operators import fitting

    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 1000, 60_000))
    v = 3.25 * t + rng.standard_cauchy(60_000)
    assert fitting.median_slope(t, v)[0] == pytest.approx(3.25, abs=1e-3)
