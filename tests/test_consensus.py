"""Lines by drawn hypotheses against plain Python over all points."""

import math
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.operators import fitting
from quillon.plans import fitting_queries, registry


def _hash(a, b):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    first = xxhash.xxh64(struct.pack("<q", a), seed=42).intdigest()
    return signed(xxhash.xxh64(struct.pack("<q", b), seed=first).intdigest())


def _half_up(x):
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def _lines(points, c):
    """points: (id, u, t, v)."""
    period, gate, out = c["period"], c["gate"], []
    buckets = int(period // gate)
    wrapped = lambda x: (x + period / 2) % period - period / 2
    for _ in range(c["tracks"]):
        drawn = []
        for i, u, t, v in points:
            later = sorted((_hash(i, j), j, tj, vj) for j, uj, tj, vj in points if 0 < uj - u <= c["reach"])
            for h, j, tj, vj in later[: c["draws"]]:
                for lift in range(-c["lifts"], c["lifts"] + 1):
                    slope = (vj + lift * period - v) / (tj - t)
                    if abs(slope) <= c["steepest"]:
                        drawn.append((h, i, j, lift, t, v, slope, _half_up(slope / c["step"])))
        if not drawn:
            break
        votes = {}
        place = lambda v, t, s: math.floor((v - s * c["step"] * t) % period * buckets / period)
        for s in {d[7] for d in drawn}:
            for _, _, t, v in points:
                votes[s, place(v, t, s)] = votes.get((s, place(v, t, s)), 0) + 1
        score = lambda d: sum(votes.get((d[7], (place(d[5], d[4], d[7]) + k) % buckets), 0) for k in (-1, 0, 1))  # noqa: B023, E731
        best = min(drawn, key=lambda d: (-score(d), *d[:4]))
        t, v = np.array([p[2] for p in points]), np.array([p[3] for p in points])
        line = best[5] - best[6] * best[4] + best[6] * t
        near = np.abs(wrapped(v - line)) <= gate
        if near.sum() < 2:
            break
        m, b = np.polyfit(t[near], (line + wrapped(v - line))[near], 1)
        off = wrapped(v - b - m * t)
        held = np.abs(off) <= gate
        if held.sum() < c["support"]:
            break
        out.append(({p[0] for p, h in zip(points, held, strict=True) if h}, m, math.sqrt((off[held] ** 2).mean())))
        points = [p for p, h in zip(points, held, strict=True) if not h]
    return out


def _got(rows):
    got = {}
    for r in rows:
        got.setdefault((r.path, r.track), []).append(r)
    return got


def test_lines_against_python(spark, sf_dir):
    by_path = {}
    for r in fitting_queries.consensus_points(spark, sf_dir).collect():
        by_path.setdefault(r.path, []).append((r.id, r.u, r.t, r.v))
    got = _got(registry.queries()["k06_consensus_lines"](spark, sf_dir).collect())
    want = {(p, k): x for p, points in by_path.items() for k, x in enumerate(_lines(points, fitting_queries.CONSENSUS), 1)}
    assert set(got) == set(want) and max(k for _, k in want) > 1
    for key, (ids, slope, rms) in want.items():
        assert {r.id for r in got[key]} == ids
        assert got[key][0].slope == pytest.approx(slope, abs=1e-5) and got[key][0].rms == pytest.approx(rms, abs=1e-3)


def test_crossing_lines_modulo_the_period_are_found(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k, (slope, start) in enumerate([(40.0, 100.0), (-25.0, 9000.0)]):
        for i in range(60):
            t = float(2 * i + k)
            rows.append((1000 * k + i, int(t * 3_600_000_000), t, float((start + slope * t + rng.normal(0, 10)) % 5000)))
    rows += [(5000 + i, int(t * 3_600_000_000), t, float(rng.uniform(0, 5000))) for i, t in enumerate(rng.uniform(0, 120, 25).round(3).tolist())]
    frame = spark.createDataFrame([(1, *r) for r in rows], "path long, id long, u long, t double, v double")
    run = lambda f: fitting.consensus_lines(f, ["path"], 30 * 3_600_000_000, 6, 1, 5000.0, 60.0, 100.0, 0.5, 20, 4)
    one, two = (_got(run(f).collect()) for f in (frame.coalesce(1), frame.repartition(5, F.col("id"))))
    assert {k: sorted(r.id for r in v) for k, v in one.items()} == {k: sorted(r.id for r in v) for k, v in two.items()}
    slopes = sorted(v[0].slope for v in one.values())
    assert slopes[0] == pytest.approx(-25, abs=0.5) and slopes[-1] == pytest.approx(40, abs=0.5)
    assert sum(len({r.id for r in v} & set(range(1000 * k, 1000 * k + 60))) >= 57 for v in one.values() for k in (0, 1)) == 2
