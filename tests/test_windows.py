"""Windows across rows against windows of the joined samples, and acquisition on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import acquisition
from quillon.operators.windows import halo_windows
from quillon.plans import registry, survey_queries


@pytest.mark.parametrize(("length", "every", "reach"), [(40, 72, 128), (100, 10, 100), (7, 3, 4096), (64, 64, 64)])
def test_windows_are_those_of_the_joined_samples(spark, length, every, reach):
    rng = np.random.default_rng(1)
    rows, joined = [], {}
    for stream in range(4):
        at = 0
        for k in range(60):
            n = int(rng.integers(1, 30))
            if stream != 3 or k != 20:  # one stream has a gap
                rows.append((stream, at, at + n, [stream * 10**6 + x for x in range(at, at + n)]))
                joined.setdefault(stream, set()).update(range(at, at + n))
            at += n
    blocks = spark.createDataFrame(rows, "stream long, start long, end long, i array<long>").withColumn("q", F.expr("transform(i, x -> -x)")).repartition(5)
    got = {(r.stream, r.start): (r.i, r.q) for r in halo_windows(blocks, ["i", "q"], length, every, reach).collect()}
    want = {(s, a) for s, held in joined.items() for a in range(0, max(held) + 1, every) if all(x in held for x in range(a, a + length))}
    assert set(got) == want
    for (s, a), (i, q) in got.items():
        assert i == [s * 10**6 + x for x in range(a, a + length)] and q == [-x for x in i]


def _joined(spark, sf_dir):
    """Each label's samples, vector by vector, and its pattern."""
    streams = {}
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect():
        v = np.round(np.array(r.embedding, np.float64) * 32767)
        streams.setdefault(r.label, []).append(v[0::2] + 1j * v[1::2])
    return {k: (np.concatenate(v), sum(x.reshape(-1, 8).sum(axis=0) for x in v)) for k, v in streams.items()}


def test_survey_and_dense_stage_on_the_joined_samples(spark, sf_dir):
    survey, dense = (registry.queries()[q](spark, sf_dir).collect() for q in ("d25_window_survey", "d26_dense_acquisition"))
    n = survey_queries.LENGTH
    frames = acquisition.Frames(n, 8)
    want, best = {}, set()
    for label, (x, t) in _joined(spark, sf_dir).items():
        own = []
        for a in range(0, len(x) - n + 1, survey_queries.EVERY):
            scores = frames.map(x[None, a : a + n], t[None])[0]
            e, b = acquisition.best_cell(scores)
            want[label, a] = (e, b - acquisition.BINS, round(float(scores[e, b]), 6))
            own.append((-want[label, a][2], a))
        best |= {(label, s) for _, a in sorted(own)[: survey_queries.BEST] for s in range(a, a + n, survey_queries.DENSE) if s + n <= len(x)}
    got = {(r.stream, r.start): (r.epoch, r.bin, r.score) for r in survey}
    assert set(got) == set(want)
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], abs=2e-6) for k in want)
    assert {(r.stream, r.start) for r in dense} == best
    for label, (x, t) in _joined(spark, sf_dir).items():
        for start in sorted(s for k, s in best if k == label)[:6]:
            own = x[start : start + n]
            outcome, found = acquisition.acquired(frames, own, t, frames.map(own[None], t[None])[0])
            rows = sorted((r for r in dense if (r.stream, r.start) == (label, start)), key=lambda r: r.rank or 0)
            assert rows[0].outcome == outcome and [(r.epoch, r.frequency) for r in rows if r.rank] == [(d["epoch"], pytest.approx(d["frequency"], abs=2e-6)) for d in found]
