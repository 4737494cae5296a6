import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillon.llm import topk
from quillon.llm.topk import Slice, search


def brute(rows, every=20, k=20):
    held = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (q, v) in enumerate(held):
        if q % every == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), c) for m, (c, w) in enumerate(held) if m != n)[:k]
            out.update((q, r + 1, c, -s) for r, (s, c) in enumerate(scores))
    return out


@pytest.mark.parametrize("spread", [1.0, 0.2, 3.0])
@pytest.mark.parametrize("scale", [1.0, float(1 << 21)])
def test_maxscore_is_exact_in_slices(spread, scale):
    """In doubles and, with large components, in 64-bit integers; best ones are carried from slice to slice."""
    rng = np.random.default_rng(5)
    vectors = np.floor(rng.normal(size=(3000, 24)) * 20 * np.exp(-spread * np.arange(24) / 6)) * scale + np.floor(rng.normal(size=(3000, 24)) * 3)
    vectors[1500:1540] = vectors[3]
    ids, rows = rng.choice(10**6, 3000, replace=False), np.arange(3000)
    parts = [Slice(vectors[k : k + 1100], rows[k : k + 1100], ids[k : k + 1100]) for k in range(0, 3000, 1100)]
    whole = vectors.astype(np.int64)
    for own in rng.choice(3000, 25, replace=False):
        best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in parts:
            best = part.best(vectors[own], own, 20, *best)
        score = whole @ whole[own]
        order = np.lexsort((ids, -score))
        order = order[order != own][:20]
        assert best[0].tolist() == ids[order].tolist() and best[1].tolist() == score[order].tolist()


def test_table_against_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = set(db.execute(topk.ORACLE).fetchall())
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert {tuple(r) for r in search(frame).collect()} == want
    assert {tuple(r) for r in search(frame, shard_rows=60, block_rows=7).collect()} == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.5]), (1, [1.0, 1.0]), (1, [0.1, 9.0]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0]), (20, [-0.01, 2.0, 5.0]), (20, [3.0]), (20, [3.0]), (-20, [3.0, 3.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    assert Counter(map(tuple, search(frame).collect())) == brute(rows)
    assert Counter(map(tuple, search(frame.withColumn("row", frame.vec_id), shard_rows=4, block_rows=2).collect())) == brute(rows)
    big = [(0, [1e9, 1e9]), (1, [1e9, -1.0]), (2, [1e300, 1.0]), (3, [-3.0, 1e8]), (20, [1e16, 2.0]), (40, [3e6, 5e6])]
    assert Counter(map(tuple, search(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect())) == brute(big)
    assert search(frame.where("false")).collect() == []
