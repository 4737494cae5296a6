import hashlib
import math
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm import centroids
from quillon.llm.queries import ORACLES, QUERIES


def brute(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        owner = assign()
        for j in range(len(at)):
            own = [v for (_, v), (_, o) in zip(kept, owner, strict=True) if o == j]
            if own:
                at[j] = [math.floor(Fraction(sum(x), len(own))) for x in zip(*own, strict=True)]
    found = assign()
    inertia = {j: sum(d for d, o in found if o == j) for j in range(len(at))}
    every = sum(inertia.values())
    fits = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, o, fits(d), fits(inertia[o]), fits(every), digest[o]) for (i, _), (d, o) in zip(kept, found, strict=True)), key=str)


def _got(frame):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table_against_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    found = db.execute(ORACLES["op13_delta_lloyd"])
    names = [c[0] for c in found.description]
    want = sorted((tuple(r[names.index(c)] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in found.fetchall()), key=str)
    frame = QUERIES["op13_delta_lloyd"](spark, f"/root/testdata/{sf}")
    assert dict(frame.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert _got(frame) == want


def _vector(i, scale=1.0):
    return [scale * math.sin(i * 12.9898 + k * 78.233) for k in range(64)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("own"), "cluster": F.lit(7), "wide": F.lit(None)}).repartition(3)


def test_odd_rows(spark):
    rows = [(i, _vector(i % 23)) for i in range(40)] + [(3, _vector(99)), (None, _vector(5)), (None, _vector(6)), (50, None), (51, []), (52, [0.5] * 63), (53, [None, *[0.5] * 63]), (54, [math.inf, *[0.5] * 63]), (55, [math.nan, *[0.5] * 63]), (56, [0.0] * 64)]
    assert _got(centroids.cluster(_frame(spark, rows))) == brute(rows)
    assert _got(centroids.cluster(_frame(spark, rows[:3]))) == brute(rows[:3])
    assert centroids.cluster(_frame(spark, rows).where("false")).collect() == []


@pytest.mark.parametrize("large", [3.0e5, 2.0e9, 1.0e17, 1.0e30, 1.0e300])
def test_large_components(spark, large):
    rows = [(i, _vector(i)) for i in range(30)] + [(100 + i, _vector(i, large)) for i in range(9)]
    assert _got(centroids.cluster(_frame(spark, rows))) == brute(rows)


def test_transfers_alone_change_the_sums(spark):
    """After each round the global sums are those of the vectors' clusters, and rounds end when nothing moves."""
    rows = [(i, _vector(i % 50)) for i in range(300)]
    whole = centroids._kept(_frame(spark, rows), 64).mapInArrow(centroids._floored(1024), "vec_id long, v array<long>, wide string")
    run = centroids.Lloyd(whole, centroids.first_centroids(whole, 8, 3))
    moved = []
    for _ in range(30):
        run.assign()
        state = run.state.collect()
        moved.append(sum(r.moved for r in state))
        for k in range(8):
            own = [r.v for r in state if r.cluster == k]
            assert run.counts[k] == len(own) and run.sums[k] == [sum(x) for x in zip(*own, strict=True)] if own else run.counts[k] == 0
        if not run.move():
            break
    assert moved[0] == 300 and 0 < moved[1] < 300 and moved[-1] == 0
