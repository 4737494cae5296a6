"""Whole keys as arrays: what travels, how keys cross batches, and hashes as SQL has them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import fitting, grouped, tracks
from quillon.plans import registry


@pytest.mark.parametrize(("name", "shuffles"), [("k06_consensus_lines", 1), ("k23_covered_paths", 1), ("k07_detected_tracks", 1), ("k17_joint_polynomials", 3)])
def test_points_travel_once(spark, sf_dir, name, shuffles):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    executed = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and executed.count("Exchange") <= shuffles


@pytest.mark.parametrize("name", ["k15_hard_assignment", "k18_seeded_assignment", "k05_peeled_tracks"])
def test_rounds_are_not_tables(spark, sf_dir, name, monkeypatch):
    kept, calls = tracks.kept, []
    monkeypatch.setattr(tracks, "kept", lambda frame: calls.append(1) or kept(frame))
    registry.queries()[name](spark, sf_dir)
    assert len(calls) <= 1


def test_keys_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rows = spark.range(3000).selectExpr("if(id < 500, 0L, id div 2) as key", "id", "cast(id as double) as v")
        work = grouped.each_key(lambda i, v: (i[:1], np.array([v.sum()])), ["key"], ["id", "v"], [np.int64, float])
        got = {r.key: (r.first, r.total) for r in grouped.by_keys(rows, ["key"], ["id"], ["id", "v"], "key long, first long, total double", work, 100).collect()}
        assert got == {0: (0, float(sum(range(500))))} | {k: (2 * k, 4.0 * k + 1) for k in range(250, 1500)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hashes_are_those_of_sql(spark):
    pairs = [(0, 1), (-5, 7), (2**62, -(2**61)), (99_999, 12)]
    want = [r.h for r in spark.createDataFrame(pairs, "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()]
    assert grouped.hashed(*np.array(pairs).T).tolist() == want


def test_voted_lines_are_those_of_the_votes(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), i, float(t), float(v), float(w)) for i, (k, t, v, w) in enumerate(zip(rng.integers(0, 4, 200), rng.uniform(0, 50, 200), rng.uniform(-900, 900, 200), rng.integers(1, 9, 200), strict=True))]
    points, slopes = spark.createDataFrame(rows, "key long, id long, t double, v double, w double"), [-3.0, 0.0, 4.0]
    votes = fitting.hough_lines(fitting.hough_votes(points, ["key"], "t", "v", "w", slopes, 500.0, 16), ["key"], 3)
    want = {(r.key, r.rank, slopes[r.slope_index], (r.bin + 0.5) * 500 / 16) for r in votes.collect()}
    assert {tuple(r) for r in tracks.voted_lines(points, ["key"], slopes, 500.0, 16, 3).collect()} == want


def test_probes_are_listed_after_sessions_travel(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    extra = orders.limit(40).withColumn("o_totalprice", F.col("o_totalprice") + 3)
    orders.union(extra).write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.queries()["p01_probe_schedule"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and "Window" not in plan
    want = {}
    for r in orders.union(extra).selectExpr("o_orderkey as k", "cast(bround(o_totalprice, 0) as bigint) % 7 + 1 as n").collect():
        want.setdefault(r.k, []).extend((s, w, o) for s in range(r.n) for w in range(2) for o in (0, 25))
    got = {}
    for r in found.orderBy("session", "place").collect():
        assert r.source_count == len(want[r.session]) and r.place == len(got.setdefault(r.session, []))
        got[r.session].append(r.start_ms)
    assert got == {k: [s * 1000 + w * 500 + o for s, w, o in sorted(v)[:20]] for k, v in want.items()}


def test_rounds_of_levels_send_nothing_to_the_driver(spark, monkeypatch):
    from quillon.operators import catalog

    frame = type(spark.range(1))
    plans, checkpoint = [], frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or checkpoint(self, *a))
    edges = [(i, i // 2) for i in range(1, 64)]
    catalog.topological(spark.range(64).toDF("node"), spark.createDataFrame(edges, "node long, needs long")).collect()
    joins = [p for p in plans if "Join" in p]
    # small sides would be broadcast when they are known to be small, unless the join is told to merge
    assert len(joins) > 10 and all("strategy=merge" in p for p in joins)


def test_paths_side_by_side_are_filtered_as_one_by_one(spark):
    from quillon.operators import ordered, phase

    rng = np.random.default_rng(8)
    n = 400
    rows = [(int(k), i, float(t), *map(float, z), float(c)) for i, (k, t, z, c) in enumerate(zip(rng.integers(0, 9, n) ** 2, rng.uniform(0, 300, n), rng.uniform(-0.5, 0.5, (n, 3)), rng.uniform(0, 1, n), strict=True))]
    frame = spark.createDataFrame(rows, "path long, id long, t double, a double, b double, c double, w double")
    kinds = ["path long", "id long", "taken boolean", *[f"x{i} double" for i in range(9)], "slip boolean", "corrected boolean"]
    work, columns = phase.FrameFilter(), ["id", "t", "a", "b", "c", "w"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    try:
        one, other = ({r.id: tuple(r) for r in run(frame, ["path"], ["t", "id"], columns, ", ".join(kinds), *steps).collect()} for run, steps in ((ordered.streamed, (work.start, work.step)), (grouped.in_step, (work.starts, work.steps))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one.keys() == other.keys() and len(one) == n
    assert all(other[i] == pytest.approx(one[i], abs=1e-9) for i in one)


@pytest.mark.parametrize("name", ["k16_trajectory_bank", "k32_scan_chain"])
def test_basins_are_searched_once(spark, sf_dir, name, monkeypatch):
    from quillon.plans import acquisition_queries

    each, calls = acquisition_queries._basins, []
    monkeypatch.setattr(acquisition_queries, "_basins", lambda *a: calls.append(a[2:]) or each(*a))
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert calls == [(1,)] and plan.count("MapInArrow") == (name == "k32_scan_chain")
