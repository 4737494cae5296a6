"""What SQL doesn't express, against brute force; and edges of the ordered and interval operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import sky
from quillon.operators import aggregates, catalog, fitting, intervals, kernels, ordered, partitions, tracks
from quillon.sources import tables


def _cover_by_brute_force(n, edges, ends):
    best = math.inf
    for k in range(n):
        for chosen in itertools.combinations(edges, k):
            if len({u for u, _, _ in chosen}) == len({v for _, v, _ in chosen}) == len(chosen):
                best = min(best, ends * (n - len(chosen)) + sum(c for _, _, c in chosen))
    return best


def test_path_cover_is_optimal():
    rng = random.Random(4417)
    for _ in range(60):
        n = 6
        edges = [(i, j, rng.random() * 6) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
        cost, follow = fitting.path_cover(n, edges, 4.0)
        price = {(u, v): c for u, v, c in edges}
        used = [(u, v) for u, v in enumerate(follow) if v >= 0]
        assert len({v for _, v in used}) == len(used)
        assert math.isclose(cost, 4.0 * (n - len(used)) + sum(price[e] for e in used)) and math.isclose(cost, _cover_by_brute_force(n, edges, 4.0))


def test_two_crossing_tracks_are_two_paths():
    t = [0.0, 0.05, 0.1, 0.15]
    points = sorted([(x, 20_000 * x) for x in t] + [(x, 3000 - 20_000 * x) for x in t])
    edges = [(i, j, abs(points[j][1] - points[i][1]) / 8000) for i in range(8) for j in range(i + 1, 8) if points[j][0] > points[i][0]]
    assert sum(v >= 0 for v in fitting.path_cover(8, edges, 4.0)[1]) == 6


def test_robust_lines_see_past_outliers():
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 100, 80))
    v = 500 + 30 * t + rng.normal(0, 20, 80)
    v[::9] += 40_000
    slope, _, scale = fitting.huber_line(t, v)
    assert abs(slope - 30) < 8 and scale >= 100
    hits, slope, intercept = fitting.ransac_line(t, v, 100, 1000)
    assert hits >= 65 and abs(slope - 30) < 3 and abs(intercept - 500) < 120


def test_ransac_counts_like_brute_force():
    rng = np.random.default_rng(3)
    t, v = np.sort(rng.uniform(0, 10, 12)), rng.uniform(0, 10, 12)
    best = 0
    for i, j in itertools.combinations(range(12), 2):
        m = (v[j] - v[i]) / (t[j] - t[i])
        if abs(m) <= 2:
            best = max(best, int((np.abs(v - v[i] - m * (t - t[i])) <= 0.8).sum()))
    assert fitting.ransac_line(t, v, 0.8, 2.0)[0] == best


def test_best_chain_by_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(20):
        t, v = np.sort(rng.uniform(0, 10, 8)), rng.uniform(0, 5, 8)
        best = 0.0
        for k in range(1, 9):
            for c in itertools.combinations(range(8), k):
                steps = list(itertools.pairwise(c))
                if all(0 < t[b] - t[a] <= 3 and abs(v[b] - v[a]) <= 2 for a, b in steps):
                    best = min(best, -1.0 * k + sum(0.1 * (t[b] - t[a]) + 0.3 * abs(v[b] - v[a]) for a, b in steps))
        assert math.isclose(fitting.best_chain(t, v, 3, 2, 1.0, 0.1, 0.3)[1], best)


def test_kalman_follows_a_line_and_skips_a_jump():
    t = np.arange(60.0)
    z = 100 + 5 * t
    z[40] += 1e6
    level, rate, taken = fitting.kalman(t, z, 0.01, 1.0, 5.0)
    assert not taken[40] and taken.sum() == 59 and abs(rate[-1] - 5) < 0.1 and abs(level[-1] - z[-1]) < 1


def test_potentials_and_contradictions(spark):
    edges = [(1, 2, 3), (2, 3, -1), (3, 1, -2), (10, 11, 1), (11, 12, 1), (12, 10, 5), *[(i, i + 1, 1) for i in range(100, 140)]]
    found = {r.node: r for r in fitting.potentials(spark.createDataFrame(edges, "a long, b long, delta long")).collect()}
    assert [found[i].potential for i in (1, 2, 3)] == [0, 3, 2] and not found[1].contradictory and found[10].contradictory
    assert all(found[100 + i].root == 100 and found[100 + i].potential == i for i in range(41))


def test_greedy_matching_is_one_by_one(spark):
    rng = random.Random(5)
    pairs = [(a, 100 + b, rng.randrange(6)) for a in range(12) for b in range(12) if rng.random() < 0.5]
    want, left, right = set(), set(), set()
    for c, a, b in sorted((c, a, b) for a, b, c in pairs):
        if a not in left and b not in right:
            want.add((a, b, c))
            left.add(a)
            right.add(b)
    got = intervals.mutual_best(spark.createDataFrame(pairs, "l long, r long, cost int"), "l", "r", "cost")
    assert {(x.l, x.r, x.cost) for x in got.collect()} == want


def test_nearest_prefers_the_earlier_then_the_smaller(spark):
    marks = spark.createDataFrame([(1, 10, 5), (1, 20, 9), (1, 20, 7), (1, 30, 1)], "path long, mt long, mark long")
    points = spark.createDataFrame([(1, 15, 1), (1, 20, 2), (1, 26, 3), (1, 0, 4), (2, 5, 5), (1, 99, 6)], "path long, t long, id long")
    got = {r.id: (r.mark, r.distance) for r in intervals.nearest(points, marks, ["path"], "t", "mt", "mark").collect()}
    assert got == {1: (5, 5), 2: (7, 0), 3: (1, 4), 4: (5, 10), 5: (None, None), 6: (1, 69)}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlaps_do_not_depend_on_buckets(spark, width):
    rng = random.Random(1)
    make = lambda: [(rng.randrange(3), i, s := rng.randrange(100), s + rng.randrange(1, 30)) for i in range(40)]
    a, b = make(), make()
    got = intervals.overlap_join(spark.createDataFrame(a, "k int, x int, xa long, xb long"), spark.createDataFrame(b, "k int, y int, ya long, yb long"), ["k"], ("xa", "xb"), ("ya", "yb"), width)
    assert sorted((r.x, r.y) for r in got.collect()) == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] < q[3] and q[2] < p[3])


def test_suppression_is_greedy(spark):
    rng = random.Random(6)
    rows = [(1, rng.randrange(200), rng.randrange(50), i) for i in range(60)]
    kept = []
    for _, p, s, i in sorted(rows, key=lambda r: (-r[2], r[3])):
        if all(abs(p - q) >= 15 for q, _ in kept):
            kept.append((p, i))
    got = kernels.suppress(spark.createDataFrame(rows, "path int, place long, score long, id long"), ["path"], "place", "score", "id", 15).collect()
    assert sorted((r.place, r.id) for r in got) == sorted(kept) and got[0].source_count == 60


@pytest.mark.parametrize("seed", range(8))
def test_suppression_decides_long_stretches_part_by_part(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(900), rng.randrange(5 + 200 * (seed % 2)), i) for i, k in enumerate([1, 2] * 200)]
    want = []
    for k in (1, 2):
        kept = []
        for _, p, s, i in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[3])):
            if all(abs(p - q) >= 15 for q, _ in kept):
                kept.append((p, i))
        want += kept
    for at_once in (3, 20):
        got = kernels.suppress(spark.createDataFrame(rows, "path int, place long, score long, id long"), ["path"], "place", "score", "id", 15, at_once).collect()
        assert sorted((r.place, r.id) for r in got) == sorted(want)


def test_rising_scores_take_one_pass(spark):
    rows = spark.range(10_000).selectExpr("1 as path", "id * 10 as place", "id as score", "id")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = kernels.suppress(rows, ["path"], "place", "score", "id", 15, 500).collect()
    assert sorted(r.id for r in got) == list(range(1, 10_000, 2))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 10


def test_matching_of_a_long_chain(spark):
    """Each pair waits for a better one: taken one by one from the end."""
    pairs = [(i, i + d, 2 * (3000 - i) - d) for i in range(3000) for d in (0, 1)]
    want, left, right = set(), set(), set()
    for c, a, b in sorted((c, a, b) for a, b, c in pairs):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    got = intervals.mutual_best(spark.createDataFrame(pairs, "l long, r long, cost int"), "l", "r", "cost")
    assert {(x.l, x.r) for x in got.collect()} == want


def test_exact_bounds():
    assert aggregates.clopper_pearson_lower(0, 10) == 0.0
    assert math.isclose(aggregates.clopper_pearson_lower(10, 10), 0.05**0.1, rel_tol=1e-9)
    p = aggregates.clopper_pearson_lower(7, 20)
    assert math.isclose(sum(math.comb(20, i) * p**i * (1 - p) ** (20 - i) for i in range(7, 21)), 0.05, rel_tol=1e-9)


def test_hysteresis_boundaries(spark):
    rows = [(1, i, q) for i, q in enumerate([15, 20, 21, 15, 10, 9, 15, None, 15, 5])]
    got = ordered.hysteresis(spark.createDataFrame(rows, "path int, seq int, queued int"), ["path"], "seq", "queued", 20, 10).orderBy("seq").collect()
    assert [r.suppressed for r in got] == [False, False, True, True, True, False, False, True, True, False]


def test_retention_boundaries(spark):
    rows = [("old", 1, 60, True), ("held", 2, 100, False), ("middle", 3, 40, True), ("new", 4, 30, True)]
    frame = spark.createDataFrame(rows, "id string, created long, bytes long, eligible boolean")
    picked = lambda used: sorted(r.id for r in catalog.retention(frame, used, 1000).collect())
    assert picked(699) == [] and picked(700) == ["old"] and picked(711) == ["middle", "old"] and picked(900) == ["middle", "new", "old"]


def test_running_sum_over_ranges(spark):
    rows = [(i * 7 % 101, i, i % 13) for i in range(300)]
    got = catalog.running_sum(spark.createDataFrame(rows, "t long, id long, v long").repartition(5), ["t", "id"], "v", "s").collect()
    total, want = 0, {}
    for _, i, v in sorted(rows):
        total += v
        want[i] = total
    assert {r.id: r.s for r in got} == want


def test_permuted_input_gives_equal_segments(spark, sf_dir):
    rows = tables.observations(spark, sf_dir)
    cut = lambda frame: {(r.id, r.segment) for r in ordered.gap_segments(frame, ["path"], "t_us", 10**10, "id").collect()}
    assert cut(rows) == cut(rows.repartition(5, F.rand(3)))


def test_times_do_not_depend_on_the_session_zone(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        other = {tuple(r) for r in tables.observations(spark, sf_dir).select("id", "t_us").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert other == {tuple(r) for r in tables.observations(spark, sf_dir).select("id", "t_us").collect()}


def test_sky_on_known_directions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    lit = lambda *x: [F.lit(float(v)) for v in x]
    assert value(sky.separation_degrees(*lit(0, 90, 200, 90))) < 1e-9 and abs(value(sky.separation_degrees(*lit(359, 0, 1, 0))) - 2) < 1e-9
    assert abs(value(sky.gmst_degrees(F.lit(946_728_000_000_000))) - 280.46062) < 1e-4
    az, el, reach = sky.look_angles(*lit(0, 0, 0, 0, 10))
    assert abs(value(az)) < 1e-9 and abs(value(el)) < 1e-9 and value(reach) == 10
    assert value(sky.element_checksum(F.lit("1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927"))) == 7


def _alias_points(spark, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        t = i / 10
        for track, (slope, start) in enumerate([(20.0, 300.0), (-15.0, 1500.0)]):
            v = start + slope * t + rng.gauss(0, 4) + 2273 * rng.choice([-1, 0, 1])
            rows.append((1, track * 100 + i, t, v, 1.0))
    return spark.createDataFrame(rows, "path int, id long, t double, v double, w double")


def test_peeling_and_assignment_recover_aliased_lines(spark):
    from quillon.operators import tracks

    points = _alias_points(spark)
    found = sorted((r.slope, r.intercept % 2273, r.n) for r in tracks.peeled(points, ["path"], [-30.0, -15.0, 0.0, 15.0, 30.0], 2273.0, 32, 60.0, 20, 5).collect())
    assert len(found) == 2 and abs(found[0][0] + 15) < 1 and abs(found[0][1] - 1500) < 5 and abs(found[1][0] - 20) < 1 and abs(found[1][1] - 300) < 5 and found[0][2] == found[1][2] == 60
    seeds = spark.createDataFrame([(1, 0, 10.0, 340.0), (1, 1, -10.0, 1480.0)], "path int, track int, slope double, intercept double")
    lines, own = tracks.hard_assignment(points, seeds, ["path"], 2273.0, 200.0)
    assert {(r.id // 100, r.track) for r in own.collect()} == {(0, 0), (1, 1)} and own.count() == 120
    assert {r.track: round(r.slope) for r in lines.collect()} == {0: 20, 1: -15}
    assert tracks.peeled(points.where("false"), ["path"], [0.0], 2273.0, 8, 10.0, 2, 3).collect() == []


def test_polynomials_are_found_through_multiples_of_the_period(spark):
    rows = []
    for key, (a, b, c) in enumerate([(40.0, -2.0, -0.1), (10.0, 3.0, 0.0)]):
        for i in range(101):
            t = i / 10
            noise = ((i * 37) % 11 - 5) / 50
            rows.append((key, i, t, a + b * t + c * t * t + noise + 100.0 * (i % 2 + (i % 7 == 0)), 1.0 + i % 3))
    rows.append((9, 1, 0.0, 5.0, 1.0))
    points = spark.createDataFrame(rows, "key int, id long, t double, v double, w double")
    for degree in (1, 2):
        got = {r.key: r for r in tracks.lifted_polynomial(points, ["key"], 100.0, degree).collect()}
        assert sorted(got) == [0, 1]
        for key, r in got.items():
            own = [(t, v - 100.0 * (i % 2 + (i % 7 == 0)), w) for k, i, t, v, w in rows if k == key and i % 5]
            t, v, w = (np.array(x) for x in zip(*own, strict=True))
            fit = np.polyfit(t - 5.0, v, degree, w=np.sqrt(w))[::-1]
            fit[0] += 100.0 * round((r.a0 - fit[0]) / 100.0)  # which multiple the whole curve is on is left open
            assert np.allclose([r.a0, r.a1, r.a2][: degree + 1], fit, atol=1e-6)
    assert abs(got[0].a2 + 0.1) < 0.01 and got[0].held_rms < 0.2 and got[0].n == 80


def test_set_partitions_are_all_and_each_once(spark):
    got = partitions.set_partitions(spark.createDataFrame([(1, 1), (2, 4), (3, 0)], "g int, n int"), "n", 5).collect()
    own = [tuple(r.blocks) for r in got if r.g == 2]
    assert len(own) == len(set(own)) == 15 and [tuple(r.blocks) for r in got if r.g == 1] == [(0,)] and not [r for r in got if r.g == 3]
    with pytest.raises(Exception, match="more than 2"):
        partitions.set_partitions(spark.createDataFrame([(1, 3)], "g int, n int"), "n", 2).collect()


def _reached(edges, roots):
    out = {}
    for root in roots:
        depth, ahead = {root: 0}, [root]
        while ahead:
            ahead = list(dict.fromkeys(p for x in ahead for n, p in edges if n == x and p not in depth and not depth.update({p: depth[x] + 1})))
        out |= {(root, node): d for node, d in depth.items()}
    return out


def test_lineage_has_no_greatest_depth(spark):
    chain = [(i, i - 1) for i in range(1, 151)]
    # a chain, side ways and a way back, so that nodes are met more than once and the graph has a cycle
    dense = [(1000 + i, 1000 + j) for i in range(40) for j in range(max(0, i - 3), i)] + [(1000, 1010)]
    edges, roots = [*chain, (150, 75), *dense], [150, 80, 1039, 5000]
    got = catalog.lineage(spark.createDataFrame(edges, "node long, parent long"), spark.createDataFrame([(r,) for r in [*roots, 80]], "node long")).collect()
    assert len(got) == len({(r.root, r.node) for r in got})
    assert {(r.root, r.node): r.depth for r in got} == _reached(edges, roots)


@pytest.mark.parametrize("name", ["u01_lineage_closure", "u02_closure_available"])
def test_long_conversations(spark, tmp_path, name):
    import duckdb

    from quillon.plans import registry

    # turn 3 is more than 64 steps from the last one
    turns = [(1, t, "system" if t == 3 else "user", "x") for t in range(100)] + [(2, t, "user", "x") for t in range(5)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(db.execute(registry.oracle_sql()[name]).fetchall())
    assert sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()) == want and len(want) in (2, 105)


def test_exact_bounds_whatever_the_trials():
    def by_sums(k, n, alpha=0.05):
        low, high = 0.0, 1.0
        for _ in range(60):
            p = (low + high) / 2
            tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))
            low, high = (p, high) if tail < alpha else (low, p)
        return low

    cases = [(1, 1), (1, 40), (5, 5), (17, 40), (39, 40), (300, 900), (899, 900)]
    found = aggregates.exact_lower_bounds(*map(np.array, zip(*cases, strict=True)))
    assert found == pytest.approx([by_sums(*c) for c in cases], abs=1e-10)
    large = aggregates.exact_lower_bounds(np.array([0, 0, 3 * 10**8]), np.array([0, 7, 10**9]))
    assert math.isnan(large[0]) and large[1] == 0 and large[2] == pytest.approx(0.3 - 1.6448536 * math.sqrt(0.21 / 1e9), abs=1e-7)


@pytest.mark.parametrize("name", ["a03_power_summary", "d12_anchor_power", "d13_differential_score"])
def test_what_is_asked_of_one_vector_shuffles_nothing(spark, sf_dir, name):
    from quillon.plans import registry

    assert "Exchange" not in registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
