import itertools
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from quillon.functions.canonical import canonical_digest, canonical_json
from quillon.operators import catalog

SCHEMA = "b struct<z: double, a: array<string>, `é`: map<string, array<int>>>, a string, `10` long, `9` boolean, f float"


def _told(value):
    return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))


def test_canonical_json_of_nested_and_odd_values(spark):
    strings = ["", "a", 'q"\\', "\x00\x01\x1f\x7f", "\b\t\n\f\r", "é漢😀", "/", " ", None]
    rows = [((float(i), strings[: i + 1], {s: [i, None] for s in strings if s} | {"Z": None, "é": []}), s, i - 4, i % 2 == 0, 0.5 * i) for i, s in enumerate(strings)]
    rows += [(None, None, None, None, None), ((None, None, {}), "x", 2**63 - 1, None, -0.0), ((1.5, [None], None), "y", -(2**63), True, 1e10)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = frame.select(F.struct("*").alias("x"))
    got = [r[0] for r in whole.select(canonical_json(F.col("x"), whole.schema["x"].dataType)).collect()]
    for (b, a, ten, nine, f), text in zip(rows, got, strict=True):
        b = None if b is None else {"z": b[0], "a": b[1], "é": b[2]}
        assert text == _told({"b": b, "a": a, "10": ten, "9": nine, "f": f})


def test_values_without_floats_stay_in_the_engine(spark):
    rows = [("q\"\\\x00\x1f\n", [1, None, -5], {"b": True, "a": None, "é": False}), (None, None, None), ("漢😀\x7f", [], {})]
    frame = spark.createDataFrame(rows, "s string, a array<long>, m map<string, boolean>").select(F.struct("s", "m", "a").alias("x"))
    told = frame.select(canonical_json(F.col("x"), frame.schema["x"].dataType).alias("t"))
    assert "Arrow" not in told._jdf.queryExecution().executedPlan().toString()
    assert [r.t for r in told.collect()] == [_told({"s": s, "a": a, "m": m}) for s, a, m in rows]


def test_numbers_have_their_shortest_form(spark):
    rng = random.Random(4)
    numbers = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-4, 9.999e-5, 1e-5, 1e15, 1e16, 123456789012345678.0, 1e22, 1e23, 2e23, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 2.0e-3, 4.35, 0.30000000000000004, 1 / 3, 2.0**44, 9007199254740993.0]
    numbers += [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)) if x == x and abs(x) != float("inf")] + [rng.random() * 10 ** rng.randrange(-6, 20) for _ in range(3000)] + [rng.randrange(10**6) / 100 for _ in range(500)]
    frame = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = [r[0] for r in frame.select(canonical_json(F.col("x"), frame.schema["x"].dataType)).collect()]
    assert [(t, float(t)) for t in got] == [(repr(x), x) for x in numbers]


def test_what_has_no_json_is_told(spark):
    frame = spark.createDataFrame([(float("nan"),)], "x double")
    with pytest.raises(Exception, match="Out of range float values"):
        frame.select(canonical_json(F.col("x"), frame.schema["x"].dataType)).collect()
    dated = spark.sql("select date'2024-01-01' as x")
    with pytest.raises(TypeError):
        canonical_digest(F.col("x"), dated.schema["x"].dataType)


def test_states_at_any_instant(spark):
    rng = random.Random(7)
    events = [(k, rng.choice(["go", "stop", "noise", "end"]), rng.randrange(40), i) for i, k in enumerate([*range(12)] * 9)]
    told = {"go": "running", "stop": "idle", "end": "over"}
    frame = spark.createDataFrame(events, "k long, event string, t long, turn int")
    spans = catalog.state_intervals(frame, ["k"], ["turn"], "t", told)
    instants = list(range(-1, 42))
    got = {(r.instant, r.k): (r.state, r.since) for r in catalog.as_of(spans, instants).collect()}
    want = {}
    for t, k in itertools.product(instants, range(12)):
        state = since = None
        for _, e, at, _ in sorted((e for e in events if e[0] == k and e[2] <= t), key=lambda e: e[2:]):
            if e in told:
                if told[e] != state:
                    since = at
                state = told[e]
        if state:
            want[t, k] = (state, since)
    # a state that was left and taken up again within an instant counts as new
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] <= k[0] for k in got)


def test_stage_prefixes_against_all_prefixes(spark):
    rng = random.Random(5)
    nodes, edges = [], []
    for g in range(40):
        n = rng.randrange(1, 7)
        ids = [g * 10 + i for i in range(n)]
        nodes += [(g, x, rng.choice(["quick", "standard", "deep"]), rng.randrange(1, 9)) for x in ids]
        edges += [(ids[j], ids[i]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
    frame, links = spark.createDataFrame(nodes, "graph long, node long, tier string, cost long"), spark.createDataFrame(edges, "node long, needs long")
    needs = {}
    for a, b in edges:
        needs.setdefault(a, set()).add(b)

    def level(x):
        return 1 + max(map(level, needs.get(x, ())), default=-1)

    for tier, budget in (("quick", 10), ("standard", 15), ("deep", 100)):
        got = {}
        for r in catalog.stage_prefix(frame, links, ["quick", "standard", "deep"], tier, budget).collect():
            got.setdefault(r.graph, []).append((r.place, r.node, r.spent))
        for g in range(40):
            own = sorted((n for n in nodes if n[0] == g), key=lambda n: (level(n[1]), n[1]))
            allowed = ["quick", "standard", "deep"].index(tier)
            last = max((i for i, n in enumerate(own, 1) if ["quick", "standard", "deep"].index(n[2]) <= allowed), default=0)
            best = max(k for k in range(last + 1) if sum(n[3] for n in own[:k]) <= budget)
            prefix = {n[1] for n in own[:best]}
            assert all(needs.get(x, set()) <= prefix for x in prefix)
            assert [x[1] for x in sorted(got.get(g, []))] == [n[1] for n in own[:best]]
