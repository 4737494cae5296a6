import math
from collections import Counter

import duckdb
import pytest

from quillon.llm import mixing
from quillon.llm.mixing import replicate


def _poisson(rate, u):
    k = 0
    total = math.exp(-rate)
    while total <= u:
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return k


def _uniform(doc_id):
    import hashlib

    return int(hashlib.md5(f"1/{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52


def test_oracle_agrees(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = Counter(db.execute(mixing.ORACLE).fetchall())
    assert Counter(tuple(r) for r in replicate(frame).collect()) == want and len(want) > 100


def test_given_weights_and_shares(spark):
    rows = [(i, "x" * (10 + i % 7), "en", "big" if i % 3 else "small", 1) for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copy int")
    got = replicate(frame, {"big": 1.0, "small": 3.0}, keep_keys=False).collect()
    size = Counter()
    for r in got:
        size[r.source] += len(r.text)
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "source", "copy"}
    assert abs(size["small"] / sum(size.values()) - 0.75) < 0.03 and abs(sum(size.values()) / sum(len(r[1]) for r in rows) - 1) < 0.05
    keyed = replicate(frame, {"big": 1.0, "small": 3.0})
    assert keyed.columns == ["doc_id", "text", "lang", "source", "copy", "_copy", "order_key"] and keyed.count() == len(got)
    ids = [r.doc_id for r in got]
    assert sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.6 * len(ids)


def test_counts_are_inverted(spark):
    rows = [(i, "abcd", "s") for i in range(400)] + [(None, "abcd", "s"), (7, "abcd", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = Counter(r.doc_id for r in replicate(frame, {"s": 1.0}, total_bytes=4.0 * len(rows) * 2.5).collect())
    want = Counter({d: _poisson(2.5, _uniform(d)) * (2 if d == 7 else 1) for d, _, _ in rows})
    assert got == +want


def test_edges(spark):
    rows = [(1, None, None), (2, "", None), (3, "text", None), (4, "other", "zero"), (5, None, "empty")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source for r in replicate(frame, {None: 5.0, "zero": 0.0}, total_bytes=400.0).collect()}
    assert got == {None}
    assert replicate(frame.where("false")).collect() == []
    with pytest.raises(ValueError):
        replicate(frame, {"other": -1.0})
    with pytest.raises(ValueError):
        replicate(frame, {None: 1.0}, total_bytes=1e6)


def test_small_source_beside_large_ones(spark):
    # a source of 2 bytes among 3 of 8 MB each is repeated about 1 400 times, far beyond MOST_RATE
    rows = [(i, "x" * 80_000, f"big{i % 3}") for i in range(300)] + [(1000, "a", "small"), (1001, "b", "small")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text)
    rate = math.sqrt(2) / sum(math.sqrt(n) for n in size.values()) * sum(size.values()) / 2
    assert rate > 2 * mixing.MOST_RATE
    got = replicate(frame).select("doc_id", "copy").where("doc_id >= 1000").collect()
    want = {d: _far(rate, _uniform(d)) for d in (1000, 1001)}
    assert Counter(r.doc_id for r in got) == want
    assert {(r.doc_id, r.copy) for r in got} == {(d, c) for d, n in want.items() for c in range(n)}


def _far(rate, u):
    k, total = 0, 0.0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if total > u:
            return k
        k += 1


def test_columns_that_clash_survive_and_many_rates_are_salted(spark, monkeypatch):
    rows = [(i, "w " * (i + 1), "en", f"s{i % 3}", i, f"o{i}") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copy long, order_key string")
    got = replicate(frame)
    assert got.columns == [*frame.columns, "_copy", "_order_key"]
    found = sorted(map(tuple, got.collect()))
    assert found and all((r[4], r[5]) == (r[0], f"o{r[0]}") for r in found)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, replicate(frame).collect())) == found
