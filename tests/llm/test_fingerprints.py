import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import fingerprints
from quillon.llm.queries import QUERIES


def _next(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    return [(d, t or "", rows[(i + 1) % len(rows)][1] or "") for i, (d, t) in enumerate(rows)]


def _exact(text):
    total = [0] * 8
    for p in text.split("\n"):
        digest = hashlib.sha256(p.encode()).hexdigest()
        total = [(a + int(digest[8 * k : 8 * k + 8], 16)) % (1 << 32) for k, a in enumerate(total)]
    return "".join(f"{x:08x}" for x in total)


def _pairs(text):
    out = Counter()
    for p in text.split("\n"):
        words = [w for w in p.replace("\t", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        out.update(zip(["", *words][: len(words)], words, strict=True))
    return out


def _share(a, b):
    """What the likeness estimates, counted."""
    a, b = _pairs(a), _pairs(b)
    square = lambda c: sum(v * v for v in c.values())
    apart = {k: a[k] - b[k] for k in a | b}
    return max(0.0, 1 - square(apart) / (square(a) + square(b))) if a or b else None


def _check(rows, got):
    want = _next(rows)
    assert len(got) == len(rows)
    got = sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    off = []
    for r, (d, text, after) in zip(got, want, strict=True):
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        assert (r.doc_id, r.n_chars) == (d, n)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 64 + 512
        assert r.fingerprint[:64] == _exact(text) and r.edited_fingerprint[:64] == _exact(edited)
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            assert 0 <= near <= 1
            if Counter(text.split("\n")) == Counter(other.split("\n")):
                assert near == 1
            elif (share := _share(text, other)) is not None and n > 300:
                off.append(near - share)
    return np.array(off)


def test_documents_against_python(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op11_multiset_fingerprints"](spark, sf_dir).collect()
    off = _check(rows, got)
    assert len(off) > 200 and np.sqrt((off**2).mean()) < 0.1 and abs(off.mean()) < 0.05


def test_odd_rows(spark):
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    rows = [(5, None), (1, ""), (2, "ab\ncd"), (3, "cd\nab"), (4, "é😀x\n\n y\tz "), (7, long), (6, "one"), (-3, "x y z"), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"r": F.lit("own"), "at": F.lit(1), "edited": F.lit(None)}).repartition(3)
    got = fingerprints.compare(frame).collect()
    _check(rows, got)
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == by[3].fingerprint and by[2].near_next == 1.0
    assert by[1].fingerprint == by[5].fingerprint != by[6].fingerprint
    assert by[7].n_chars == len(long)


def test_repeated_rows_follow_each_other(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c d"), (2, "e")]
    got = fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got) == [(1, 3), (1, 3), (1, 3), (2, 1)]
    assert sum(r.near_next == 1.0 for r in got) == 1  # the copy's copy
    assert len({r.fingerprint for r in got}) == 3


def test_one_and_no_document(spark):
    frame = spark.createDataFrame([(9, "a b c d")], "doc_id long, text string")
    (row,) = fingerprints.compare(frame).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"a b " + b"a b").hexdigest()
    assert fingerprints.compare(frame.where("false")).collect() == []


def test_insertion_and_deletion(spark):
    frame = spark.createDataFrame([("ab", "a x\nb"), ("ba", "b\na x"), ("a", "a x"), ("b", "b"), ("abb", "b\na x\nb")], "k string, text string")
    fp = {r.k: r.fingerprint for r in fingerprints.fingerprint(frame, "k").collect()}
    assert fp["ab"] == fp["ba"] and len(set(fp.values())) == 4
    row = spark.createDataFrame([(fp["ab"], fp["a"], fp["b"])], "ab string, a string, b string")
    got = row.select(
        fingerprints.plus(F.col("a"), F.col("b")).alias("sum"),
        fingerprints.minus(F.col("ab"), F.col("b")).alias("less"),
        fingerprints.plus(F.col("ab"), F.col("b")).alias("more"),
        fingerprints.likeness(F.col("ab"), F.col("ab")).alias("one"),
    ).first()
    assert (got.sum, got.less, got.more, got.one) == (fp["ab"], fp["a"], fp["abb"], 1.0)


def test_parts_of_one_key_add_up(spark):
    whole = spark.createDataFrame([(1, "a b\nc\nc")], "k int, text string")
    parts = spark.createDataFrame([(1, "c"), (1, "a b"), (1, "c")], "k int, text string")
    assert fingerprints.fingerprint(whole, "k").collect() == fingerprints.fingerprint(parts, "k").collect()


@pytest.mark.parametrize("name", ["op11_multiset_fingerprints"])
def test_no_python_in_the_plan(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
