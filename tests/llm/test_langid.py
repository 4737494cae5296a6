import random

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from quillon.llm import _scan
from quillon.llm.langid import Comparer, bound_vectors, identify, keep_identified, trigrams


def _keys(texts):
    keys, bound = trigrams(*_scan.text_buffers(pa.array(texts)))
    unpack = lambda k: "".join(chr(c) if c else "_" for c in (int(k) >> 42, (int(k) >> 21) & 0x1FFFFF, int(k) & 0x1FFFFF))
    return [[unpack(k) for k in keys[bound[i] : bound[i + 1]]] for i in range(len(texts))]


def test_trigrams_are_framed_words():
    assert _keys(["Él a", "", None, "9!", "xy"]) == [["_él", "él_", "_a_"], [], [], [], ["_xy", "xy_"]]


def test_lookups_equal_bundled_vectors():
    texts = ["the cat sat on the mat", "der hund und die katze", "日本語 text ünd"]
    protos = np.stack([bound_vectors(trigrams(*_scan.text_buffers(pa.array([t])))[0]).sum(axis=0) for t in texts]).astype(float)
    found, has = Comparer(protos).similarities(*_scan.text_buffers(pa.array(texts)))
    want = protos @ (protos / np.linalg.norm(protos, axis=1, keepdims=True)).T
    assert np.allclose(found, want) and has.all() and (found.argmax(axis=1) == np.arange(3)).all()


def test_held_out_accuracy(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    got = identify(frame).join(frame.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_cases(spark):
    rows = [(i, "the cat and the dog that was here", "en") for i in range(20)] + [(20 + i, "der hund und die katze sind nicht hier", "de") for i in range(20)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", "de"), (103, "THE CAT", None), (103, "THE CAT", None), (None, "die katze", "xx"), (104, "katze und hund " * 20_000, None), (105, "中", None)]
    frame = spark.createDataFrame([(*r, 7, "p") for r in rows], "doc_id long, text string, lang string, score int, held_out string").repartition(3)
    got = identify(frame).collect()
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(rows) and pred[100] == pred[101] == pred[102] == ("und", 0.0)
    assert pred[103][0] == "en" and pred[104][0] == pred[None][0] == "de" and pred[105][0] in ("de", "en")
    assert {r.lang_pred for r in got} == {"en", "de", "und"}
    assert identify(frame.where("false")).collect() == []
    assert {r.lang_pred for r in identify(frame.where("lang is null")).collect()} == {"und"}


def test_letters_at_random_go_and_documents_stay(spark):
    rng = random.Random(4)
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    noise = [(10**6 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(150)), "en") for i in range(40)]
    other = [(2 * 10**6 + i, " ".join("".join(chr(0x430 + rng.randrange(32)) for _ in range(5)) for _ in range(80)), None) for i in range(10)]
    both = frame.union(spark.createDataFrame(noise + other, frame.schema))
    kept = {r.doc_id for r in keep_identified(both, 0.5).collect()}
    clean = {r.doc_id for r in frame.where("text rlike '[a-z]'").collect()}
    assert not [i for i in kept if i >= 2 * 10**6] and sum(10**6 <= i < 2 * 10**6 for i in kept) <= 2
    assert len(clean - kept) <= 0.002 * len(clean)


def test_strings_that_are_not_utf8_and_clashing_columns(spark):
    rows = [(i, "the cat sat on the mat and looked at the dog", "en", 1, "x") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, held_out string")
    broken = frame.withColumn("text", F.expr("cast(concat(cast(text as binary), X'FF80C3') as string)"))
    assert {r.lang_pred for r in identify(broken).collect()} == {"en"}
    kept = keep_identified(broken, 0.5)
    assert kept.columns == frame.columns and kept.count() == 20
    assert keep_identified(frame.where("false"), 0.5).collect() == []
