import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillon.llm._spark import new_path
from quillon.llm.sstable import ShardReader, ShardWriter, key_of, lookup, read_shards, write_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


class _Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def _file(rows, width=2):
    sink = _Bytes()
    writer = ShardWriter(sink, width)
    for k, ids in rows:
        writer.add(key_of(k), np.array(ids))
    writer.finish()
    return sink


@pytest.mark.parametrize("width", [2, 4])
def test_round_trip_and_search(width):
    rng = np.random.default_rng(1)
    keys = sorted(int(x) for x in rng.integers(-(10**12), 10**12, 500))
    rows = [(None, [5])] + [(k, rng.integers(0, 60_000, rng.integers(0, 3000)).tolist()) for k in keys] + [(2**63 - 1, [7]), (2**63 - 1, [8])]
    reader = ShardReader(_file(rows, width))
    assert [(k, x.tolist()) for k, x in reader.scan()] == rows
    assert len(reader.blocks) > 3
    for k, ids in rows[:-2]:
        assert [x.tolist() for x in reader.get(k)] == [ids]
    assert [x.tolist() for x in reader.get(2**63 - 1)] == [[7], [8]]
    absent = [k for k in range(3000) if k not in set(keys)]
    assert all(reader.get(k) == [] for k in absent)


def test_damage_is_seen():
    sink = _file([(1, [1, 2, 3])])
    raw = bytearray(sink.getvalue())
    raw[5] ^= 1
    with pytest.raises(ValueError):
        list(ShardReader(_Bytes(bytes(raw))).scan())


def test_order_is_asked_for():
    with pytest.raises(ValueError):
        _file([(2, [1]), (1, [1])])


def test_empty_file():
    assert list(ShardReader(_file([])).scan()) == [] and ShardReader(_file([])).get(3) == []


def _want(documents):
    library = Tokenizer.from_file(PATH)
    at, out = 0, []
    for d, t in sorted(documents, key=lambda x: ((x[0] is not None), x[0] or 0, x[1] is not None, x[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_shards_of_documents(spark):
    documents = [(5, "five a b"), (1, None), (2, ""), (2, ""), (-7, "minus"), (None, "null"), (9, "long " * 20_000), (3, "x\n\ny  z")]
    frame = spark.createDataFrame([(d, t, 1, "f") for d, t in documents], "doc_id long, text string, shard int, file string").repartition(3)
    folder = new_path(spark, "tokens")
    manifest = write_shards(frame, PATH, folder)
    got = sorted((tuple(r) for r in read_shards(manifest, folder).collect()), key=lambda r: r[1])
    assert got == _want(documents)
    assert lookup(spark, manifest, folder, 5) == [Tokenizer.from_file(PATH).encode("five a b").ids + [2]]
    assert lookup(spark, manifest, folder, 4) == [] and len(lookup(spark, manifest, folder, 2)) == 2
    assert len(lookup(spark, manifest, folder, None)) == 1


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    folder = new_path(spark, "tokens")
    assert read_shards(write_shards(frame, PATH, folder), folder).collect() == []


def test_real_documents(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "tokens")
    got = sorted((tuple(r) for r in read_shards(write_shards(frame, PATH, folder), folder).collect()), key=lambda r: r[1])
    assert got == _want([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])
    assert pa.types.is_int64(pa.array([got[0][1]]).type)


def test_files_end_at_their_size(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(2)
    folder = new_path(spark, "tokens")
    manifest = write_shards(frame, PATH, folder, shard_bytes=1)
    files = manifest.collect()
    assert max(r.part for r in files) > 0 and len({(r.shard, r.part) for r in files}) == len(files) == len({r.file for r in files})
    got = sorted((tuple(r) for r in read_shards(manifest, folder).collect()), key=lambda r: r[1])
    assert got == _want([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])
    some = frame.orderBy("doc_id").select("doc_id", "text").limit(3).collect()
    library = Tokenizer.from_file(PATH)
    assert all(lookup(spark, manifest, folder, r.doc_id) == [library.encode(r.text, add_special_tokens=False).ids + [2]] for r in some)


def test_rows_of_one_number_need_no_task_of_their_own(spark):
    documents = [(7, f"text {i} " * (i % 9 + 1)) for i in range(600)] + [(1, "a"), (9, "b")]
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    folder = new_path(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = write_shards(frame, PATH, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.n_docs for r in manifest.collect()) < 500
    got = sorted((tuple(r) for r in read_shards(manifest, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [1] + [7] * 600 + [9]
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in _want(documents))
    assert len(lookup(spark, manifest, folder, 7)) == 600
