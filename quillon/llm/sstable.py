"""Token ids as sorted-string-table shards, and reading them back.

A shard file holds documents in ascending order of their key:

    data blocks | index block | Bloom filter | footer

* A data block is a run of entries, compressed with Zstandard, then its CRC-32.  An entry is three varints
  (bytes shared with the key before it in the block, bytes of the key's rest, bytes of the value), the rest of
  the key, and the value: the ids in little-endian order, two bytes each if the vocabulary allows, else four.
* The index block has an entry for each data block: its first key, offset and length.
* The Bloom filter tells most absent keys without reading a block.
* The footer has a fixed length: places of index and filter, numbers of entries and ids, id width, magic.

A key is the document's number, sign bit flipped, in big-endian order, so that keys sort as numbers do; a null
number has the empty key and comes first.  Rows that repeat a number are kept, ordered by a hash of their texts.

Tasks write their shard under a name of their own attempt, and only files that the manifest names are read:
a lost or repeated task leaves at most a file that nobody reads.  Paths may be any that pyarrow.fs knows.

Defined results: null or empty text has the end id only; an empty table has no shards and gives no rows; other
columns take no part.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import _scan
from quillon.llm._bpe import encoder
from quillon.llm._spark import cut

BLOCK_BYTES = 64 << 10
#: A file's size, about: the writer holds its keys and its filter until it ends.
SHARD_BYTES = 256 << 20
_FOOTER = struct.Struct("<QQQQQQI8s")
_MAGIC = b"quillst1"
_BLOOM_BITS, _BLOOM_HASHES = 10, 7
_MANIFEST = "shard int, part int, file string, n_docs long, n_ids long, first_id long, last_id long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = _scan.mix64(keys)
    step = _scan.mix64(h) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + step[:, None] * np.arange(_BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


def _bloom_key(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] if key else 0x5EED


class ShardWriter:
    """Takes keys in ascending order."""

    def __init__(self, sink, width: int) -> None:
        self.sink, self.width, self.at = sink, width, 0
        self.packer = zstandard.ZstdCompressor(level=1)
        self.block, self.last, self.first = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[int] = []
        self.n_ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.before:
            raise ValueError("keys must come in ascending order")
        self.before = key
        if not self.block:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += value
        self.last = key
        self.keys.append(_bloom_key(key))
        self.n_ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.block:
            packed = self.packer.compress(bytes(self.block))
            self.index.append((self.first, self.at, len(packed) + 4))
            self._write(packed + struct.pack("<I", zlib.crc32(packed)))
            self.block = bytearray()

    def finish(self) -> None:
        self._flush()
        index_at = self.at
        self._write(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index))
        bloom_at = self.at
        bits = max(64, _BLOOM_BITS * len(self.keys)) // 8 * 8
        table = np.zeros(bits, bool)
        if self.keys:
            table[_bloom_places(np.array(self.keys, np.uint64), bits).ravel().astype(np.int64)] = True
        self._write(np.packbits(table).tobytes())
        self._write(_FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, len(self.keys), self.n_ids, self.width, _MAGIC))


class ShardReader:
    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        footer = self._at(size - _FOOTER.size, _FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_ids, self.width, magic = _FOOTER.unpack(footer)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        raw, at = self._at(index_at, index_n), 0
        self.first: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.first.append(raw[at : at + n])
            offset, at = _read_varint(raw, at + n)
            length, at = _read_varint(raw, at)
            self.blocks.append((offset, length))
        self.bloom = np.unpackbits(np.frombuffer(self._at(bloom_at, bloom_n), np.uint8)).astype(bool)

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _entries(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data = self._at(*self.blocks[k])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        data = zstandard.ZstdDecompressor().decompress(data[:-4])
        key, at = b"", 0
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", length // self.width, at)
            at += length

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, ids in self._entries(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row of this number: filter, binary search in the index, then the blocks that may hold it."""
        key = key_of(doc_id)
        if not self.bloom[_bloom_places(np.array([_bloom_key(key)], np.uint64), len(self.bloom)).ravel().astype(np.int64)].all():
            return []
        found = []
        k = max(0, bisect.bisect_left(self.first, key) - 1)
        while k < len(self.blocks) and self.first[k] <= key:
            found += [ids for own, ids in self._entries(k) if own == key]
            k += 1
        return found


def _open(path: str):
    system, local = fs.FileSystem.from_uri(path)
    return system, local


class _Sink:
    """One shard file of a task, and its row of the manifest."""

    def __init__(self, folder: str, shard: int, part: int, width: int) -> None:
        system, local = _open(folder)
        system.create_dir(local, recursive=True)
        self.name = f"{uuid.uuid4().hex}.sst"
        self.file = system.open_output_stream(f"{local}/{self.name}")
        self.writer, self.place = ShardWriter(self.file, width), (shard, part)
        self.first = self.last = None

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.first = doc_id if not self.writer.keys else self.first
        self.last = doc_id
        self.writer.add(key_of(doc_id), ids)

    def finish(self) -> pa.RecordBatch:
        self.writer.finish()
        self.file.close()
        row = (*self.place, self.name, len(self.writer.keys), self.writer.n_ids, self.first, self.last)
        kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["shard", "part", "file", "n_docs", "n_ids", "first_id", "last_id"])


def _written(path: str, folder: str, end_id: int, target: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        width = 2 if max(model.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        sink, part = None, 0
        try:
            for batch in batches:
                doc_ids = batch.column("doc_id").to_pylist()
                for i, j, data, off in _scan.chunks(batch.column("text")):
                    ids, bound = model.encode(data, off)
                    ids = np.insert(ids, bound[1:], end_id)
                    bound = bound + np.arange(len(bound))
                    for k in range(i, j):
                        if sink is not None and sink.writer.at >= target:
                            yield sink.finish()
                            sink, part = None, part + 1
                        if sink is None:
                            sink = _Sink(folder, batch.column("shard")[0].as_py(), part, width)
                        sink.add(doc_ids[k], ids[bound[k - i] : bound[k - i + 1]])
            if sink is not None:
                yield sink.finish()
        finally:
            if sink is not None and not sink.file.closed:
                sink.file.close()

    return run


def write_shards(documents: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards to ``folder`` and returns the manifest, a row for each shard in key order (shard, then part).

    Texts are dealt by ranges of the number once and encoded where their shard is written, so ids aren't shuffled; rows of one number go on in the next
    range by a hash of their texts.  A task begins a new file when the one it writes has ``shard_bytes``.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return cut(dealt.select("doc_id", "text", F.spark_partition_id().alias("shard")).mapInArrow(_written(tokenizer_path, folder, end_id, shard_bytes), _MANIFEST))


def _scanned(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, local = _open(folder)
                with system.open_input_file(f"{local}/{name}") as source:
                    out: list[tuple] = []
                    for doc_id, ids in ShardReader(source).scan():
                        out.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                        if len(out) == 20_000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    return run


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files; a task reads one shard, block by block."""
    # a row for each shard, so one ordered pass over the manifest is small
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    n = max(1, manifest.count())
    based = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return based.repartition(n).mapInArrow(_scanned(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: DataFrame, folder: str, doc_id: int | None) -> list[list[int]]:
    """The ids of one document: only shards whose range may hold it are opened."""
    near = (F.col("first_id") <= doc_id) | F.col("first_id").isNull() if doc_id is not None else F.col("first_id").isNull()
    if doc_id is not None:
        near &= F.col("last_id") >= doc_id
    found = []
    for r in manifest.where(near).orderBy("shard", "part").collect():
        system, local = _open(folder)
        with system.open_input_file(f"{local}/{r['file']}") as source:
            found += [x.tolist() for x in ShardReader(source).get(doc_id)]
    return found
