"""Near duplicates by b-bit MinHash: exact components of the graph of texts that share three quarters of their shingles.

A document's set is its distinct shingles of five words (lower-cased A-Z; the whole sequence if it has fewer).

1. One pass turns each text into its set's fingerprint, ``HASHES`` minima of which the low bits are packed into a
   signature, and a key for each band of minima.  Documents with equal sets form a class; from here on only
   classes travel, each with the smallest doc_id that has it.
2. Candidates are classes with a band key in common.  In each bucket the class with the most copies is the head;
   a class is held against its best head, by the signatures' bit counts corrected for chance agreement, and the
   pair is confirmed on full sets.  The links give first components, which swallow groups of near copies without
   ever listing their pairs.
3. Buckets that still hold several components compare the classes that lie in different ones: by signatures first, then
   those that may reach the threshold by full sets.  A bucket beyond ``SPLIT`` classes is first split by finer bands of fewer
   minima, computed for its classes alone, and by set size: its pairs meet where they share a finer band and where their
   sizes allow the threshold; so its rows grow with the bucket and not with its square.  Buckets and parts beyond ``BLOCK`` classes or ``BLOCK_BYTES`` of sets are compared in blocks;
   those of the largest component meet only the others', so a huge group of near copies is not dealt out
   against itself.  A bucket gives a link for each two components at most.
4. Components come from alternating large-star and small-star steps until nothing changes.

Pairs inside a component are never listed, for they can change nothing.  No bucket, partner or candidate is
dropped; a link of similarity 0.75 is missed by all bands in about one of a million cases, by all finer bands of a bucket
that is split in one of thirty thousand million, so that splitting changes nothing, and by the signature's margin of four
standard deviations in about one of thirty thousand.  Sets are of 64-bit hashes of shingles, and sets are equal if their sizes and 128 bits
of hash are.

Full sets are computed again only for the documents that a pair names, found by a Bloom filter of bounded size
before their texts are dealt out.

Defined results: null texts and texts without a word have an empty set and are their own component; a row that
repeats another's doc_id and text is in the same class; rows with one doc_id and different texts are versions of
one document, linked if any version is; a row with a null doc_id takes the component of its class, if any other
row has it, else null; other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quillon.llm import _scan
from quillon.llm._spark import cut, fresh, lean

WORDS = 5
BANDS, ROWS = 50, 5
HASHES, BITS = 256, 2
#: Finer bands, by which buckets beyond SPLIT are split: nearly all pairs at the threshold have several in common.
FINE, FINE_ROWS = 64, 4
BLOCK = 512
#: Bytes of full sets in a block, about: a task holds two blocks.
BLOCK_BYTES = 16 << 20
#: Members that are held against one copy of their head's set, about.
MEMBERS = 1000
#: Buckets beyond this are split: splitting makes 2 * FINE rows of a class, blocks one for each block that it meets.
SPLIT = 2 * FINE * BLOCK
_ODD = _scan.mix64(np.arange(64) + 77) | np.uint64(1)
_A = (_scan.mix64(np.arange(HASHES) + 501) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_scan.mix64(np.arange(HASHES) + 1501) >> np.uint64(32)).astype(np.uint32)
_SIGNED = "doc_id long, n long, f1 long, f2 long, sig binary, bands array<long>"


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and the n + 1 places at which each text's begin."""
    data = _scan.lower_ascii(data)
    starts, ends, first = _scan.word_spans(data, off)
    words = _scan.hash_spans(data, starts, ends)
    count = np.diff(first)
    whole = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        whole += words[k : k + len(whole)] * _ODD[k]
    whole = _scan.mix64(whole)
    short = np.zeros(len(count), np.uint64)
    for k in range(WORDS - 1):
        has = np.flatnonzero((count > k) & (count < WORDS))
        short[has] += words[first[has] + k] * _ODD[8 + k]
    short = _scan.mix64(short + count.astype(np.uint64) * _ODD[20])
    none = np.zeros(0, np.uint64)
    sets = [np.unique(whole[a : a + n - WORDS + 1]) if n >= WORDS else short[i : i + 1] if n else none for i, (a, n) in enumerate(zip(first.tolist(), count.tolist(), strict=False))]
    bound = np.zeros(len(off), np.int64)
    np.cumsum([len(s) for s in sets], out=bound[1:])
    return (np.concatenate(sets) if sets else none), bound


def minima(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(sets, HASHES) minima; at: where each non-empty set begins."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at), HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat(low * _A[i] + _B[i], at)
    return out


def pack(found: np.ndarray) -> np.ndarray:
    """BITS low bits of each minimum after mixing, as (sets, HASHES * BITS / 8) bytes."""
    bits = ((found * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)
    per = 8 // BITS
    bits = bits.reshape(len(found), HASHES // per, per) << (np.arange(per, dtype=np.uint8) * BITS)
    return np.bitwise_or.reduce(bits, axis=2)


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) keys, each of ``rows`` minima."""
    keys = np.zeros((len(found), bands), np.uint64)
    for k in range(rows):
        keys += found[:, k : bands * rows : rows].astype(np.uint64) * _ODD[30 + k]
    return _scan.mix64(keys + np.arange(bands, dtype=np.uint64) * _ODD[40])


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures, row by row, corrected for fields that agree by chance."""
    differ = a ^ b
    for k in range(1, BITS):
        differ = differ | ((a ^ b) >> np.uint8(k))
    mask = np.uint8(sum(1 << (k * BITS) for k in range(8 // BITS)))
    same = 1 - np.bitwise_count(differ & mask).sum(axis=1, dtype=np.int64) / HASHES
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def least_estimate(threshold: float, deviations: float = 4.0) -> float:
    """What a pair at the threshold is estimated at, less so many standard deviations."""
    chance = 2.0**-BITS
    agree = threshold + (1 - threshold) * chance
    return threshold - deviations * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in _scan.chunks(batch.column("text")):
            values, bound = shingles(data, off)
            n = np.diff(bound)
            full = np.flatnonzero(n)
            at = bound[:-1][full]
            found = minima(values, at)
            keys = band_keys(found, BANDS, ROWS)
            f1, f2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
            if len(full):
                f1[full] = np.add.reduceat(_scan.mix64(values ^ _ODD[50]), at)
                f2[full] = np.bitwise_xor.reduceat(_scan.mix64(values ^ _ODD[51]), at)
            held = np.zeros(j - i, np.int32)
            held[full] = 1
            ends = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(i, j - i),
                    "n": pa.array(n),
                    "f1": pa.array(f1.view(np.int64)),
                    "f2": pa.array(f2.view(np.int64)),
                    "sig": pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends * np.int32(HASHES * BITS // 8)), pa.py_buffer(pack(found).tobytes())]),
                    "bands": pa.ListArray.from_arrays(pa.array(ends * np.int32(BANDS)), pa.array(keys.ravel().view(np.int64))),
                }
            )


def _matrix(column: pa.Array) -> np.ndarray:
    data, off = _scan.text_buffers(column)
    return data[off[0] : off[-1]].reshape(len(column), HASHES * BITS // 8)


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = similarity(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")))
                keep = pa.array(found >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], ["a", "b", "est"]).filter(keep)

    return run


# --- confirmation on full sets -----------------------------------------------------------------------------------


def _bloom_bits(ids: np.ndarray, size: int) -> np.ndarray:
    h = _scan.mix64(ids.astype(np.int64).view(np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((h[:, None] + step[:, None] * np.arange(4, dtype=np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def bloom_filter(ids: DataFrame, most_bits: int = 1 << 27) -> tuple[np.ndarray, int]:
    """A Bloom filter of the column id, 16 bits an id, ``most_bits`` at most; its words come to the driver."""
    size = 1 << max(16, min(most_bits.bit_length() - 1, (16 * max(1, ids.count()) - 1).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bloom_bits(batch.column("id").to_numpy(), size).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["word", "bits"])

    found = ids.mapInArrow(lean(words), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size >> 5, np.uint32)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return table, size


def in_bloom(ids: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    at = _bloom_bits(ids, size)
    return ((table[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)).all(axis=1)


def _sets(bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bloom(batch.column("doc_id").to_numpy(), *bloom.value)
            batch = batch.filter(pa.array(keep))
            for i, j, data, off in _scan.chunks(batch.column("text")):
                values, bound = shingles(data, off)
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(bound * 8), pa.py_buffer(values.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), sets.cast(pa.binary())], ["id", "set"])

    return run


def _fine(bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bloom(batch.column("doc_id").to_numpy(), *bloom.value)))
            for i, j, data, off in _scan.chunks(batch.column("text")):
                values, bound = shingles(data, off)
                full = np.flatnonzero(np.diff(bound))
                keys = band_keys(minima(values, bound[:-1][full]), FINE, FINE_ROWS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * np.int32(FINE)), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).take(pa.array(full)), lists], ["id", "fine"])

    return run


def _similar(x: pa.Scalar, y: pa.Scalar, percent: int) -> bool:
    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(p) + len(q) - both)


def _confirmed(percent: int):
    """Rows come head by head: the head's own first, then its members with their sets; a task holds one head's set and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, None
        for batch in batches:
            found = []
            for b, a, own in zip(batch.column("b").to_pylist(), batch.column("a").to_pylist(), batch.column("set"), strict=True):
                if a is None:
                    head, held = b, pa.scalar(own.as_py(), pa.binary())
                elif head == b and _similar(own, held, percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _of_named(documents: DataFrame, ids: DataFrame, rows, schema: str) -> DataFrame:
    """What ``rows`` makes of the documents that ``ids`` (distinct, column id) names; kept in the checkpoint folder."""
    ids = cut(ids)
    ids = fitted(ids, ids.count())
    bloom = documents.sparkSession.sparkContext.broadcast(bloom_filter(ids))
    near = documents.where(F.col("doc_id").isNotNull()).mapInArrow(lean(rows(bloom)), schema)
    return cut(near.join(ids, "id", "left_semi"))


def full_sets(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """id and set of the documents that ``ids`` (distinct, column id) names."""
    return _of_named(documents, ids, _sets, "id long, set binary")


def confirm(documents: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose full sets reach the similarity; kept in the checkpoint folder.

    A set travels once for each pair that it is a's of, and b's set once for each ``MEMBERS`` of its pairs, so that a head of many neither comes
    to one task nor goes out with each member.
    """
    pairs = cut(pairs)
    pairs = fitted(pairs, pairs.count(), 20_000)
    sets = full_sets(documents, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    many = cut(pairs.groupBy("b").agg(F.count("*").alias("m")).where(F.col("m") > MEMBERS))  # one for each MEMBERS pairs at most
    side = F.broadcast(many) if many.count() <= 10_000 else many
    dealt = pairs.join(side, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce(F.ceil(F.col("m") / MEMBERS), F.lit(1))).alias("salt"))
    members = dealt.join(sets.withColumnRenamed("id", "a"), "a").select("b", "salt", "a", "set")
    heads = dealt.select("b", "salt").distinct().join(sets.withColumnRenamed("id", "b"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "set")
    rows = heads.union(members).repartition("b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    return cut(rows.select("b", "a", "set").mapInArrow(lean(_confirmed(percent)), "a long, b long").distinct())


# --- components --------------------------------------------------------------------------------------------------


def fitted(frame: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """The frame in no more partitions than its number of rows asks for: what goes over from one to the next is a file each."""
    return frame.coalesce(max(2, -(-rows // each)))


def components(links: DataFrame) -> DataFrame:
    """(u, label) for each node of the links (a, b) but the smallest of its component, which is the label."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state, n = None, edges.count()
    while True:
        edges = fitted(edges, n)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = fitted(fitted(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), n).distinct(), n)
        least = fitted(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = fitted(large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")), n)
        edges = cut(fitted(small.union(least).distinct(), n))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select("u", F.col("v").alias("label"))
        state, n = now, now["n"]


# --- pairs that cross components ---------------------------------------------------------------------------------


def _bucket_pairs(label: np.ndarray, block: np.ndarray, sig: np.ndarray, bounds: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one bucket with different labels that may reach the threshold; bounds: where buckets begin and end."""
    found = []

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        fit = label[x] != label[y]
        fit &= ~((block[x] >= 0) & (block[x] == block[y]))
        x, y = x[fit], y[fit]
        keep = similarity(sig[x], sig[y]) >= least
        found.append((x[keep], y[keep]))

    sizes = np.diff(bounds)
    small = np.repeat(sizes <= 64, sizes)
    left = np.repeat(bounds[1:], sizes) - np.arange(len(label))
    for d in range(1, 64):
        x = np.flatnonzero(small & (left > d))
        if not len(x):
            break
        compare(x, x + d)
    for k in np.flatnonzero(sizes > 64):
        own = np.arange(bounds[k], bounds[k + 1])
        values, count = np.unique(label[own], return_counts=True)
        for x in own[label[own] != values[count.argmax()]]:  # the others against all
            compare(np.full(len(own), x), own)
    return found


def _by_bucket(handle):
    """Hands whole buckets (rows sorted by key, lo and hi) as tables to ``handle``; one bucket may lie in several batches."""

    def groups(table: pa.Table) -> list[np.ndarray]:
        return [table.column(x).to_numpy() for x in ("key", "lo", "hi")]

    def whole(table: pa.Table) -> pa.RecordBatch:
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([g[1:] != g[:-1] for g in groups(table)])
        return handle(table.combine_chunks().to_batches()[0], np.append(np.flatnonzero(new), table.num_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [g[-1] for g in groups(pa.Table.from_batches([batch]))]
            if kept and [g[0] for g in groups(pa.Table.from_batches([kept[-1].slice(0, 1)]))] == last:
                kept.append(batch)  # all of it goes on with the bucket that is kept
                continue
            table = pa.Table.from_batches([*kept, batch])
            start = int(np.argmax(np.logical_and.reduce([g == v for g, v in zip(groups(table), last, strict=True)])))
            if start:
                yield whole(table.slice(0, start))
            kept = table.slice(start).to_batches()
        if kept:
            yield whole(pa.Table.from_batches(kept))

    return run


def _pairs_of(batch: pa.RecordBatch, bounds: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    lo, hi, block = (batch.column(x).to_numpy() for x in ("lo", "hi", "block"))
    found = _bucket_pairs(batch.column("label").to_numpy(), np.where(lo == hi, -1, block), _matrix(batch.column("sig")), bounds, least)
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


_ACTIVE = ("key", "lo", "hi", "block", "cid", "label")


def _active(least: float):
    def handle(batch: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        rows = pa.array(np.unique(np.concatenate(_pairs_of(batch, bounds, least))))
        return batch.select(_ACTIVE).take(rows)

    return _by_bucket(handle)


def _links(least: float, percent: int):
    def handle(batch: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
        x, y = _pairs_of(batch, bounds, least)
        # a pair with several buckets in common belongs to the one with the smallest key
        bands = batch.column("bands").flatten().to_numpy().reshape(batch.num_rows, BANDS)
        first = np.concatenate([np.where(bands[x[i : i + 4096]] == bands[y[i : i + 4096]], bands[x[i : i + 4096]], np.iinfo(np.int64).max).min(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])
        key = batch.column("key").to_numpy()[x]
        split = np.concatenate([~(bands[x[i : i + 4096]] == key[i : i + 4096, None]).any(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, bool)])
        own = (first == key) | split
        cid, label, sets = batch.column("cid").to_numpy(), batch.column("label").to_numpy(), batch.column("set")
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for i, j in zip(x[own].tolist(), y[own].tolist(), strict=True):
            two = (min(label[i], label[j]), max(label[i], label[j]))
            if two not in found and _similar(sets[i], sets[j], percent):  # one link joins two components
                found[two] = (cid[i], cid[j])
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found.values()], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _by_bucket(handle)


def _mixed(known: DataFrame) -> DataFrame:
    """key, m (classes), size (bytes of their sets), most (the largest component with the same) and labels of the buckets with several components."""
    kinds = known.groupBy("key", "label").agg(F.count("*").alias("n"), (8 * F.sum("n")).alias("size"))
    return kinds.groupBy("key").agg(F.sum("n").alias("m"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("most"), F.count("*").alias("labels")).where("labels > 1")


def _crossing_links(documents: DataFrame, multi: DataFrame, labels: DataFrame, classes: DataFrame, least: float, percent: int) -> DataFrame:
    """Links (a, b) between classes of one bucket and different components, confirmed where the buckets are.

    First only signatures travel, and show which classes have a partner whose estimate reaches ``least``; then these
    travel with their sets.  What comes out is a link for each two components of a bucket at most, never its pairs.
    """
    known = cut(multi.join(labels.withColumnRenamed("u", "cid"), "cid", "left").select("key", "cid", "n", F.coalesce("label", "cid").alias("label")))
    mixed = cut(_mixed(known))
    if not mixed.where(F.col("m") > SPLIT).isEmpty():
        # a pair at the threshold has sizes of this step or the next, and its smaller step's part is where it meets
        step = F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int")
        beyond = mixed.where(F.col("m") > SPLIT).select("key")
        large = cut(known.join(beyond, "key"))
        fine = _of_named(documents, large.select(F.col("cid").alias("id")).distinct(), _fine, "id long, fine array<long>").withColumnRenamed("id", "cid")
        large = large.join(fine, "cid").select("key", "cid", "n", "label", "fine", F.explode(F.array(step, step + 1)).alias("step"))
        large = large.select("key", "cid", "n", "label", "step", F.explode("fine").alias("second"))
        parts = cut(large.select(F.xxhash64("key", "second", "step").alias("key"), "cid", "n", "label").distinct())
        known = known.join(beyond, "key", "left_anti").union(parts)
        mixed = cut(mixed.where(F.col("m") <= SPLIT).union(_mixed(parts)))
    rows = known.drop("n").join(mixed.select("key", "m", "size", "most"), "key").join(classes.select("cid", "sig"), "cid")
    # the component with the most members comes in blocks of its own, which meet the others' blocks but not each other
    of_most, one = F.col("label") == F.col("most.label"), (F.col("m") <= BLOCK) & (F.col("size") <= BLOCK_BYTES)
    few, many = (F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int") for n, size in ((F.col("m") - F.col("most.n"), F.col("size") - F.col("most.size")), (F.col("most.n"), F.col("most.size"))))
    place = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    rows = rows.withColumn("block", F.when(one, 0).when(of_most, few + place(many)).otherwise(place(few)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(one, 0).when(of_most, few - 1).otherwise(few + many - 1))))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cid", "label", "sig")
    order = ("key", "lo", "hi")
    active = cut(rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(lean(_active(least)), "key long, lo int, hi int, block int, cid long, label long").distinct())
    sets = full_sets(documents, active.select(F.col("cid").alias("id")).distinct())
    rows = active.join(classes.select("cid", "sig", "bands"), "cid").join(sets.withColumnRenamed("id", "cid"), "cid")
    rows = rows.select(*_ACTIVE, "sig", "bands", "set").repartition(*order).sortWithinPartitions(*order)
    return cut(rows.mapInArrow(lean(_links(least, percent)), "a long, b long").distinct())


def near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of documents."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least = least_estimate(percent / 100)
    signed = cut(documents.mapInArrow(lean(_signed), _SIGNED))
    full = signed.where("n > 0")
    classes = cut(full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    members = full.select("doc_id", "n", "f1", "f2").join(classes.select("n", "f1", "f2", "cid"), ["n", "f1", "f2"]).select("doc_id", "n", "cid")
    named = classes.where("cid is not null")
    sigs = named.select("cid", "sig")

    bands = named.select("cid", "copies", "n", F.explode("bands").alias("key"))
    heads = bands.groupBy("key").agg(F.max(F.struct(F.col("copies"), (-F.col("cid")).alias("minus"))).alias("head"), F.count("*").alias("m")).where("m > 1")
    multi = cut(bands.join(heads, "key").select("key", "cid", "n", (-F.col("head.minus")).alias("head")))

    stars = multi.where("cid != head").select(F.col("cid").alias("a"), F.col("head").alias("b")).distinct()
    stars = stars.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b")
    near = stars.select("a", "b", "sig_a", "sig_b").mapInArrow(lean(_estimated(least)), "a long, b long, est double")
    best = near.groupBy("a").agg(F.max(F.struct(F.col("est"), (-F.col("b")).alias("minus"))).alias("x")).select("a", (-F.col("x.minus")).alias("b"))
    links = confirm(documents, best, percent)
    labels = components(links)

    more = _crossing_links(documents, multi, labels, named, least, percent)
    versions = members.groupBy("doc_id").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x != y").select("doc_id")
    one_document = members.join(versions, "doc_id").select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))
    final = components(labels.select(F.col("u").alias("a"), F.col("label").alias("b")).union(more).union(one_document))

    linked = members.join(final.withColumnRenamed("u", "cid"), "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "cid").alias("component_id"))
    alone = signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(documents: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of documents that near_duplicates keeps, with all their columns, each doc_id once.

    Only rows that a Bloom filter of the doc_ids to drop or to look at again points to are dealt out.  Rows with a null doc_id and
    texts without a word all stay; of rows that repeat a doc_id one stays; an empty table gives no rows.
    """
    pointer, place = fresh(documents.columns, "__pointed", "__k")
    spark = documents.sparkSession
    found = cut(near_duplicates(documents, percent))
    drop = found.where("not kept").select("doc_id")
    twice = found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    look = cut(drop.union(twice).where("doc_id is not null").distinct().select(F.col("doc_id").alias("id")))
    bloom = spark.sparkContext.broadcast(bloom_filter(look))
    gone = drop.where("doc_id is not null").distinct()

    def pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            hit = in_bloom(ids.fill_null(0).to_numpy(zero_copy_only=False), *bloom.value) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, pointer])

    keyed = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = keyed.mapInArrow(lean(pointed), StructType([*keyed.schema.fields, StructField(pointer, BooleanType())]))
    clear = rows.where(~F.col(pointer)).drop(pointer)
    order = Window.partitionBy("doc_id").orderBy(*[F.col(f"`{c}`") for c in documents.columns if c != "doc_id"])
    again = rows.where(F.col(pointer)).drop(pointer).join(gone, "doc_id", "left_anti").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return clear.unionByName(again)


def one_of_each_text(documents: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each group of near copies, with all its columns: that with the smallest doc_id, null last.

    Rows go by a key of 63 bits from doc_id and text: a null doc_id hides no copy, and a doc_id with two texts has two
    keys and joins no groups.  Of equal rows one stays; texts without a word are no copies of others, and rows without
    a word and a doc_id all stay.
    """
    key, pointer, place, again = fresh(documents.columns, "__key", "__pointed", "__k", "__twice")
    keyed = documents.withColumn(key, F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), 1))
    found = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), percent)
    found = found.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("component"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    ids = keyed.groupBy(F.col(key).alias("key")).agg(F.min(F.col("doc_id").cast("long")).alias("id"))
    members = cut(found.join(ids, "key"))
    # a component's members are never dealt out by it: what stays is found by aggregation, what goes by the members' own keys
    best = cut(members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))).alias("x")).select(F.col("x.key").alias("key")))
    drop = cut(members.select("key").join(best, "key", "left_anti").withColumnRenamed("key", key))
    twice = cut(members.where("rows > 1 and (n > 0 or id is not null)").select("key").join(best, "key", "left_semi").select(F.col("key").alias(key), F.lit(True).alias(again)))
    bloom = documents.sparkSession.sparkContext.broadcast(bloom_filter(drop.union(twice.select(key)).select(F.col(key).alias("id"))))

    def pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bloom(batch.column(key).to_numpy(), *bloom.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, pointer])

    rows = keyed.mapInArrow(lean(pointed), StructType([*keyed.schema.fields, StructField(pointer, BooleanType())]))
    order = Window.partitionBy(key).orderBy(*[F.col(f"`{c}`") for c in documents.columns])
    other = rows.where(F.col(pointer)).join(drop, key, "left_anti").join(twice, key, "left").withColumn(place, F.row_number().over(order))
    other = other.where((F.col(place) == 1) | F.col(again).isNull())
    own = [F.col(f"`{c}`") for c in documents.columns]
    return rows.where(~F.col(pointer)).select(own).unionByName(other.select(own))
