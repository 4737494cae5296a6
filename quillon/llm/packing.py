"""Best-fit packing of tokenised documents into fixed sequences, after Martello-Toth dominance reduction.

Only a document longer than a sequence is cut; its first piece takes the remainder, so all others are full.
A packing depends on lengths alone, and there are at most ``size`` of them.  So the instance is a histogram of
at most ``size`` counts: it is summed by Spark, solved on the driver as runs of equal bins (a run repeats one
set of lengths), and handed back as a table of slots whose size depends on ``size``, not on the input.  Every
piece gets its rank among those of its length, from per-partition counts and their running sums, and takes
the slot of that rank.

Dominance (procedure MTRP): taking lengths downward, a bin that must hold a piece of length w can be fixed for
good if its fill is provably as good as any other: w alone if nothing fits beside it; w with the largest piece
that fits, if that piece fills it fully or no two other pieces fit beside w; the reduced instance goes to
best-fit decreasing.

Defined results: null or empty text is one piece that holds the end id; repeated rows are packed each; a null
doc_id stays null; other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import _scan
from quillon.llm._bpe import encoder
from quillon.llm._spark import cut, lean

Run = tuple[tuple[int, ...], int]

_PIECES = "pid int, doc_id long, piece int, start long, length int, ids_crc32 long, local long"


def _pieces(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = encoder(path), np.zeros(size + 1, np.int64)
        for batch in batches:
            for i, j, data, off in _scan.chunks(batch.column("text")):
                ids, bound = model.encode(data, off)
                ids = np.insert(ids, bound[1:], end_id).astype("<u4")
                bound = bound + np.arange(len(bound))
                lengths = np.diff(bound)
                count = -(-lengths // size)
                doc = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = (lengths - 1) % size + 1
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * size)
                length = np.where(piece == 0, head[doc], size)
                raw = memoryview(ids.tobytes())
                at = 4 * (bound[doc] + start)
                crc = np.fromiter((zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), (4 * length).tolist(), strict=True)), np.int64, len(at))
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                local = np.empty(len(length), np.int64)
                local[order] = np.arange(len(order)) - np.searchsorted(sorted_, sorted_) + seen[sorted_]
                seen += np.bincount(length, minlength=size + 1)
                rows = batch.slice(i, j - i)
                yield pa.RecordBatch.from_pydict(
                    {
                        "pid": rows.column("pid").take(pa.array(doc)),
                        "doc_id": rows.column("doc_id").take(pa.array(doc)),
                        "piece": pa.array(piece.astype(np.int32)),
                        "start": pa.array(start),
                        "length": pa.array(length.astype(np.int32)),
                        "ids_crc32": pa.array(crc),
                        "local": pa.array(local),
                    }
                )

    return run


def cut_pieces(documents: DataFrame, tokenizer_path: str, size: int, end_id: int) -> DataFrame:
    """A row for each piece; local: its rank among the pieces of its length in its partition."""
    rows = documents.select(F.spark_partition_id().alias("pid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_pieces(tokenizer_path, size, end_id)), _PIECES)


class _Left:
    """Counts by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {k: int(v) for k, v in counts.items() if v}
        self.lengths = sorted(self.count)

    def largest(self, room: int) -> int:
        """The largest length that is at most room, or 0."""
        i = bisect.bisect_right(self.lengths, room)
        return self.lengths[i - 1] if i else 0

    def take(self, lengths: tuple[int, ...], times: int = 1) -> None:
        for x in lengths:
            self.count[x] -= times
        for x in set(lengths):
            if not self.count[x]:
                del self.count[x]
                self.lengths.remove(x)

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often this set can be taken."""
        return min(self.count.get(x, 0) // lengths.count(x) for x in set(lengths))


def _beside(left: _Left, room: int, taken: tuple[int, ...]) -> int:
    """The greatest length within the room that is there beside what is taken; 0 if none is."""
    x = left.largest(room)
    while x and left.count[x] <= taken.count(x):
        x = left.largest(x - 1)
    return x


def _smallest(left: _Left, taken: tuple[int, ...], n: int, size: int) -> int:
    """The sum of the n smallest lengths beside what is taken, more than a bin if there aren't as many."""
    total = 0
    for x in left.lengths:
        k = min(n, left.count[x] - taken.count(x))
        total, n = total + k * x, n - k
        if not n:
            return total
    return size + 1


def _dominating(left: _Left, w: int, size: int) -> tuple[int, ...] | None:
    """The content that dominates every other for a bin whose largest piece is w, if one of at most three pieces does.

    Content dominates other content if its pieces, one by one, are at least as great: the others can take each other's places.
    """
    room = size - w
    best = _beside(left, room, (w,))
    if not best:
        return (w,)
    # nothing beats a full bin of two, nor the greatest single partner where two partners don't fit
    if best == room or _smallest(left, (w,), 2, size) > room:
        return (w, best)
    if _smallest(left, (w,), 3, size) <= room:
        return None
    # at most two partners: the greatest single one, with the greatest beside it, dominates if no pair has a greater second piece
    other = _beside(left, room - best, (w, best))
    second = room // 2
    while second := _beside(left, second, (w,)):
        if left.count[second] - (second == w) > 1 or _beside(left, room - second, (w, second)) >= second:
            break
        second -= 1
    if other and second <= other:
        return (w, best, other)
    pairs = [x + _beside(left, room - x, (w, x)) for x in left.lengths if x < room and left.count[x] > (x == w) and _beside(left, room - x, (w, x))]
    return (w, best) if max(pairs, default=0) <= best else None


def reduce_by_dominance(left: _Left, size: int) -> list[Run]:
    """Takes out of ``left`` the bins whose content, of up to three pieces, dominates every other for their largest piece, in passes until
    one changes nothing: a bin that is fixed may leave others without a choice."""
    fixed: list[Run] = []
    changed = True
    while changed:
        changed = False
        for w in sorted(left.lengths, reverse=True):
            while left.count.get(w, 0) and (bin_ := _dominating(left, w, size)):
                times = left.times(bin_)
                left.take(bin_, times)
                fixed.append((bin_, times))
                changed = True
    return fixed


def best_fit_decreasing(left: _Left, size: int) -> list[Run]:
    """Every piece, the longest first, goes to the bin with the least room that still takes it, else to a new one.

    Bins with the same content are one entry with a count, so a length costs as many steps as there are kinds of bins.
    """
    kinds: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if times:
            if room not in kinds:
                kinds[room] = []
                bisect.insort(rooms, room)
            kinds[room].append((lengths, times))

    for x in sorted(left.count, reverse=True):
        count = left.count[x]
        while count:
            i = bisect.bisect_left(rooms, x)
            if i == len(rooms):
                bins, rest = divmod(count, size // x)
                put(size % x, (x,) * (size // x), bins)
                put(size - rest * x, (x,) * rest, int(rest > 0))
                break
            room = rooms[i]
            lengths, times = kinds[room].pop()
            if not kinds[room]:
                del kinds[room]
                rooms.pop(i)
            fit = room // x
            bins = min(times, count // fit)
            put(room - fit * x, lengths + (x,) * fit, bins)
            count -= bins * fit
            times -= bins
            if times and count:
                put(room - count * x, lengths + (x,) * count, 1)
                count, times = 0, times - 1
            put(room, lengths, times)
    return [run for found in kinds.values() for run in found]


def solve(counts: dict[int, int], size: int) -> list[Run]:
    """Runs (lengths in a bin, number of such bins) that hold every piece of the histogram."""
    left = _Left(counts)
    return reduce_by_dominance(left, size) + best_fit_decreasing(left, size)


def slot_table(runs: list[Run], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks, first sequence ids, steps (pieces of this length in a bin), and offsets of its slots."""
    slots: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for lengths, times in runs:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, places in offsets.items():
            slots.setdefault(x, []).append((rank.get(x, 0), sequence, len(places), places))
            rank[x] = rank.get(x, 0) + len(places) * times
        sequence += times
    return {x: (np.array([s[0] for s in found]), np.array([s[1] for s in found]), np.array([s[2] for s in found]), np.concatenate([s[3] for s in found]), np.cumsum([0] + [len(s[3]) for s in found])[:-1]) for x, found in slots.items()}


def _placed(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                first, base, step, places, at = table.value[int(x)]
                own = np.flatnonzero(length == x)
                k = np.searchsorted(first, rank[own], "right") - 1
                n = rank[own] - first[k]
                sequence[own] = base[k] + n // step[k]
                offset[own] = places[at[k] + n % step[k]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece"), batch.column("start"), batch.column("length").cast(pa.int64()), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack_documents(documents: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    spark = documents.sparkSession
    pieces = cut(cut_pieces(documents, tokenizer_path, size, end_id))
    counts = pieces.groupBy("pid", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slot_table(solve(histogram, size), size))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["pid", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(lean(_placed(table)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
