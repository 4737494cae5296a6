"""Vectorised scanning of Arrow text columns: byte spans, their hashes, and lookups by hash.

Everything works on the UTF-8 bytes of whole texts, a few megabytes at a time, so memory does not follow
the size of an Arrow batch.  Span hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_SPAN_BYTES = 1 << 20


def _splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


mix64 = _splitmix
_BYTE = _splitmix(np.arange(256) + 1000)
_PLACE = _splitmix(np.arange(4096) + 9000) | np.uint64(1)

#: ASCII white space: U+0020 and U+0009 to U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes as they are."""
    return _LOWER[data]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, end row, bytes, offsets from 0."""
    data, off = text_buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and for each text the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = off[:-1][off[:-1] < len(data)]
    first[at] |= word[at]
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = off[1:][off[1:] > 0] - 1
    last[before] |= word[before]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The elements of all spans, one after another."""
    total = int(lengths.sum())
    at = np.cumsum(lengths) - lengths
    return data[np.arange(total) + np.repeat(starts - at, lengths)]


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow string column."""
    lengths = ends - starts
    off = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=off[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(off.tobytes()), pa.py_buffer(gather(data, starts, lengths).tobytes()))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span."""
    out = np.empty(len(starts), np.uint64)
    total = np.cumsum(ends - starts)
    i = 0
    while i < len(starts):
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + _SPAN_BYTES, "right")))
        lengths = ends[i:j] - starts[i:j]
        at = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        value = _BYTE[data[place + np.repeat(starts[i:j], lengths)]]
        value *= _PLACE[place] if int(lengths.max()) <= len(_PLACE) else _splitmix(place + 9000) | np.uint64(1)
        out[i:j] = np.add.reduceat(value, at)
        i = j
    return _splitmix(out)


def hash_strings(column: pa.Array) -> np.ndarray:
    """hash_spans of each (non-empty) string of a column."""
    data, off = text_buffers(column)
    return hash_spans(data, off[:-1], off[1:])


def sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; first has one end entry more than there are groups."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class HashIndex:
    """Places of 64-bit keys in the order they were added; open addressing in a numpy table."""

    def __init__(self, keys: np.ndarray | None = None) -> None:
        self.keys = np.zeros(0, np.uint64)
        self._size(1024)
        if keys is not None and len(keys):
            self.add(np.asarray(keys, np.uint64))

    def __len__(self) -> int:
        return len(self.keys)

    def _size(self, size: int) -> None:
        self.table = np.full(size, -1, np.int32)
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), size - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _place(self, first: int) -> None:
        left = np.arange(first, len(self.keys), dtype=np.int32)
        slot = self._slot(self.keys[left])
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            more = self.table[slot] != left
            left, slot = left[more], (slot[more] + 1) & self.mask

    def add(self, keys: np.ndarray) -> None:
        """keys: distinct, none of them there yet."""
        first, self.keys = len(self.keys), np.concatenate([self.keys, keys])
        if 2 * len(self.keys) > len(self.table):
            self._size(1 << (4 * len(self.keys) - 1).bit_length())
            first = 0
        self._place(first)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        slot = self._slot(keys)
        seen = self.table[slot]
        hit = (seen >= 0) & (self.keys[seen] == keys)
        out[hit] = seen[hit]
        left = np.flatnonzero((seen >= 0) & ~hit)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            seen = self.table[slot]
            hit = (seen >= 0) & (self.keys[seen] == keys[left])
            out[left[hit]] = seen[hit]
            more = (seen >= 0) & ~hit
            left, slot = left[more], slot[more]
        return out
