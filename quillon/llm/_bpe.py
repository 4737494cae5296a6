"""Byte-level BPE ids of whole texts with the tokenizers library, each distinct segment encoded once a process.

The pre-tokenizer of the vocabulary always cuts between a character that is surely no white space and a space
or line feed after it, so a text's ids are the ids of the segments between such places, one after another.
Segments are found and looked up by hash in numpy; the library encodes those not seen before.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quillon.llm import _scan

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part

#: Distinct segments that a process keeps, the first that it meets; others are encoded for the few megabytes at hand.
KEPT = 1 << 18
_BATCH = 8192


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and each text's first index."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = np.zeros(len(data), bool)
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[at > 0]
    last = data[at - 1]
    second, third = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    # ASCII, or two bytes U+00C0 to U+07FF, or three bytes in blocks without white space
    sure = (last > 0x20) & (last < 0x7F)
    sure |= (last >= 0x80) & (((second >= 0xC3) & (second <= 0xDF)) | ((second >= 0x80) & (second < 0xC0) & ((third == 0xE0) | ((third >= 0xE4) & (third <= 0xED)))))
    first[at[sure]] = True
    first[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, off)


class SegmentEncoder:
    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.index = _scan.HashIndex()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _append(self, texts: pa.Array) -> None:
        starts, lengths = [self.start], [self.length]
        for i in range(0, len(texts), _BATCH):
            found = [x.ids for x in self.library.encode_batch_fast(texts.slice(i, _BATCH).to_pylist(), add_special_tokens=False)]
            length = np.fromiter(map(len, found), np.int64, len(found))
            new = np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum()))
            if self.used + len(new) > len(self.ids):
                self.ids = np.resize(self.ids, 3 * (self.used + len(new)) // 2)
            self.ids[self.used : self.used + len(new)] = new
            starts.append(self.used + np.cumsum(length) - length)
            lengths.append(length)
            self.used += len(new)
        self.start, self.length = np.concatenate(starts), np.concatenate(lengths)

    def _forget(self) -> None:
        """Drops the entries that the table has no room for."""
        n = len(self.index)
        self.start, self.length = self.start[:n], self.length[:n]
        self.used = int(self.start[-1] + self.length[-1]) if n else 0

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the n + 1 places at which each text's begin."""
        starts, ends, first = segments(data, off)
        keys = _scan.hash_spans(data, starts, ends)
        place = self.index.find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            distinct, at, which = np.unique(keys[new], return_index=True, return_inverse=True)
            place[new] = len(self.index) + which
            at = new[at]
            self._append(_scan.strings(data, starts[at], ends[at]))
            self.index.add(distinct[: max(0, KEPT - len(self.index))])
        lengths = self.length[place]
        bound = np.zeros(len(off), np.int64)
        np.cumsum(_scan.sum_by(lengths, first), out=bound[1:])
        out = _scan.gather(self.ids, self.start[place], lengths)
        self._forget()
        return out, bound


@lru_cache(maxsize=1)
def encoder(path: str) -> SegmentEncoder:
    """One a process and vocabulary; Python workers are used again, and what they have learned with them."""
    return SegmentEncoder(path)
