"""Work on many whole keys at a time: rows are dealt by key and sorted, and a task's arrays hold some thousands of rows, so neither small keys cost a call of Spark's
each nor do rounds over a key travel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of whole keys that are worked on together, about.  A key with more is worked on alone.
ROWS = 1 << 14

_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def by_keys(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, work, most: int = ROWS) -> DataFrame:
    """What ``work`` gives for whole keys: a function of their columns as arrays by name and of the places where keys begin (and the end), that gives arrays in the
    schema's order, masked where null.

    Keys are longs without nulls; a null among numbers is NaN.  A task holds some keys' named columns, and a longer key's alone.
    """
    fields = [tuple(part.split(" ")) for part in schema.split(", ")]
    names, types = [f[0] for f in fields], [_KINDS[f[1]] for f in fields]
    wanted = list(dict.fromkeys([*keys, *order, *columns]))

    def changes(own: dict[str, np.ndarray]) -> np.ndarray:
        return np.flatnonzero(np.logical_or.reduce([own[k][1:] != own[k][:-1] for k in keys])) + 1

    def done(own: dict[str, np.ndarray]) -> pa.RecordBatch:
        found = work(own, np.array([0, *changes(own), len(own[keys[0]])]))
        arrays = [pa.array(x.data, kind, mask=np.ma.getmaskarray(x)) if isinstance(x, np.ma.MaskedArray) else pa.array(x, kind) for x, kind in zip(found, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict[str, np.ndarray]] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # a batch's memory isn't this one's when the next has come
            parts.append({c: np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in wanted})
            held += batch.num_rows
            if held >= most and any(parts[0][k][0] != parts[-1][k][-1] for k in keys):
                own = {c: np.concatenate([p[c] for p in parts]) for c in wanted}
                cut = changes(own)[-1]
                yield done({c: v[:cut] for c, v in own.items()})
                parts, held = [{c: v[cut:] for c, v in own.items()}], held - cut
        if held:
            yield done({c: np.concatenate([p[c] for p in parts]) for c in wanted})

    # as many tasks as a shuffle has: what one does follows from the work, not from the bytes of what it reads
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*wanted).repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def in_step(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, start, step) -> DataFrame:
    """A recurrence over each key's rows in order, like ``ordered.streamed``, with the keys of a batch side by side: ``step(state, columns)`` takes arrays with an entry
    for each key and gives the new state (a tuple of arrays) and the arrays that come out, ``start(n)`` the state of n keys before their first row.

    A task holds a batch and one state a key of it, however long a key is.  schema: the keys, then what comes out; columns are numbers, null as NaN.
    """
    fields = [tuple(part.split(" ")) for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).to_pylist() for k in keys]
            named = list(zip(*own, strict=True))
            starts = np.array([0, *[i for i in range(1, len(named)) if named[i] != named[i - 1]]])
            sizes = np.diff(np.append(starts, len(named)))
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            state = start(len(starts))
            if named[0] == held:
                for s, x in zip(state, last, strict=True):
                    s[0] = x
            out: list[np.ndarray] = []
            for k in range(int(sizes.max())):
                which = np.flatnonzero(sizes > k)
                at = starts[which] + k
                new, found = step(tuple(s[which] for s in state), [v[at] for v in values])
                for s, x in zip(state, new, strict=True):
                    s[which] = x
                out = out or [np.empty(len(named), f.dtype) for f in found]
                for o, f in zip(out, found, strict=True):
                    o[at] = f
            held, last = named[-1], [s[-1].copy() for s in state]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(o, _KINDS[kind]) for o, (_, kind) in zip(out, fields[len(keys) :], strict=True)]], [name for name, _ in fields])

    return rows.select(*dict.fromkeys([*keys, *order, *columns])).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def each_key(fit, keys: list[str], columns: list[str], kinds: list[type]):
    """``work`` for ``by_keys`` from a function of one key's columns that gives arrays: the keys come before them."""

    def work(own: dict[str, np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
        found, at, sizes = [], [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            out = fit(*[own[c][a:b] for c in columns])
            if len(out[0]):
                found.append(out)
                at.append(a)
                sizes.append(len(out[0]))
        return [*[np.repeat(own[k][at], sizes) if at else np.zeros(0, np.int64) for k in keys], *[np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind) for i, kind in enumerate(kinds)]]

    return work


def pmod(x: np.ndarray, period: float) -> np.ndarray:
    """x less whole periods, in [0, period), as SQL's pmod has it."""
    out = np.mod(x, period)
    return np.where(out == period, 0.0, out)


def wrapped(x: np.ndarray, period: float) -> np.ndarray:
    """x less whole periods, in [-period / 2, period / 2)."""
    return pmod(x + period / 2, period) - period / 2


def half_up(x: np.ndarray) -> np.ndarray:
    """The nearest whole number, halves away from zero."""
    near = np.rint(x)
    return np.where(np.abs(x - np.trunc(x)) == 0.5, np.trunc(x) + np.sign(x), near)


def later(t: np.ndarray, reach: float, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and j of all pairs with 0 < t[j] - t[i] <= reach in a sorted t, some i at a time."""
    first = np.searchsorted(t, t, "right")
    many = np.searchsorted(t, t + reach, "right") - first
    before = np.cumsum(many)
    start = 0
    while start < len(t):
        stop = max(start + 1, int(np.searchsorted(before, (before[start - 1] if start else 0) + most, "right")))
        own = many[start:stop]
        i = np.repeat(np.arange(start, min(stop, len(t))), own)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own) + first[i]
        start = stop


def line(t: np.ndarray, v: np.ndarray) -> tuple[float, float] | None:
    """Slope and intercept of the least-squares line, None for points of one time."""
    x, y = t - t.mean(), v - v.mean()
    spread = float((x * x).sum())
    if not spread > 0:
        return None
    slope = float((x * y).sum()) / spread
    return slope, float(v.mean()) - slope * float(t.mean())


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashed(*columns: np.ndarray) -> np.ndarray:
    """SQL's xxhash64 of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    seed = np.full(len(columns[0]), 42, np.uint64)
    for column in columns:
        h = (seed + p5 + np.uint64(8)) ^ (_rotated(column.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        h = _rotated(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        seed = h ^ (h >> np.uint64(32))
    return seed.view(np.int64)


def sums(cell: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of the values of each of n cells; NaN counts nothing, as null in SQL."""
    return np.bincount(cell, np.where(np.isnan(values), 0.0, values), minlength=n)[:n]
