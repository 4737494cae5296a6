"""Line and track fitting on point clouds: votes, normal equations, robust lines, and the grouped recurrences."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillon.operators import grouped
from quillon.operators.filters import kalman_start, kalman_step
from quillon.sources.shared import kept


#: Bin of a point without a time or a value: beyond any other, so that it comes last among equals, as null does in SQL.
_NO_BIN = (1 << 31) - 1


class _Cells(NamedTuple):
    """Cells of some keys, in order of key, slope and bin: summed weight, how many weights there were, and points."""

    key: np.ndarray
    slope: np.ndarray
    bin: np.ndarray
    votes: np.ndarray
    known: np.ndarray
    support: np.ndarray

    def take(self, which: np.ndarray) -> _Cells:
        return _Cells(*[x[which] for x in self])

    def summed(self) -> _Cells:
        order = np.lexsort((self.bin, self.slope, self.key))
        key, slope, place, *counts = self.take(order)
        if not len(key):
            return self
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (slope[1:] != slope[:-1]) | (place[1:] != place[:-1])))
        return _Cells(key[at], slope[at], place[at], *[np.add.reduceat(x, at) for x in counts])

    def ranked(self) -> tuple[_Cells, np.ndarray]:
        """The cells of each key, most votes first (ties to more support, then smaller slope and bin; without weights last), and their ranks from 1."""
        found = self.take(np.lexsort((self.bin, self.slope, -self.support, -self.votes, self.known == 0, self.key)))
        return found, np.arange(len(found.key)) - np.searchsorted(found.key, found.key, "left") + 1

    def columns(self) -> list[pa.Array]:
        """slope_index, bin, votes and support."""
        return [pa.array(self.slope, pa.int32()), pa.array(self.bin, pa.int32(), mask=self.bin == _NO_BIN), pa.array(self.votes, mask=self.known == 0), pa.array(self.support, pa.int64())]


def _below(x: np.ndarray, period: float) -> np.ndarray:
    """x less whole periods, rounded as SQL's x - period * floor(x / period) is."""
    return x - period * np.floor(x / period)


def _voting(points: DataFrame, keys: list[str], time: str, value: str, weight: str, slopes: list[float], period: float, bins: int, more: str, out, gate: float | None = None) -> DataFrame:
    """Votes of each key's points, counted in one ordered pass.  Points travel once, one row each, and a task holds the cells of one batch's keys: neither the cells of a
    table nor the points of a key are in memory at a time.  Rows are those of ``out``, a function of finished keys' cells, of the cells that their first
    line leaves and of which keys have a null, which gives each row's key and the columns that ``more`` names after the keys.

    gate: points farther than this from the line of their key's first cell vote a second time, by themselves.  For this each point comes
    twice, the second time when all of its key have been counted.
    """
    turns = np.array(slopes)
    integer = isinstance(points.schema[weight].dataType, IntegralType)
    kind = np.int64 if integer else np.float64

    def cells(g, t, v, w, known):
        with np.errstate(invalid="ignore"):
            place = np.floor(_below(v[:, None] - turns * t[:, None], period) * bins / period).ravel()
        place = np.where(np.isfinite(place), place, _NO_BIN).astype(np.int64)
        repeat = lambda x: np.repeat(x, len(turns))
        return _Cells(repeat(g), np.tile(np.arange(len(turns)), len(g)), place, repeat(w), repeat(known), np.ones(len(place), np.int64))

    def both(one: _Cells, other: _Cells) -> _Cells:
        return _Cells(*map(np.concatenate, zip(one, other, strict=True))).summed()

    def beyond(counted: _Cells, g, t, v, n):
        first, rank = counted.ranked()
        first = first.take((rank == 1) & (first.bin != _NO_BIN))
        slope, middle = np.full(n, np.nan), np.full(n, np.nan)
        slope[first.key], middle[first.key] = turns[first.slope], (first.bin + 0.5) * period / bins
        with np.errstate(invalid="ignore"):
            return np.abs(_below(v - slope[g] * t - middle[g] + period / 2, period) - period / 2) > gate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = _Cells(*[np.zeros(0, x) for x in (np.int64, np.int64, np.int64, kind, np.int64, np.int64)])
        head, counted, left = None, empty, empty

        def done(own: list[pa.Array], starts: np.ndarray, counted: _Cells, left: _Cells) -> pa.RecordBatch:
            heads = [c.take(pa.array(starts)) for c in own]
            null = np.logical_or.reduce([h.is_null().to_numpy(zero_copy_only=False) for h in heads])
            key, columns = out(counted, left, null)
            return pa.RecordBatch.from_arrays([*[h.take(pa.array(key)) for h in heads], *columns], names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            # the key that the last batch ended with comes first, with the cells it has so far
            own = [pa.concat_arrays([h, c]) for h, c in zip(head, batch.columns, strict=False)] if head else batch.columns[: len(keys)]
            new = np.zeros(len(own[0]) - 1, bool)
            for c in own:
                for x in (c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False)):
                    new |= x[1:] != x[:-1]
            starts, g = np.append(0, np.flatnonzero(new) + 1), np.append(0, np.cumsum(new))[-n:]
            t, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_t", "_v"))
            w, known = batch.column("_w").fill_null(0).to_numpy(zero_copy_only=False).astype(kind), batch.column("_w").is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            again = batch.column("_again").to_numpy(zero_copy_only=False) == 1
            counted = both(counted, cells(*[x[~again] for x in (g, t, v, w, known)]))
            if again.any():
                again[again] = beyond(counted, g[again], t[again], v[again], len(starts))
                left = both(left, cells(*[x[again] for x in (g, t, v, w, known)]))
            last = len(starts) - 1
            if last:
                yield done(own, starts[:-1], counted.take(counted.key < last), left.take(left.key < last))
            head = [pa.array(c[-1:].to_pylist(), c.type) for c in own]
            counted, left = (x.take(x.key == last)._replace(key=np.zeros((x.key == last).sum(), np.int64)) for x in (counted, left))
        if head:
            yield done(head, np.zeros(1, np.int64), counted, left)

    kinds = [points.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([*[f"`{k}` {x}" for k, x in zip(keys, kinds, strict=True)], more.replace("number", "long" if integer else "double")])
    names = [*keys, *[part.split(" ")[0] for part in more.split(", ")]]
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.select(*keys, F.col(time).cast("double").alias("_t"), F.col(value).cast("double").alias("_v"), F.col(weight).alias("_w")).repartition(n, *keys)
    rows = dealt.withColumn("_again", F.lit(0) if gate is None else F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.sortWithinPartitions(*keys, "_again").mapInArrow(run, schema)


def hough_votes(points: DataFrame, keys: list[str], time: str, value: str, weight: str, slopes: list[float], period: float, bins: int) -> DataFrame:
    """Summed weight of each (slope, intercept bin); intercepts are taken modulo the period.  A point votes once a slope, in the task that its key is dealt to.
    Keys are numbers; null is a key, too."""
    return _voting(points, keys, time, value, weight, slopes, period, bins, "slope_index int, bin int, votes number, support long", lambda cells, left, null: (cells.key, cells.columns()))


def hough_best(points: DataFrame, keys: list[str], time: str, value: str, weight: str, slopes: list[float], period: float, bins: int, k: int) -> DataFrame:
    """``hough_lines`` of ``hough_votes``, ranked where they are counted."""

    def out(cells, left, null):
        found, rank = cells.ranked()
        found, rank = found.take(rank <= k), rank[rank <= k]
        return found.key, [*found.columns(), pa.array(rank, pa.int32())]

    return _voting(points, keys, time, value, weight, slopes, period, bins, "slope_index int, bin int, votes number, support long, rank int", out)


def hough_banks(points: DataFrame, keys: list[str], time: str, value: str, weight: str, slopes: list[float], period: float, bins: int, k: int, apart: int, gate: float) -> DataFrame:
    """Banks of lines of each key: the first k cells by votes ("ranked"), the first whose slope is at least ``apart`` places from the first cell's ("alternate"), and the first
    by the votes of points farther than the gate from the first cell's line ("residual").  A key with a null has ranked lines alone."""

    def out(cells, left, null):
        found, rank = cells.ranked()
        best = found.slope[rank == 1]  # every key has cells
        other, place = found.take((np.abs(found.slope - best[found.key]) >= apart) & ~null[found.key]).ranked()
        rest, order = left.take(~null[left.key]).ranked()
        banks = [("ranked", found.take(rank <= k), rank[rank <= k]), ("alternate", other.take(place == 1), place[place == 1]), ("residual", rest.take(order == 1), order[order == 1])]
        rows = _Cells(*map(np.concatenate, zip(*[b[1] for b in banks], strict=True)))
        return rows.key, [pa.array([name for name, _, r in banks for _ in r], pa.string()), pa.array(np.concatenate([r for _, _, r in banks]), pa.int32()), *rows.columns()]

    return _voting(points, keys, time, value, weight, slopes, period, bins, "bank string, rank int, slope_index int, bin int, votes number, support long", out, gate)


def hough_lines(votes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k cells with most votes of each key; ties to more support, then smaller slope and bin."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), F.desc("support"), "slope_index", "bin"))
    return votes.withColumn("rank", place).where(F.col("rank") <= k)


def theil_sen(points: DataFrame, keys: list[str], time: str, value: str, reach: int) -> DataFrame:
    """Median slope of pairs at most ``reach`` rows apart, and the median intercept that goes with it."""
    w = Window.partitionBy(*keys).orderBy(time)
    pairs = points.withColumn("_later", F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).over(w.rowsBetween(1, reach)))
    pairs = pairs.select(*keys, time, value, F.explode("_later").alias("y")).where(F.col("y.t") > F.col(time))
    slopes = pairs.groupBy(*keys).agg(F.median((F.col("y.v") - F.col(value)) / (F.col("y.t") - F.col(time))).alias("slope"), F.count("*").alias("pairs"))
    return points.join(slopes, keys).groupBy(*keys, "slope", "pairs").agg(F.median(F.col(value) - F.col("slope") * F.col(time)).alias("intercept"))


def _later_not_above(y: np.ndarray) -> int:
    """Pairs of places i < j with y[j] <= y[i], by halving and looking up each right half in the sorted left one."""
    n = len(y)
    if n <= 64:
        return int(np.triu(y[None, :] <= y[:, None], 1).sum())
    left = np.sort(y[: n // 2])
    return _later_not_above(y[: n // 2]) + _later_not_above(y[n // 2 :]) + int((len(left) - np.searchsorted(left, y[n // 2 :], "left")).sum())


def _turned_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with first[i] < first[j] and second[j] <= second[i]: work and memory follow their number."""
    order = np.lexsort((second, first))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def halves(own: np.ndarray) -> None:
        if len(own) < 2:
            return
        left, right = own[: len(own) // 2], own[len(own) // 2 :]
        halves(left)
        halves(right)
        left = left[np.argsort(second[left], kind="stable")]
        at = np.searchsorted(second[left], second[right], "left")
        many = len(left) - at
        total = int(many.sum())
        if total:
            place = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at, many)
            found.append((left[place], np.repeat(right, many)))

    halves(order)
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    apart = first[i] < first[j]
    return i[apart], j[apart]


def median_slope(t: np.ndarray, v: np.ndarray, listed: int = 4096) -> tuple[float, int]:
    """The exact median of the slopes of all pairs of points with different times, and the number of pairs; NaN without a pair.

    How many slopes are at most s is the number of pairs that v - s t puts in the other order: the median's rank is closed in on by halving s
    until about as many pairs are left as there are points, and only these are listed.
    """
    order = np.lexsort((v, t))
    t, v = t[order].astype(np.longdouble), v[order].astype(np.longdouble)
    _, same = np.unique(t, return_counts=True)
    pairs = len(t) * (len(t) - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not pairs:
        return float("nan"), 0
    _, copies = np.unique(np.stack([t, v]), axis=1, return_counts=True)
    equal = int((copies * (copies - 1) // 2).sum())  # points equal in both are always in the other order
    upto = lambda s: _later_not_above(v - s * t) - equal
    steps = np.diff(np.unique(t))
    high = (v.max() - v.min() + 1) / steps.min()
    low, below, above = -high, 0, pairs
    places = ((pairs - 1) // 2, pairs // 2)
    while above - below > max(listed, 2 * len(t)):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        n = upto(middle)
        if n <= places[0]:
            low, below = middle, n
        elif n > places[1]:
            high, above = middle, n
        else:  # the two middle slopes lie on both sides
            break
    i, j = _turned_pairs(v - low * t, v - high * t)
    i, j = np.where(t[i] < t[j], i, j), np.where(t[i] < t[j], j, i)
    slopes = np.sort(((v[j] - v[i]) / (t[j] - t[i])).astype(np.float64))
    return float((slopes[places[0] - below] + slopes[places[1] - below]) / 2), pairs


def by_key(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, fit) -> DataFrame:
    """``fit`` (a function of one key's columns as arrays, in order, that gives a tuple) for each key.

    Rows are dealt by key and sorted; a task holds the named columns of one key, as numbers, and nothing else.
    schema: the keys (long), then what comes out.
    """
    names = [part.split(" ")[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    types = [kinds[part.split(" ")[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, found = None, [], []

        def close() -> None:
            found.append((*held, *fit(*[x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*parts, strict=True)])))

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*found, strict=True), types, strict=True)], names)
            found.clear()
            return batch

        for batch in batches:
            own = np.stack([batch.column(k).to_numpy() for k in keys], 1)
            values = [batch.column(c).to_numpy() for c in columns]
            bounds = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *bounds], [*bounds, len(own)], strict=True):
                if b > a:
                    key = tuple(own[a].tolist())
                    if held is not None and key != held:
                        close()
                        parts = []
                    held = key
                    parts.append([v[a:b] for v in values])
            # a key may go on in the next batch, whose memory isn't this one's
            if len(own):
                parts[-1] = [v.copy() for v in parts[-1]]
            if found:
                yield out()
        if held is not None:
            close()
            yield out()

    return rows.select(*dict.fromkeys([*keys, *order, *columns])).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def quadratic_fit(points: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Least-squares parabola by normal equations about the mean time: c0, c1, c2, rms and bic."""
    centre = points.groupBy(*keys).agg(F.avg(time).alias("reference"), F.count("*").alias("n"))
    p = points.join(centre, keys).withColumn("_t", F.col(time) - F.col("reference"))
    t, v = F.col("_t"), F.col(value)
    sums = p.groupBy(*keys, "reference", "n").agg(*[F.sum(F.pow(t, F.lit(float(k)))).alias(f"s{k}") for k in range(2, 5)], F.sum(v).alias("y0"), F.sum(t * v).alias("y1"), F.sum(t * t * v).alias("y2"), F.sum(v * v).alias("yy"))
    n, s2, s3, s4, y0, y1, y2 = (F.col(c) for c in ("n", "s2", "s3", "s4", "y0", "y1", "y2"))
    det = n * (s2 * s4 - s3 * s3) - s2 * s2 * s2
    c2 = (n * (s2 * y2 - s3 * y1) - s2 * s2 * y0) / det
    sums = sums.where((F.col("n") > 3) & (F.abs(det) > 1e-9)).withColumn("c2", c2)
    sums = sums.withColumn("c1", (y1 - F.col("c2") * s3) / s2).withColumn("c0", (y0 - F.col("c2") * s2) / n)
    left = F.greatest(F.col("yy") - F.col("c0") * y0 - F.col("c1") * y1 - F.col("c2") * y2, F.lit(0.0))
    rms = F.sqrt(left / n)
    return sums.select(*keys, "n", "reference", "c0", "c1", "c2", rms.alias("rms"), (n * F.log(F.greatest(rms * rms, F.lit(1e-12))) + 3 * F.log(n)).alias("bic"))


def huber_line(t: np.ndarray, v: np.ndarray, k: float = 1.345, floor: float = 100.0, rounds: int = 32) -> tuple[float, float, float]:
    """Slope, intercept and scale of a line by iterated weights, about the mean time."""
    t = t - t.mean()
    w = np.ones(len(t))
    slope = intercept = scale = 0.0
    for _ in range(rounds):
        m = (w * t).sum() / w.sum()
        spread = (w * (t - m) ** 2).sum()
        new = (w * (t - m) * v).sum() / spread if spread > 0 else 0.0
        start = (w * v).sum() / w.sum() - new * m
        r = v - start - new * t
        scale = max(floor, 1.4826 * float(np.median(np.abs(r - np.median(r)))))
        w = np.minimum(1.0, k * scale / np.maximum(np.abs(r), 1e-12))
        if abs(new - slope) < 1e-9 and abs(start - intercept) < 1e-6:
            break
        slope, intercept = new, start
    return float(new), float(start), scale


def ransac_line(t: np.ndarray, v: np.ndarray, gate: float, steepest: float) -> tuple[int, float, float]:
    """Of all lines through two points no steeper than allowed the one with most points within the gate; first in order on ties."""
    best = (0, 0.0, 0.0)
    for i in range(len(t)):
        dt = t[i + 1 :] - t[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            slopes = np.where(dt > 0, (v[i + 1 :] - v[i]) / dt, np.inf)
        for slope in slopes[np.abs(slopes) <= steepest]:
            hits = int((np.abs(v - v[i] - slope * (t - t[i])) <= gate).sum())
            if hits > best[0]:
                best = (hits, float(slope), float(v[i] - slope * t[i]))
    return best


def _draws(ident: np.ndarray, u: np.ndarray, reach: int, draws: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i and j, and a hash of both ids, of each point (in order of u, an integer time) and the later ones within reach that the hash draws."""
    found = []
    for i, j in grouped.later(u, reach):
        h = grouped.hashed(ident[i], ident[j])
        own = np.lexsort((ident[j], h, i))
        own = own[np.arange(len(own)) - np.searchsorted(i[own], i[own], "left") < draws]
        found.append((i[own], j[own], h[own]))
    return tuple(np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in range(3))


def _consensus(ident: np.ndarray, u: np.ndarray, t: np.ndarray, v: np.ndarray, reach: int, draws: int, lifts: int, period: float, gate: float, steepest: float, step: float, support: int) -> tuple[np.ndarray, float, float, float] | None:
    """The points of one key's best line, its slope, intercept and rms."""
    wrapped = lambda x: grouped.wrapped(x, period)
    buckets = int(period // gate)
    bucket = lambda x: np.floor(grouped.pmod(x, period) * buckets / period).astype(np.int64)
    i, j, h = _draws(ident, u, reach, draws)
    lift = np.tile(np.arange(-lifts, lifts + 1), len(i))
    i, j, h = (np.repeat(x, 2 * lifts + 1) for x in (i, j, h))
    slope = (v[j] + lift * period - v[i]) / (t[j] - t[i])
    flat = np.abs(slope) <= steepest
    i, j, h, lift, slope = i[flat], j[flat], h[flat], lift[flat], slope[flat]
    if not len(i):
        return None
    used, s = np.unique(grouped.half_up(slope / step), return_inverse=True)
    votes = np.zeros(len(used) * buckets, np.int64)
    for start in range(0, len(t), 4096):
        b = bucket(v[None, start : start + 4096] - (used * step)[:, None] * t[None, start : start + 4096])
        votes += np.bincount((np.arange(len(used))[:, None] * buckets + b).ravel(), minlength=len(votes))
    own = bucket(v[i] - used[s] * step * t[i])
    score = sum(votes[s * buckets + (own + d) % buckets] for d in (-1, 0, 1))
    k = np.lexsort((lift, ident[j], ident[i], h, -score))[0]
    line = v[i[k]] - slope[k] * t[i[k]] + slope[k] * t
    off = wrapped(v - line)
    near = np.abs(off) <= gate
    fit = grouped.line(t[near], (line + off)[near]) if near.any() else None
    if fit is None:
        return None
    off = wrapped(v - fit[1] - fit[0] * t)
    held = np.abs(off) <= gate
    if held.sum() < support:
        return None
    return held, *fit, float(np.sqrt((off[held] ** 2).mean()))


def consensus_lines(points: DataFrame, keys: list[str], reach: int, draws: int, lifts: int, period: float, gate: float, steepest: float, step: float, support: int, tracks: int) -> DataFrame:
    """Up to so many lines of each key by random consensus, best first: keys, track, id, slope, intercept (at time 0) and rms, a row for each point of a line.

    points: keys, id, u (integer time), t (the same as a double) and v, known modulo the period.  Hypotheses are lines through a point and partners that a hash of
    their ids draws, each partner lifted by up to ``lifts`` periods, no steeper than allowed.  A hypothesis' consensus is what lies in its bucket of intercepts and those
    beside it (buckets as wide as the gate), at its slope to the next ``step``: points are counted once for each slope that hypotheses use, not for each hypothesis.  The
    one with the most (ties: the smallest hash, then ids and lift) is held against the points themselves: those within the gate are lifted to it, fitted by least
    squares, and those within the gate of the fit are the line's.  Lines with the support stay, their points go, and the rest is searched again.  Nothing
    depends on how rows are dealt.  Points travel once, to where their key is; hypotheses and votes, which are many more, stay there.
    """

    def fit(ident, u, t, v):
        left, found = np.arange(len(ident)), []
        for track in range(1, tracks + 1):
            best = _consensus(ident[left], u[left], t[left], v[left], reach, draws, lifts, period, gate, steepest, step, support)
            if best is None:
                break
            held, *numbers = best
            own = ident[left[held]]
            found.append((np.full(len(own), track), own, *[np.full(len(own), x) for x in numbers]))
            left = left[~held]
        return [np.concatenate([f[n] for f in found]) for n in range(5)] if found else [np.zeros(0)] * 5

    columns = ["id", "u", "t", "v"]
    whole = points.select(*keys, *columns).dropna()
    schema = ", ".join([*[f"{k} long" for k in keys], "track int, id long, slope double, intercept double, rms double"])
    return grouped.by_keys(whole, keys, ["u", "id"], columns, schema, grouped.each_key(fit, keys, columns, [np.int32, np.int64, float, float, float]))


def best_chain(t: np.ndarray, v: np.ndarray, reach: float, gate: float, point: float, gap: float, change: float) -> tuple[int, float]:
    """Track before detect: the chain of points with the least cost, each point earning ``point``, time and change of value costing."""
    cost, length = np.full(len(t), -point), np.ones(len(t), int)
    for j in range(len(t)):
        i = np.flatnonzero((t[:j] < t[j]) & (t[j] - t[:j] <= reach) & (np.abs(v[j] - v[:j]) <= gate))
        if len(i):
            step = cost[i] + gap * (t[j] - t[i]) + change * np.abs(v[j] - v[i]) - point
            k = int(step.argmin())
            if step[k] < cost[j]:
                cost[j], length[j] = step[k], length[i[k]] + 1
    j = int(np.lexsort((-length, cost))[0])
    return int(length[j]), float(cost[j])


def path_cover(n: int, edges: list[tuple[int, int, float]], ends: float) -> tuple[float, list[int]]:
    """Least-cost cover of ordered nodes by paths: each node has at most one successor and predecessor, a path costs ``ends`` and
    each edge its cost.  Successive shortest augmentations over the bipartite graph; edges are worth taking below ``ends``."""
    follow, before = [-1] * n, [-1] * n
    price = {(u, v): c for u, v, c in edges if c < ends}
    out: list[list[int]] = [[] for _ in range(n)]
    for u, v in sorted(price):
        out[u].append(v)
    total = ends * n
    while True:
        dist, back = [0.0 if follow[u] < 0 else float("inf") for u in range(n)], [-1] * n
        reach = [float("inf")] * n
        changed = True
        while changed:
            changed = False
            for u in range(n):
                if dist[u] == float("inf"):
                    continue
                for v in out[u]:
                    if follow[u] != v and dist[u] + price[u, v] < reach[v] - 1e-12:
                        reach[v], back[v], changed = dist[u] + price[u, v], u, True
                        w = before[v]
                        if w >= 0 and reach[v] - price[w, v] < dist[w] - 1e-12:
                            dist[w] = reach[v] - price[w, v]
        free = [(reach[v], v) for v in range(n) if before[v] < 0 and reach[v] < ends - 1e-12]
        if not free:
            return total, follow
        gain, v = min(free)
        total += gain - ends
        while v >= 0:
            u = back[v]
            free_next, follow[u], before[v] = follow[u], v, u
            v = free_next


def kalman(t: np.ndarray, z: np.ndarray, q: float, r: float, gate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Constant-velocity filter with irregular steps: level, rate and whether a measurement was taken."""
    out, taken = np.zeros((len(t), 2)), np.zeros(len(t), bool)
    state = kalman_start(z[0], r) if len(z) else ()
    for i in range(len(t)):
        state, taken[i] = kalman_step(state, float(t[i] - t[i - 1]) if i else 0.0, float(z[i]), q, r, gate)
        out[i] = state[:2]
    return out[:, 0], out[:, 1], taken


def by_group(points: DataFrame, keys: list[str], schema: str, fit, batch: str | None = None) -> DataFrame:
    """``fit`` (a function of one key's rows as a pandas frame that gives the columns after the keys) for each key.

    batch: an expression of the last key; keys that share it go to a task together, which saves a call for each small group.
    """
    whole = keys[:-1] if batch else keys

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, rows in frame.groupby(keys[-1], sort=True) if batch else [(None, frame)]:
            out = pd.DataFrame(fit(rows))
            for k in reversed(keys):
                out.insert(0, k, rows[k].iloc[0])
            found.append(out)
        return pd.concat(found)

    return points.groupBy(*whole, *([F.expr(batch)] if batch else [])).applyInPandas(run, schema)


def potentials(edges: DataFrame) -> DataFrame:
    """Components of a graph with integer differences on its edges (a, b, delta: b = a + delta): node, root, potential, contradictory.

    The least root spreads over edges with the difference to it, a round a hop, halving chains by taking over what the
    root so far knows; a component with an edge whose ends disagree is contradictory.  Rounds are kept in the checkpoint folder.
    """
    both = kept(edges.select("a", "b", "delta").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("delta")).alias("delta"))))
    state = kept(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("potential")))
    while True:
        told = both.join(state.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "root", (F.col("potential") + F.col("delta")).alias("potential"))
        hop = state.select("node", F.col("root").alias("via"), F.col("potential").alias("near")).join(state.select(F.col("node").alias("via"), "root", F.col("potential").alias("far")), "via").select("node", "root", (F.col("near") + F.col("far")).alias("potential"))
        new = kept(state.union(told).union(hop).groupBy("node").agg(F.min(F.struct("root", "potential")).alias("x")).select("node", "x.*"))
        if new.join(state.withColumnRenamed("root", "old"), "node").where("root <> old").isEmpty():
            break
        state = new
    ends = both.join(state.select(F.col("node").alias("a"), "root", F.col("potential").alias("pa")), "a").join(state.select(F.col("node").alias("b"), F.col("potential").alias("pb")), "b")
    wrong = ends.groupBy("root").agg(F.bool_or(F.col("pb") != F.col("pa") + F.col("delta")).alias("contradictory"))
    return state.join(wrong, "root").select("node", "root", "potential", "contradictory")


def forest(n: int, links, at_once: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Root (the least node) and potential of nodes 0 to n - 1, and for each contradictory component an edge (a, b, delta: b = a + delta) that contradicts these.

    ``links`` is a function of two arrays of nodes that gives two matrices: whether they are linked, and by what the second's potential exceeds the first's.  Who has been
    reached isn't looked for again, and a component that contradicts itself isn't looked through: so links are computed between few, where most nodes are in a few
    such components, and between all of a component where it agrees.
    """
    root, potential, edges = np.full(n, -1), np.zeros(n, np.int64), []
    free = np.arange(n)
    while len(free):
        start, free = free[0], free[1:]
        root[start], reached, done = start, np.array([start]), 0
        while done < len(reached) and len(free):
            now = reached[done : done + max(1, at_once // len(free))]
            done += len(now)
            linked, delta = links(now, free)
            found = np.flatnonzero(linked.any(axis=0))
            by = linked[:, found].argmax(axis=0)
            new = free[found]
            root[new], potential[new] = start, potential[now[by]] + delta[by, found]
            reached, free = np.concatenate([reached, new]), np.delete(free, found)
        step = max(1, at_once // len(reached))
        for k in range(0, len(reached) if len(reached) > 1 else 0, step):
            now = reached[k : k + step]
            linked, delta = links(now, reached)
            i, j = np.nonzero(linked & (potential[reached] - potential[now][:, None] != delta))
            if len(i):
                edges.append((now[i[0]], reached[j[0]], delta[i[0], j[0]]))
                break
    return root, potential, tuple(np.array([e[k] for e in edges], np.int64) for k in range(3))


def spanning(one: np.ndarray, other: np.ndarray, linked: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, delta: b = a + delta) of a spanning forest of the graph that joins one[i] and other[j] where linked, and an edge that its component's forest
    contradicts, if there is one.  With any other edges this has the components, differences and contradictions of the whole graph.

    Nodes may be on both sides; delta is other's potential less one's.
    """
    nodes, place = np.unique(np.concatenate([one, other]), return_inverse=True)
    met, rise = np.zeros((len(nodes), len(nodes)), bool), np.zeros((len(nodes), len(nodes)), np.int64)
    at = np.ix_(place[: len(one)], place[len(one) :])
    met[at], rise[at] = linked, delta
    both, turned = met | met.T, np.where(met, rise, -rise.T)
    root, potential, (a, b, d) = forest(len(nodes), lambda i, j: (both[np.ix_(i, j)], turned[np.ix_(i, j)]))
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return np.concatenate([nodes[root[own]], nodes[a]]), np.concatenate([nodes[own], nodes[b]]), np.concatenate([potential[own], d])
