"""Acquisition of a known pattern in sample vectors: timing and frequency maps, peaks, suppression, fine and conditioned stages, ranking.

A vector is one row with its samples and its pattern as arrays, so nothing is shuffled: everything about a vector is numpy on
slices of an Arrow batch.  A vector holds frames of the pattern's length, one after another from an unknown epoch on, turned
by an unknown frequency.  Frames go by their number modulo three: acquire, verify and held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 512
#: Coarse bins of frequency on both sides of zero, in cycles a sample, and the fine steps between them.
BINS, WIDTH = 4, 1 / 64
FINE, FINE_STEP = 4, 1 / 256
BASINS, EPOCH_APART, BINS_APART = 3, 2, 1
ROLL = 3
METHODS = ("anchor", "differential", "glrt", "symbolwise", "tracker")


def folded(vectors: DataFrame, period: int) -> DataFrame:
    """vectors (id, label, i and q as arrays of whole numbers) with ti and tq: the sums of their label's samples, folded to one period."""
    folds = F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda m: F.struct(*[F.aggregate(F.filter(F.col(c), lambda _, n: n % period == m), F.lit(0).cast("long"), lambda s, x: s + x).alias(c) for c in ("i", "q")]))
    own = vectors.select("label", F.posexplode(folds).alias("m", "x")).groupBy("label", "m").agg(F.sum("x.i").alias("i"), F.sum("x.q").alias("q"))
    shape = own.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("m", "i", "q"))).alias("x")).select("label", F.col("x.i").alias("ti"), F.col("x.q").alias("tq"))
    return vectors.join(shape, "label")


class Frames:
    """The frames of vectors of ``n`` samples for each epoch."""

    def __init__(self, n: int, period: int) -> None:
        self.n, self.period = n, period
        pairs = [(e, k) for e in range(period) for k in range((n - e) // period)]
        self.epoch, self.number = np.array(pairs, np.int64).reshape(-1, 2).T
        self.at = (self.epoch + self.number * period)[:, None] + np.arange(period)

    def of(self, epoch: int, part: int | None = None) -> np.ndarray:
        return np.flatnonzero((self.epoch == epoch) & ((self.number % 3 == part) if part is not None else True))

    def scores(self, x: np.ndarray, t: np.ndarray, frequencies: np.ndarray, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """(vectors, frames, frequencies): |sum conj(t) x turned back| over the root of both energies; 0 without energy."""
        at = self.at[which]
        turn = np.exp(-2j * np.pi * frequencies[:, None, None] * at)
        own = x[:, at]
        both = np.einsum("vfm,bfm->vfb", own * np.conj(t)[:, None, :], turn)
        energy = (np.abs(t) ** 2).sum(axis=1)[:, None] * (np.abs(own) ** 2).sum(axis=2)
        return np.divide(np.abs(both), np.sqrt(energy)[:, :, None], out=np.zeros(both.shape), where=energy[:, :, None] > 0)

    def map(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """(vectors, epochs, coarse bins): mean score of the frames to acquire from."""
        s = self.scores(x, t, coarse())
        out = np.zeros((len(x), self.period, s.shape[2]))
        for e in range(self.period):
            own = self.of(e, 0)
            if len(own):
                out[:, e] = s[:, own].mean(axis=1)
        return out


def coarse() -> np.ndarray:
    return np.arange(-BINS, BINS + 1) * WIDTH


def best_cell(scores: np.ndarray) -> tuple[int, int]:
    """Epoch and bin of the greatest score; ties to the smaller epoch, then bin."""
    return divmod(int(np.round(scores, 9).argmax()), scores.shape[1])


def peaks(scores: np.ndarray) -> list[tuple[int, int]]:
    """Positive cells at least as great as their neighbours (epochs are a circle) and greater than one, suppressed greedily."""
    scores = np.round(scores, 9)
    up = np.pad(scores, ((0, 0), (1, 1)), constant_values=-np.inf)
    around = np.stack([np.roll(scores, 1, 0), np.roll(scores, -1, 0), up[:, :-2], up[:, 2:]])
    top = (scores > 0) & (scores >= around.max(axis=0)) & (scores > around.min(axis=0))
    cells = sorted(((-scores[e, b], abs(b - BINS), e, b) for e, b in zip(*np.nonzero(top), strict=True)))
    kept: list[tuple[int, int]] = []
    for _, _, e, b in cells:
        circle = [min((e - f) % len(scores), (f - e) % len(scores)) for f, _ in kept]
        if not any(d < EPOCH_APART and abs(b - c) <= BINS_APART for d, (_, c) in zip(circle, kept, strict=True)):
            kept.append((int(e), int(b)))
    return kept[:BASINS]


def top_offset(s: np.ndarray, k: int) -> float:
    """Place of the parabola's top through k and its neighbours, within half a step; 0 at the ends."""
    if not 0 < k < len(s) - 1:
        return 0.0
    bend = s[k - 1] - 2 * s[k] + s[k + 1]
    return float(np.clip(0.5 * (s[k - 1] - s[k + 1]) / bend, -0.5, 0.5)) if bend else 0.0


def basin(frames: Frames, x: np.ndarray, t: np.ndarray, epoch: int, b: int, acquired: float) -> dict | None:
    """A peak's fine stage: frequency between bins by the score of whole frames, and scores of the three kinds of frames; None below two frames."""
    own = frames.of(epoch)
    if len(own) < 2:
        return None
    fine = (b - BINS) * WIDTH + np.arange(-FINE, FINE + 1) * FINE_STEP
    s = frames.scores(x[None], t[None], fine, own)[0].mean(axis=0)
    k = int(np.round(s, 9).argmax())
    f = np.array([fine[k] + top_offset(s, k) * FINE_STEP])
    control = np.roll(t, ROLL)

    def mean(pattern: np.ndarray, part: int) -> float:
        which = frames.of(epoch, part)
        return float(frames.scores(x[None], pattern[None], f, which)[0].mean()) if len(which) else 0.0

    return {"epoch": epoch, "frequency": float(f[0]), "acquire": acquired, "conditioned": float(s[k]), "verify": mean(t, 1), "held": mean(t, 2), "margin": mean(t, 2) - mean(control, 2)}


def ranked(found: list[dict]) -> list[dict]:
    """Basins by held-out margin, verify, conditioned, acquire, then the smaller frequency and epoch."""
    key = lambda d: (-round(d["margin"], 9), -round(d["verify"], 9), -round(d["conditioned"], 9), -round(d["acquire"], 9), abs(round(d["frequency"], 9)), d["epoch"])
    return sorted(found, key=key)


def symbols(x: np.ndarray, t: np.ndarray, frames: Frames, epoch: int, frequency: float, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, symbols): correlation of each symbol of ``length`` samples with the pattern's, and the root of both energies."""
    at = frames.at[frames.of(epoch)]
    own = x[at] * np.exp(-2j * np.pi * frequency * at)
    cut = lambda z: z.reshape(len(at), -1, length)
    energy = (np.abs(t) ** 2).reshape(-1, length).sum(axis=1)[None] * (np.abs(cut(own)) ** 2).sum(axis=2)
    return cut(own * np.conj(t)).sum(axis=2), np.sqrt(energy)


def methods(c: np.ndarray, energy: np.ndarray) -> dict[str, float]:
    """Scores of one candidate from its symbols' correlations, each between 0 and 1; 0 without a ceiling."""
    ceiling = (np.abs(c).sum(axis=1) ** 2).sum()
    steps = (np.abs(c[:, 1:]) * np.abs(c[:, :-1])).sum()
    share = lambda a, b: float(a / b) if b > 0 else 0.0
    return {
        "anchor": share((np.abs(c.sum(axis=1)) ** 2).sum(), ceiling),
        "differential": share(np.abs((c[:, 1:] * np.conj(c[:, :-1])).sum()), steps),
        "glrt": share((np.abs(np.fft.fft(c, 4 * c.shape[1], axis=1)) ** 2).sum(axis=0).max(), ceiling),
        "symbolwise": share(np.abs(c).sum(), energy.sum()),
        "tracker": float(np.divide(np.abs(c) ** 2, energy**2, out=np.zeros(c.shape), where=energy > 0).mean()) if c.size else 0.0,
    }


def acquired(frames: Frames, x: np.ndarray, t: np.ndarray, scores: np.ndarray) -> tuple[str, list[dict]]:
    """Outcome and ranked basins of one vector, from its coarse map."""
    cells = peaks(scores)
    if not cells:
        return "no_result", []
    found = [d for d in (basin(frames, x, t, e, b, float(scores[e, b])) for e, b in cells) if d]
    return ("complete", ranked(found)) if found else ("insufficient_data", [])


def each(vectors: DataFrame, schema: str, work, period: int = 8) -> DataFrame:
    """Rows (tuples after the vector's id) that ``work(frames, x, t, maps)`` gives for a vector, for all vectors (id, i, q, ti, tq); a vector of
    fewer samples than a period gives none."""
    fields = [tuple(part.split(" ")) for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                i, q, ti, tq = ([np.array(v, float) for v in batch.column(c).to_pylist()] for c in ("i", "q", "ti", "tq"))
                ids, rows = batch.column("id").to_pylist(), []
                sizes = np.array([len(v) for v in i])
                for n in np.unique(sizes):
                    own = np.flatnonzero(sizes == n)
                    frames = Frames(int(n), period)
                    if len(frames.at):
                        x = np.array([i[r] + 1j * q[r] for r in own])
                        t = np.array([ti[r] + 1j * tq[r] for r in own])
                        for r, v, pattern, scores in zip(own, x, t, frames.map(x, t), strict=True):
                            rows += [(ids[r], *row) for row in work(frames, v, pattern, scores)]
                yield pa.RecordBatch.from_arrays([pa.array([row[c] for row in rows], kinds[kind]) for c, (_, kind) in enumerate(fields)], [name for name, _ in fields])

    return vectors.select("id", "i", "q", "ti", "tq").mapInArrow(run, schema)
