"""Array kernels over sampled series as relational arithmetic: correlation, control margins, differential and grid scores,
spectra, de-rotation and peak interpolation.  A complex number is a pair of columns; rotation is exp(-2 pi i f t)."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def templates(rows: DataFrame, group: str, n: str, i: str, q: str) -> DataFrame:
    """The mean vector of each group as sums (ti, tq): a template's scale cancels in normalised scores."""
    return rows.groupBy(F.col(group).alias("template"), F.col(n)).agg(F.sum(i).alias("ti"), F.sum(q).alias("tq"))


def rolled(template: DataFrame, n: str, shift: int, length: int) -> DataFrame:
    """The control: each template's symbols moved by shift places around."""
    return template.withColumn(n, F.pmod(F.col(n) + shift, F.lit(length)).cast("int"))


def correlation(rows: DataFrame, template: DataFrame, keys: list[str], n: str, i: str, q: str) -> DataFrame:
    """Normalised score |sum conj(t) x| / sqrt(sum |t|^2 sum |x|^2) of each key against each template; 0 without energy."""
    # templates are a row for each of their symbols; the planner sends them to all tasks if it finds them small enough
    joined = rows.join(template, n)
    x, y, a, b = (F.col(c).cast("double") for c in (i, q, "ti", "tq"))
    sums = joined.groupBy(*keys, "template").agg(F.sum(a * x + b * y).alias("re"), F.sum(a * y - b * x).alias("im"), F.sum(a * a + b * b).alias("et"), F.sum(x * x + y * y).alias("ex"))
    energy = F.col("et") * F.col("ex")
    return sums.select(*keys, "template", F.when(energy > 0, F.sqrt((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / energy)).otherwise(0.0).alias("score"))


def total(values: Column, kind: str = "double") -> Column:
    """The sum of an array of this type, in order."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def energy(i: Column, q: Column) -> Column:
    """i^2 + q^2 of arrays of whole numbers, sample by sample."""
    return F.zip_with(i, q, lambda x, y: x * x + y * y)


def differential(vectors: DataFrame, keys: list[str], i: str, q: str) -> DataFrame:
    """Lag-one products of vectors (i and q as arrays): score |sum c[k] conj(c[k-1])| / sum |c[k]||c[k-1]| and frequency in cycles a step."""
    one, two = F.transform(F.arrays_zip(i, q), lambda s: F.struct(s[i].cast("double").alias("x"), s[q].cast("double").alias("y"))), F.size(i)
    rows = vectors.where(two > 1).withColumn("_s", one)
    later, before = F.slice("_s", F.lit(2), F.size("_s") - 1), F.slice("_s", F.lit(1), F.size("_s") - 1)
    step = lambda f: total(F.zip_with(later, before, f))
    sums = rows.select(
        *keys,
        step(lambda c, b: c["x"] * b["x"] + c["y"] * b["y"]).alias("re"),
        step(lambda c, b: c["y"] * b["x"] - c["x"] * b["y"]).alias("im"),
        step(lambda c, b: F.sqrt((c["x"] * c["x"] + c["y"] * c["y"]) * (b["x"] * b["x"] + b["y"] * b["y"]))).alias("ceiling"),
    )
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return sums.select(*keys, F.when(F.col("ceiling") > 0, size / F.col("ceiling")).otherwise(0.0).alias("score"), (F.atan2("im", "re") / (2 * 3.141592653589793)).alias("frequency"))


def rotated_sums(rows: DataFrame, keys: list[str], n: str, i: str, q: str, bins: int, period: int) -> DataFrame:
    """The transform of each key at ``bins`` frequencies f / period: (bin, re, im).  Cosines and sines of the grid's steps are a table
    of ``period`` rows, so a sample costs a lookup for each bin."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    angle = F.expr(f"-2 * pi() * pmod(bin * {n}, {period}) / {period}")
    x, y = F.col(i).cast("double"), F.col(q).cast("double")
    turned = rows.withColumn("bin", grid).withColumns({"_c": F.cos(angle), "_s": F.sin(angle)})
    return turned.groupBy(*keys, "bin").agg(F.sum(x * F.col("_c") - y * F.col("_s")).alias("re"), F.sum(x * F.col("_s") + y * F.col("_c")).alias("im"))


def peak_offset(left: Column, middle: Column, right: Column) -> Column:
    """Place of a parabola's top through three equidistant values, within half a step; 0 for a flat one."""
    bend = left - 2 * middle + right
    return F.when(bend == 0, 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (left - right) / bend)))


def dechirp(rows: DataFrame, n: str, i: str, q: str, linear: float, quadratic: float) -> DataFrame:
    """rows with (di, dq): each sample turned back by the phase linear n + quadratic n^2 in cycles."""
    angle = F.expr(f"-2 * pi() * ({linear}D * {n} + {quadratic}D * {n} * {n})")
    x, y = F.col(i).cast("double"), F.col(q).cast("double")
    return rows.withColumns({"_c": F.cos(angle), "_s": F.sin(angle)}).withColumns({"di": x * F.col("_c") - y * F.col("_s"), "dq": x * F.col("_s") + y * F.col("_c")}).drop("_c", "_s")


def _kept(place: list[int], rank: list[tuple[int, int]], distance: int) -> list[int]:
    """Indices of what greedy suppression keeps: by rank, each unless a kept one lies within the distance."""
    held: list[int] = []
    out = []
    for i in sorted(range(len(place)), key=rank.__getitem__):
        k = bisect.bisect_left(held, place[i])
        if (k == 0 or place[i] - held[k - 1] >= distance) and (k == len(held) or held[k] - place[i] >= distance):
            held.insert(k, place[i])
            out.append(i)
    return sorted(out)


def _decided(place: list[int], rank: list[tuple[int, int]], distance: int) -> int:
    """How many of the first peaks (by place) nothing that comes later can change: those up to a distance beyond the last one that is the first of
    all around it, and all around it has been seen.  That one stays, and no two peaks on its two sides are near each other."""
    first: deque[int] = deque()  # places whose ranks rise: the best of the window so far is its first
    ahead, best = 0, -1
    for i in range(len(place)):
        while ahead < len(place) and place[ahead] - place[i] < distance:
            while first and rank[first[-1]] > rank[ahead]:
                first.pop()
            first.append(ahead)
            ahead += 1
        while place[i] - place[first[0]] >= distance:
            first.popleft()
        if first[0] == i and ahead < len(place):
            best = ahead
    return max(best, 0)


def suppress(peaks: DataFrame, keys: list[str], place: str, score: str, ident: str, distance: int, at_once: int = 65_536) -> DataFrame:
    """Greedy suppression: peaks by (score, -id) descending, each kept unless a kept one lies within the distance.  source_count: the key's peaks.

    One pass over the peaks of a key in order of place.  A stretch is decided when a gap of the distance follows it, or, in a long one, up to
    the last peak that is the first of all around it; so a task holds the peaks since then, and a chain of any length takes no rounds.
    """
    peaks = peaks.select(*[F.col(k).cast("bigint").alias(k) for k in keys], *[F.col(c).cast("bigint").alias(c) for c in (place, score, ident)])
    counts = peaks.groupBy(*keys).agg(F.count("*").alias("source_count"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, limit = None, [], at_once

        def out(n: int) -> pa.RecordBatch:
            some = held[:n]
            del held[:n]
            kept = [some[i] for i in _kept([r[0] for r in some], [(-r[1], r[2]) for r in some], distance)]
            columns = [*[[k] * len(kept) for k in key], *[[r[c] for r in kept] for c in range(3)]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*keys, place, score, ident])

        for batch in batches:
            for own, row in zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), zip(*[batch.column(c).to_pylist() for c in (place, score, ident)], strict=True), strict=True):
                if own != key or (held and row[0] - held[-1][0] >= distance):
                    if held:
                        yield out(len(held))
                    key, limit = own, at_once
                elif len(held) >= limit:
                    if n := _decided([r[0] for r in held], [(-r[1], r[2]) for r in held], distance):
                        yield out(n)
                    limit = max(at_once, 2 * len(held))
                held.append(row)
        if held:
            yield out(len(held))

    schema = ", ".join(f"{c} long" for c in (*keys, place, score, ident))
    kept = peaks.repartition(*keys).sortWithinPartitions(*keys, place, ident).mapInArrow(run, schema)
    return kept.join(counts, keys).select(*keys, "source_count", place, score, ident)
