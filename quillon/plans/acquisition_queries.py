"""Acquisition on sample vectors: each label's vectors, folded to eight samples, are the pattern that its vectors are searched for."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import acquisition, intervals
from quillon.plans.registry import query
from quillon.session import ship
from quillon.sources.shared import kept
from quillon.sources.tables import SAMPLES_SQL, table

PERIOD = 8
#: The least margin of a hit, and how far apart two hits that confirm each other begin and may lie.
GATE, APART, REACH = 0.025, 2, 40


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.expr(f"transform(sequence(0, size(embedding) div 2 - 1), n -> cast(bround(cast(embedding[2 * n + {k}] as double) * 32767, 0) as bigint))")
    return table(ship(spark), sf_dir, "embeddings").where("size(embedding) >= 2").select(F.col("vec_id").alias("id"), "label", part(0).alias("i"), part(1).alias("q"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisition.folded(_plain(spark, sf_dir), PERIOD)


# the coarse map in SQL: frames of every epoch at every bin, then the best cell of a vector
_MAP = f"""{SAMPLES_SQL}, tpl AS (SELECT label, n % 8 AS m, sum(i)::DOUBLE AS ti, sum(q)::DOUBLE AS tq FROM smp GROUP BY 1, 2), prd AS (SELECT s.vec_id, s.n, t.m, (s.n - t.m + 8) % 8 AS e, t.ti * s.i + t.tq * s.q AS x, t.ti * s.q - t.tq * s.i AS y, t.ti * t.ti + t.tq * t.tq AS et, (s.i * s.i + s.q * s.q)::DOUBLE AS ex, t.ti, t.tq, s.i, s.q FROM smp s JOIN tpl t USING (label) WHERE s.n >= (s.n - t.m + 8) % 8 + t.m),
whl AS (SELECT *, (n - e) // 8 AS k FROM prd WHERE (n - e) % 8 = m AND n - m + 8 <= 32),
frm AS (SELECT vec_id, e, k, b, sum(x * cos(a) - y * sin(a)) AS re, sum(x * sin(a) + y * cos(a)) AS im, sum(et) AS et, sum(ex) AS ex FROM (SELECT *, -2 * pi() * b * n / 64 AS a FROM whl, range(-4, 5) AS r(b)) GROUP BY 1, 2, 3, 4),
map AS (SELECT vec_id, e, b, avg(sqrt((re * re + im * im) / (et * ex))) AS s FROM frm WHERE k % 3 = 0 GROUP BY 1, 2, 3), cel AS (SELECT vec_id, e, b, s, m FROM (SELECT *, avg(s) OVER (PARTITION BY vec_id) AS m, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, e, b) AS r FROM map) WHERE r = 1)"""


@query("d07_folded_map", f"WITH {_MAP} SELECT vec_id, e::INT AS epoch, b::INT AS bin, round(s, 6) AS score, round(m, 6) AS mean FROM cel")
def folded_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cell of each vector's timing and frequency map, and the map's mean."""

    def work(frames, x, t, scores):
        e, b = acquisition.best_cell(scores)
        return [(e, b - acquisition.BINS, float(scores[e, b]), float(scores.mean()))]

    found = acquisition.each(_vectors(spark, sf_dir), "vec_id long, epoch int, bin int, score double, mean double", work, PERIOD)
    return found.select("vec_id", "epoch", "bin", F.round("score", 6).alias("score"), F.round("mean", 6).alias("mean"))


_FINE = f"""{_MAP}, fin AS (SELECT vec_id, j, k, sum(x * cos(a) - y * sin(a)) AS re, sum(x * sin(a) + y * cos(a)) AS im, sum(et) AS et, sum(ex) AS ex FROM (SELECT w.*, j, -2 * pi() * (c.b / 64.0::DOUBLE + j / 256.0::DOUBLE) * n AS a FROM whl w JOIN cel c ON c.vec_id = w.vec_id AND c.e = w.e, range(-4, 5) AS r(j)) GROUP BY 1, 2, 3),
con AS (SELECT vec_id, j, avg(sqrt((re * re + im * im) / (et * ex))) AS s FROM fin GROUP BY 1, 2)"""


@query("d06_conditioned_score", f"WITH {_FINE}, l AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, j) AS r, min(s) OVER (PARTITION BY vec_id) AS least FROM con) SELECT vec_id, j::INT AS step, round(s, 6) AS score, round(least, 6) AS least FROM l WHERE r = 1")
def conditioned_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole frames on a fine grid of frequency about the best cell: the best step, its score and the grid's least."""

    def work(frames, x, t, scores):
        e, b = acquisition.best_cell(scores)
        fine = (b - acquisition.BINS) * acquisition.WIDTH + np.arange(-acquisition.FINE, acquisition.FINE + 1) * acquisition.FINE_STEP
        s = frames.scores(x[None], t[None], fine, frames.of(e))[0].mean(axis=0)
        k = int(np.round(s, 9).argmax())
        return [(k - acquisition.FINE, float(s[k]), float(s.min()))]

    found = acquisition.each(_vectors(spark, sf_dir), "vec_id long, step int, score double, least double", work, PERIOD)
    return found.select("vec_id", "step", F.round("score", 6).alias("score"), F.round("least", 6).alias("least"))


@query("d08_full_acquisition")
def full_acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome and ranked basins of each vector: map, peaks, suppression, fine and conditioned stages, verification and held-out margin."""

    def work(frames, x, t, scores):
        outcome, found = acquisition.acquired(frames, x, t, scores)
        return [(outcome, r, d["epoch"], d["frequency"], d["margin"], d["verify"], d["conditioned"], d["acquire"]) for r, d in enumerate(found, 1)] or [(outcome, *[None] * 7)]

    schema = "vec_id long, outcome string, rank int, epoch int, frequency double, margin double, verify double, conditioned double, acquire double"
    found = acquisition.each(_vectors(spark, sf_dir), schema, work, PERIOD)
    return found.select("vec_id", "outcome", "rank", "epoch", *[F.round(c, 6).alias(c) for c in ("frequency", "margin", "verify", "conditioned", "acquire")])


def _basins(spark: SparkSession, sf_dir: str, most: int = acquisition.BASINS) -> DataFrame:
    """Every method's score, control and margin in the first ``most`` basins of a vector."""

    def work(frames, x, t, scores):
        rows = []
        for r, d in enumerate(acquisition.acquired(frames, x, t, scores)[1][:most], 1):
            exact, control = (acquisition.methods(*acquisition.symbols(x, p, frames, d["epoch"], d["frequency"], 2)) for p in (t, np.roll(t, acquisition.ROLL)))
            rows += [(r, d["frequency"], name, exact[name], control[name], exact[name] - control[name]) for name in acquisition.METHODS]
        return rows

    found = acquisition.each(_vectors(spark, sf_dir), "vec_id long, rank int, frequency double, method string, exact double, control double, margin double", work, PERIOD)
    return found.select("vec_id", "rank", "method", *[F.round(c, 6).alias(c) for c in ("frequency", "exact", "control", "margin")])


@query("d17_multi_basin")
def multi_basin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method's score, control and margin in each basin of a vector."""
    return _basins(spark, sf_dir)


def best_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best basins alone, searched once for all that is asked of them."""
    return kept(_basins(spark, sf_dir, 1))


@query("d27_dwell_confirmation")
def dwell_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the grid method in the best basin over the gate, confirmed by a later one of the same label near in frequency; the earlier is reported."""
    return confirmed(spark, sf_dir, best_basins(spark, sf_dir))


def confirmed(spark: SparkSession, sf_dir: str, basins: DataFrame) -> DataFrame:
    best = basins.where(f"method = 'glrt' and margin >= {GATE}")
    hits = best.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    side = lambda s: hits.select("label", *[F.col(c).alias(f"{s}_{c}") for c in ("vec_id", "frequency")])
    pairs = intervals.near_pairs(side("x"), side("y"), ["label"], "x_vec_id", "y_vec_id", REACH)
    pairs = pairs.where((F.col("y_vec_id") >= F.col("x_vec_id") + APART) & (F.abs(F.col("y_frequency") - F.col("x_frequency")) <= acquisition.WIDTH))
    return pairs.groupBy(F.col("x_vec_id").alias("vec_id")).agg(F.min("y_vec_id").alias("confirmed_by"), F.count("*").alias("confirmations"))


_CARRIER = f"""{_MAP}, car AS (SELECT w.vec_id, w.k, w.m, x * cos(a) - y * sin(a) AS re, x * sin(a) + y * cos(a) AS im, et, ex, i * cos(a) - q * sin(a) AS yi, i * sin(a) + q * cos(a) AS yq, ti, tq FROM (SELECT w.*, -2 * pi() * c.b * n / 64 AS a FROM whl w JOIN cel c ON c.vec_id = w.vec_id AND c.e = w.e) w)"""


def _at_best(frames, x: np.ndarray, scores: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The best cell's epoch, its frames' places and their samples turned back by the cell's frequency."""
    e, b = acquisition.best_cell(scores)
    at = frames.at[frames.of(e)]
    return e, at, x[at] * np.exp(-2j * np.pi * (b - acquisition.BINS) * acquisition.WIDTH * at)


@query("d23_frame_carrier", f"""WITH {_CARRIER}, f AS (SELECT vec_id, k, sum(re) AS re, sum(im) AS im, sum(re) FILTER (m < 4) AS r1, sum(im) FILTER (m < 4) AS i1, sum(re) FILTER (m >= 4) AS r2, sum(im) FILTER (m >= 4) AS i2 FROM car GROUP BY 1, 2)
SELECT vec_id, k::INT AS frame, round(atan2(im, re) / (2 * pi()), 6) AS prompt, round(atan2(i2 * r1 - r2 * i1, r2 * r1 + i2 * i1) / (8 * pi()), 6) AS discriminator FROM f""")
def frame_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt phase of each frame in cycles, and the discriminator between its halves in cycles a sample."""

    def work(frames, x, t, scores):
        _, _, y = _at_best(frames, x, scores)
        c = y * np.conj(t)
        half = c.reshape(len(c), 2, -1).sum(axis=2)
        step = half[:, 1] * np.conj(half[:, 0])
        return [(k, float(np.angle(c[k].sum()) / (2 * np.pi)), float(np.angle(step[k]) / (np.pi * PERIOD))) for k in range(len(c))]

    found = acquisition.each(_vectors(spark, sf_dir), "vec_id long, frame int, prompt double, discriminator double", work, PERIOD)
    return found.select("vec_id", "frame", F.round("prompt", 6).alias("prompt"), F.round("discriminator", 6).alias("discriminator"))


@query("d21_frame_slope", f"""WITH {_CARRIER}, g AS (SELECT vec_id, k, j, sum(re * cos(h) - im * sin(h)) AS re, sum(re * sin(h) + im * cos(h)) AS im, sum(et) AS et, sum(ex) AS ex FROM (SELECT *, -2 * pi() * j * m / 128 AS h FROM car, range(-8, 9) AS r(j)) GROUP BY 1, 2, 3), l AS (SELECT vec_id, k, j, (re * re + im * im) / (et * ex) AS s FROM g),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id, k ORDER BY round(s, 9) DESC, j) AS r, avg(s) OVER (PARTITION BY vec_id, k) AS mean FROM l) SELECT vec_id, k::INT AS frame, j::INT AS slope, round(s, 6) AS share, round(mean, 6) AS mean FROM b WHERE r = 1""")
def frame_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase slope of each frame by profile likelihood: gain and phase are free, so the share of the energy that a slope explains is its likelihood."""
    slopes = np.arange(-8, 9)

    def work(frames, x, t, scores):
        _, _, y = _at_best(frames, x, scores)
        turn = np.exp(-2j * np.pi * slopes[:, None] * np.arange(PERIOD) / 128)
        energy = (np.abs(t) ** 2).sum() * (np.abs(y) ** 2).sum(axis=1)
        s = np.abs((y * np.conj(t)) @ turn.T) ** 2
        s = np.divide(s, energy[:, None], out=np.zeros(s.shape), where=energy[:, None] > 0)
        best = np.round(s, 9).argmax(axis=1)
        return [(k, int(slopes[j]), float(s[k, j]), float(s[k].mean())) for k, j in enumerate(best)]

    found = acquisition.each(_vectors(spark, sf_dir), "vec_id long, frame int, slope int, share double, mean double", work, PERIOD)
    return found.select("vec_id", "frame", "slope", F.round("share", 6).alias("share"), F.round("mean", 6).alias("mean"))


@query("d20_known_pilot", f"""WITH {_CARRIER}, g AS (SELECT vec_id, k % 2 AS half, sum(re) / sum(et) AS gr, sum(im) / sum(et) AS gi FROM car GROUP BY 1, 2),
z AS (SELECT c.*, gr, gi, gr * ti - gi * tq AS wi, gr * tq + gi * ti AS wq, (yi * gr + yq * gi) AS zi, (yq * gr - yi * gi) AS zq FROM car c JOIN g ON g.vec_id = c.vec_id AND g.half <> c.k % 2)
SELECT vec_id, count(*) AS samples, round(avg(CASE WHEN (zi > 0) = (ti > 0) AND (zq > 0) = (tq > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(sqrt(sum((yi - wi) ** 2 + (yq - wq) ** 2) / sum(wi * wi + wq * wq)), 4) AS evm,
round(avg((zi * ti + zq * tq) / sqrt((zi * zi + zq * zq) * (ti * ti + tq * tq))), 6) AS confidence FROM z GROUP BY 1""")
def known_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demodulation of the known pattern with a cross-fitted equaliser: even frames take the gain that odd ones give and the other way round.
    Share of samples in the pattern's quadrant, error vector magnitude, and the mean cosine to the pattern."""

    def work(frames, x, t, scores):
        _, _, y = _at_best(frames, x, scores)
        half = np.arange(len(y)) % 2
        if len(y) < 2:
            return []
        gain = np.array([(y[half != h] * np.conj(t)).sum() / ((np.abs(t) ** 2).sum() * (half != h).sum()) for h in (0, 1)])[half]
        want, z = gain[:, None] * t, y * np.conj(gain)[:, None]
        right = ((z.real > 0) == (t.real > 0)) & ((z.imag > 0) == (t.imag > 0))
        size = np.abs(z) * np.abs(t)
        cosine = np.divide((z * np.conj(t)).real, size, out=np.zeros(size.shape), where=size > 0)
        power = (np.abs(want) ** 2).sum()
        return [(y.size, float(right.mean()), float(np.sqrt((np.abs(y - want) ** 2).sum() / power)) if power > 0 else None, float(cosine.mean()))]

    found = acquisition.each(_vectors(spark, sf_dir), "vec_id long, samples long, accuracy double, evm double, confidence double", work, PERIOD)
    return found.select("vec_id", "samples", F.round("accuracy", 6).alias("accuracy"), F.round("evm", 4).alias("evm"), F.round("confidence", 6).alias("confidence"))


@query("d30_blind_pair", f"""WITH {SAMPLES_SQL}, p AS (SELECT x.vec_id, b, sum((y.i * x.i + y.q * x.q) * cos(a) - (y.i * x.q - y.q * x.i) * sin(a)) AS re, sum((y.i * x.i + y.q * x.q) * sin(a) + (y.i * x.q - y.q * x.i) * cos(a)) AS im, sum((x.i * x.i + x.q * x.q)::DOUBLE) AS ex, sum((y.i * y.i + y.q * y.q)::DOUBLE) AS ey
FROM (SELECT smp.*, b, -2 * pi() * b * n / 64 AS a FROM smp, range(-4, 5) AS r(b)) x JOIN smp y ON y.vec_id = x.vec_id + 1 AND y.n = x.n WHERE x.vec_id % 2 = 0 GROUP BY 1, 2),
s AS (SELECT vec_id, b, sqrt((re * re + im * im) / (ex * ey)) AS s FROM p) SELECT vec_id, b::INT AS bin, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, b) AS r FROM s) WHERE r = 1""")
def blind_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two vectors that follow each other, how alike they are at the best frequency between them, without a pattern."""
    rows = _plain(spark, sf_dir)
    other = rows.where("id % 2 = 1").select((F.col("id") - 1).alias("id"), F.col("i").alias("ti"), F.col("q").alias("tq"))
    # vectors of other lengths aren't alike
    pairs = rows.where("id % 2 = 0").join(other, "id").where("size(i) = size(ti) and size(i) = 32")

    def work(frames, x, t, scores):
        s = frames.scores(x[None], t[None], acquisition.coarse())[0, 0]
        b = int(np.round(s, 9).argmax())
        return [(b - acquisition.BINS, float(s[b]))]

    found = acquisition.each(pairs, "vec_id long, bin int, score double", work, 32)
    return found.select("vec_id", "bin", F.round("score", 6).alias("score"))
