"""Fitting operators on observations: time in hours from the first of January 2024, values in hundredths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import fitting, intervals, ordered
from quillon.plans.registry import query
from quillon.session import ship
from quillon.sources.shared import ensure_checkpoint_dir
from quillon.sources.tables import OBSERVATIONS_SQL, observations

HOUR = 3_600_000_000
_START = 1_704_067_200_000_000
_SLOPES = [float(x) for x in range(-60, 61, 10)]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("id", "path", "k", "cents", ((F.col("t_us") - _START) / float(HOUR)).alias("t"))


_P = f"{OBSERVATIONS_SQL}, pts AS (SELECT id, path, k, cents, (t_us - {_START}) / {float(HOUR)}::DOUBLE AS t FROM obs)"


@query("k03_hough_votes", f"""WITH {_P}, v AS (SELECT path, s::INT AS slope_index, k, cents - (s * 10.0::DOUBLE - 60) * t AS x FROM pts, range(13) AS r(s))
SELECT path, slope_index, floor((x - 22727 * floor(x / 22727)) * 64 / 22727)::INT AS bin, sum(k)::BIGINT AS votes, count(*) AS support FROM v GROUP BY 1, 2, 3""")
def hough_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitting.hough_votes(_points(ship(spark), sf_dir), ["path"], "t", "cents", "k", _SLOPES, 22727.0, 64)


@query("k03_hough_lines", f"""WITH {_P}, v AS (SELECT path, s::INT AS slope_index, k, cents - (s * 10.0::DOUBLE - 60) * t AS x FROM pts, range(13) AS r(s)),
c AS (SELECT path, slope_index, floor((x - 22727 * floor(x / 22727)) * 64 / 22727)::INT AS bin, sum(k)::BIGINT AS votes, count(*) AS support FROM v GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY votes DESC, support DESC, slope_index, bin)::INT AS rank FROM c) WHERE rank <= 4""")
def hough_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitting.hough_best(_points(ship(spark), sf_dir), ["path"], "t", "cents", "k", _SLOPES, 22727.0, 64, 4)


@query("k10_ols_lines", f"WITH {_P} SELECT path, count(*) AS n, round(regr_slope(cents, t), 6) AS slope, round(regr_intercept(cents, t), 4) AS intercept, round(regr_r2(cents, t), 6) AS r2 FROM pts GROUP BY 1")
def ols_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).groupBy("path")
    return points.agg(F.count("*").alias("n"), F.round(F.regr_slope("cents", "t"), 6).alias("slope"), F.round(F.regr_intercept("cents", "t"), 4).alias("intercept"), F.round(F.regr_r2("cents", "t"), 6).alias("r2"))


@query("k09_theil_sen", f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY t) AS i FROM pts), s AS (SELECT x.path, median((y.cents - x.cents) / (y.t - x.t)) AS slope, count(*) AS pairs FROM r x JOIN r y ON x.path = y.path AND y.i > x.i AND y.i <= x.i + 12 AND y.t > x.t GROUP BY 1)
SELECT path, round(slope, 6) AS slope, pairs, round(median(cents - slope * t), 4) AS intercept FROM pts JOIN s USING (path) GROUP BY 1, slope, 3""")
def theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fitting.theil_sen(_points(spark, sf_dir).withColumn("cents", F.col("cents").cast("double")), ["path"], "t", "cents", 12)
    return found.select("path", F.round("slope", 6).alias("slope"), "pairs", F.round("intercept", 4).alias("intercept"))


@query("k09_theil_sen_all_pairs", f"""WITH {_P}, s AS (SELECT x.path, median((y.cents - x.cents) / (y.t - x.t)) AS slope, count(*) AS pairs FROM pts x JOIN pts y ON x.path = y.path AND y.t > x.t GROUP BY 1)
SELECT path, round(slope, 6) AS slope, pairs, round(median(cents - slope * t), 4) AS intercept FROM pts JOIN s USING (path) GROUP BY 1, slope, 3""")
def theil_sen_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median over all pairs of a path, found by counting and not by listing them."""

    def fit(t, v):
        slope, pairs = fitting.median_slope(t, v)
        return round(slope, 6), pairs, round(float(np.median(v - slope * t)), 4)

    points = _points(ship(spark), sf_dir).withColumn("v", F.col("cents").cast("double"))
    return fitting.by_key(points, ["path"], ["t", "id"], ["t", "v"], "path long, slope double, pairs long, intercept double", fit).where("pairs > 0")


@query("k12_poly_bic", f"""WITH {_P}, c AS (SELECT path, avg(t) AS ref, count(*) AS n FROM pts GROUP BY 1), s AS (SELECT path, n, ref, sum((t - ref) ** 2) AS s2, sum((t - ref) ** 3) AS s3, sum((t - ref) ** 4) AS s4, sum(cents)::DOUBLE AS y0, sum((t - ref) * cents) AS y1, sum((t - ref) ** 2 * cents) AS y2 FROM pts JOIN c USING (path) GROUP BY 1, 2, 3),
f AS (SELECT *, (n * (s2 * y2 - s3 * y1) - s2 * s2 * y0) / (n * (s2 * s4 - s3 * s3) - s2 * s2 * s2) AS c2 FROM s WHERE n > 3), g AS (SELECT path, n, ref, c2, (y1 - c2 * s3) / s2 AS c1, (y0 - c2 * s2) / n AS c0 FROM f)
SELECT path, n, round(c0, 3) AS c0, round(c1, 5) AS c1, round(c2, 7) AS c2, round(sqrt(avg((cents - c0 - c1 * (t - ref) - c2 * (t - ref) ** 2) ** 2)), 2) AS rms FROM pts JOIN g USING (path) GROUP BY path, n, c0, c1, c2""")
def poly_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fitting.quadratic_fit(_points(spark, sf_dir), ["path"], "t", "cents")
    return found.select("path", "n", F.round("c0", 3).alias("c0"), F.round("c1", 5).alias("c1"), F.round("c2", 7).alias("c2"), F.round("rms", 2).alias("rms"))


@query("k11_huber_lines")
def huber_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fit(rows: pd.DataFrame):
        rows = rows.sort_values(["t", "id"])
        slope, intercept, scale = fitting.huber_line(rows["t"].to_numpy(), rows["cents"].to_numpy(float))
        return {"n": [len(rows)], "slope": [round(slope, 6)], "intercept": [round(intercept, 4)], "scale": [round(scale, 4)]}

    return fitting.by_group(_points(ship(spark), sf_dir), ["path"], "path long, n long, slope double, intercept double, scale double", fit)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a path and day: groups bounded by what a day holds."""
    return _points(ship(spark), sf_dir).withColumn("day", F.floor(F.col("t") / 24)).withColumn("v", F.col("cents").cast("double"))


@query("k06_ransac_lines")
def ransac_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fit(t, v):
        hits, slope, intercept = fitting.ransac_line(t, v, 1000.0, 2000.0)
        return len(t), hits, round(slope, 6), round(intercept, 4)

    return fitting.by_key(_daily(spark, sf_dir), ["path", "day"], ["t", "id"], ["t", "v"], "path long, day long, n long, inliers long, slope double, intercept double", fit)


#: Reach of a pair in microseconds, partners drawn for a point, periods that a partner may be lifted; the rest as ``fitting.consensus_lines`` names it.
CONSENSUS = {"reach": 96 * HOUR, "draws": 4, "lifts": 1, "period": 22727.0, "gate": 700.0, "steepest": 300.0, "step": 5.0, "support": 5, "tracks": 3}


def consensus_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("id", "path", F.col("t_us").alias("u"), ((F.col("t_us") - _START) / float(HOUR)).alias("t"), F.col("cents").cast("double").alias("v"))


@query("k06_consensus_lines")
def consensus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several lines of a path, found by drawn hypotheses and peeled."""
    found = fitting.consensus_lines(consensus_points(ship(spark), sf_dir), ["path"], **CONSENSUS)
    return found.select("path", "track", "id", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("rms", 4).alias("rms"))


@query("k07_dp_tracks")
def dp_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fit(t, v):
        length, cost = fitting.best_chain(t, v, 12.0, 4000.0, 1.0, 0.1, 0.0002)
        return len(t), length, round(cost, 6)

    return fitting.by_key(_daily(spark, sf_dir), ["path", "day"], ["t", "id"], ["t", "v"], "path long, day long, n long, length long, cost double", fit)


@query("k23_path_cover")
def path_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fit(t, v):
        edges = [(i, j, abs(v[j] - v[i]) / 4000 + 0.15 * max(0.0, round((t[j] - t[i]) / 1.0) - 1)) for i in range(len(t)) for j in range(i + 1, len(t)) if 0 < t[j] - t[i] <= 8]
        cost, follow = fitting.path_cover(len(t), edges, 4.0)
        return len(t), sum(x >= 0 for x in follow), round(cost, 6)

    return fitting.by_key(_daily(spark, sf_dir), ["path", "day"], ["t", "id"], ["t", "v"], "path long, day long, n long, edges long, cost double", fit)


@query("k27_kalman_tracks")
def kalman_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(state, row):
        ident, t, z = row
        before, held = state or (t, fitting.kalman_start(z, 4e6))
        held, taken = fitting.kalman_step(held, t - before, z, 50.0, 4e6, 3.0)
        return (t, held), (ident, held[0], held[1], taken)

    points = _points(ship(spark), sf_dir).withColumn("z", F.col("cents").cast("double"))
    found = ordered.streamed(points, ["path"], ["t", "id"], ["id", "t", "z"], "path long, id long, level double, rate double, taken boolean", lambda: None, step)
    return found.select("path", "id", F.round("level", 4).alias("level"), F.round("rate", 6).alias("rate"), "taken")


@query("u03_alias_components", f"""WITH RECURSIVE {_P}, near AS (SELECT x.id AS a, y.id AS b, round_even((y.cents - x.cents) / 2273.0::DOUBLE, 0)::BIGINT AS delta FROM pts x JOIN pts y ON x.path = y.path AND y.t > x.t AND y.t - x.t <= 1.5),
both_ AS (SELECT a, b, delta FROM near UNION ALL SELECT b, a, -delta FROM near), reach AS (SELECT DISTINCT a AS node, a AS root FROM both_ UNION SELECT e.b, r.root FROM reach r JOIN both_ e ON e.a = r.node)
SELECT node, min(root) AS root FROM reach GROUP BY 1""")
def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(ensure_checkpoint_dir(spark), sf_dir).withColumn("us", F.expr(f"cast(bround(t * {HOUR}D, 0) as bigint)"))
    side = lambda s: rows.select("path", *[F.col(c).alias(f"{s}{c}") for c in ("id", "us", "cents")])
    pairs = intervals.near_pairs(side("x"), side("y"), ["path"], "xus", "yus", HOUR * 3 // 2)
    edges = pairs.select(F.col("xid").alias("a"), F.col("yid").alias("b"), F.expr("cast(bround((ycents - xcents) / 2273D, 0) as bigint)").alias("delta"))
    return fitting.potentials(edges).select("node", "root")


@query("k01_circular_residual", f"WITH {_P} SELECT id, round((cents - 12.5::DOUBLE * t) + 1136.5 - 2273 * floor(((cents - 12.5::DOUBLE * t) + 1136.5) / 2273) - 1136.5, 4) AS residual FROM pts")
def circular_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.ordered import wrapped

    return _points(spark, sf_dir).select("id", F.round(wrapped(F.col("cents") - 12.5 * F.col("t"), 2273.0), 4).alias("residual"))
