"""Tracks of observations modulo a period, and acquisition on sample vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import kernels, tracks
from quillon.plans.registry import query
from quillon.session import ship
from quillon.sources.shared import ensure_checkpoint_dir
from quillon.sources.tables import OBSERVATIONS_SQL, SAMPLES_SQL, observations, samples

PERIOD = 2273.0
_SLOPES = [float(x) for x in range(-30, 31, 10)]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a path and week."""
    return observations(spark, sf_dir).selectExpr("path", "(t_us - 1704067200000000) div 604800000000 as week", "id", "(t_us - 1704067200000000) / 3.6e9D as t", "cast(cents as double) as v", "cast(k + 1 as double) as w")


@query("k02_lifted_lines", f"""WITH {OBSERVATIONS_SQL}, p AS (SELECT path, (t_us - 1704067200000000) // 604800000000 AS week, (t_us - 1704067200000000) / 3.6e9 AS t, cents::DOUBLE AS v, k + 1.0::DOUBLE AS w FROM obs),
y AS (SELECT *, 500 + (v - 500 + 1136.5 - 2273 * floor((v - 500 + 1136.5) / 2273) - 1136.5) AS y FROM p), s AS (SELECT path, week, count(*) AS n, sum(w) AS w, sum(w * t) AS wt, sum(w * t * t) AS wtt, sum(w * y) AS wy, sum(w * t * y) AS wty FROM y GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN abs(w * wtt - wt * wt) > 1e-9 THEN (w * wty - wt * wy) / (w * wtt - wt * wt) ELSE 0 END AS slope FROM s) SELECT path, week, round(slope, 5) AS slope, round((wy - slope * wt) / w, 3) AS intercept, n FROM f WHERE n > 3""")
def lifted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    start = points.select("path", "week").distinct().withColumns({"slope": F.lit(0.0), "intercept": F.lit(500.0)})
    lines = tracks.lifted_line(points, start, ["path", "week"], PERIOD, 1).where("n > 3")
    return lines.select("path", "week", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"), "n")


@query("k05_peeled_tracks")
def peeled_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.peeled(_points(ship(spark), sf_dir), ["path", "week"], _SLOPES, PERIOD, 16, 300.0, 4, 3)


@query("k15_hard_assignment")
def hard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(ensure_checkpoint_dir(ship(spark)), sf_dir)
    seeds = tracks.voted_lines(points, ["path", "week"], _SLOPES, PERIOD, 16, 3)
    lines, own = tracks.hard_assignment(points, seeds, ["path", "week"], PERIOD, 400.0)
    members = own.groupBy("path", "week", "track").agg(F.count("*").alias("members"))
    return lines.join(members, ["path", "week", "track"]).select("path", "week", "track", "members", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("rms", 4).alias("rms"))


_GRID = """(SELECT s.vec_id, h AS shift, b::INT AS bin, sum((ti * i + tq * q) * cos(a) - (ti * q - tq * i) * sin(a)) AS re, sum((ti * i + tq * q) * sin(a) + (ti * q - tq * i) * cos(a)) AS im, sum(ti * ti + tq * tq) AS et, sum((i * i + q * q)::DOUBLE) AS ex
FROM (SELECT s.vec_id, s.n, s.i, s.q, h, b, t.ti::DOUBLE AS ti, t.tq::DOUBLE AS tq, -2 * pi() * ((b - 4) * s.n % 128) / 128 AS a FROM smp s JOIN range(0, 32, 4) AS r(h) ON TRUE JOIN range(9) AS g(b) ON TRUE JOIN {0} t ON t.template = s.label AND t.n = (s.n + 32 - h) % 32) s GROUP BY 1, 2, 3)"""


@query("d08_acquisition", f"""WITH {SAMPLES_SQL}, tpl AS (SELECT label AS template, n, sum(i)::BIGINT AS ti, sum(q)::BIGINT AS tq FROM smp GROUP BY 1, 2), rol AS (SELECT template, (n + 7) % 32 AS n, ti, tq FROM tpl),
g AS (SELECT vec_id, shift, bin, round(sqrt((re * re + im * im) / (et * ex)), 9) AS score FROM {_GRID.format('tpl')}), c AS (SELECT vec_id, shift, bin, round(sqrt((re * re + im * im) / (et * ex)), 9) AS control FROM {_GRID.format('rol')}),
n AS (SELECT *, lag(score) OVER w AS l, lead(score) OVER w AS r FROM g WINDOW w AS (PARTITION BY vec_id, shift ORDER BY bin)), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, shift, bin) AS k FROM n) WHERE k = 1)
SELECT vec_id, shift::INT AS shift, bin, round(score, 6) AS score, round(CASE WHEN l IS NULL OR r IS NULL OR l - 2 * score + r = 0 THEN 0.0 ELSE greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * score + r))) END, 3) + 0.0 AS "offset", round(score - control, 6) AS margin FROM best JOIN c USING (vec_id, shift, bin)""")
def acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best timing shift and frequency bin of each vector against its own label's template, the peak interpolated between bins, and
    the margin over the rolled control at the same place."""
    rows = samples(spark, sf_dir)
    template = kernels.templates(rows, "label", "n", "i", "q")

    def grid(shape: DataFrame, name: str) -> DataFrame:
        wide = rows.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(28), F.lit(4)))).withColumn("m", F.expr("int((n + 32 - shift) % 32)"))
        met = wide.join(shape.select(F.col("template").alias("label"), F.col("n").alias("m"), F.col("ti").cast("double").alias("ti"), F.col("tq").cast("double").alias("tq")), ["label", "m"])
        met = met.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("a", F.expr("-2 * pi() * ((bin - 4) * n % 128) / 128"))
        x, y = "(ti * i + tq * q)", "(ti * q - tq * i)"
        sums = met.groupBy("vec_id", "shift", "bin").agg(F.sum(F.expr(f"{x} * cos(a) - {y} * sin(a)")).alias("re"), F.sum(F.expr(f"{x} * sin(a) + {y} * cos(a)")).alias("im"), F.sum(F.expr("ti * ti + tq * tq")).alias("et"), F.sum(F.expr("cast(i * i + q * q as double)")).alias("ex"))
        return sums.select("vec_id", "shift", "bin", F.round(F.sqrt((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("et") * F.col("ex"))), 9).alias(name))

    w = Window.partitionBy("vec_id", "shift").orderBy("bin")
    score = grid(template, "score").withColumns({"l": F.lag("score").over(w), "r": F.lead("score").over(w)})
    best = score.groupBy("vec_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "shift", "bin", "l", "r")).alias("x")).select("vec_id", "x.shift", "x.bin", (-F.col("x.s")).alias("score"), "x.l", "x.r")
    control = grid(kernels.rolled(template, "n", 7, 32), "control")
    offset = F.when(F.col("l").isNull() | F.col("r").isNull(), 0.0).otherwise(kernels.peak_offset(F.col("l"), F.col("score"), F.col("r")))
    return best.join(control, ["vec_id", "shift", "bin"]).select("vec_id", "shift", "bin", F.round("score", 6).alias("score"), (F.round(offset, 3) + 0.0).alias("offset"), F.round(F.col("score") - F.col("control"), 6).alias("margin"))
