"""Array kernels on sample vectors; labels are templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import kernels
from quillon.plans.registry import query
from quillon.sources.tables import OBSERVATIONS_SQL, SAMPLES_SQL, observations, sample_arrays, samples

_TEMPLATES = "tpl AS (SELECT label AS template, n, sum(i)::BIGINT AS ti, sum(q)::BIGINT AS tq FROM smp GROUP BY 1, 2)"


def _score(tpl: str, name: str) -> str:
    return f"""{name} AS (SELECT vec_id, label, template, sqrt((re * re + im * im) / (et * ex)) AS score FROM (SELECT vec_id, label, template, sum(ti::DOUBLE * i + tq::DOUBLE * q) AS re, sum(ti::DOUBLE * q - tq::DOUBLE * i) AS im,
sum(ti::DOUBLE * ti + tq::DOUBLE * tq) AS et, sum((i * i + q * q)::DOUBLE) AS ex FROM smp JOIN {tpl} t USING (n) GROUP BY 1, 2, 3))"""


def _scores(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    rows = samples(spark, sf_dir)
    template = kernels.templates(rows, "label", "n", "i", "q")
    return kernels.correlation(rows, kernels.rolled(template, "n", shift, 32), ["vec_id", "label"], "n", "i", "q")


@query("d04_template_score", f"WITH {SAMPLES_SQL}, {_TEMPLATES}, {_score('tpl', 'sc')} SELECT vec_id, template, round(score, 6) AS score FROM sc")
def template_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, 0).select("vec_id", "template", F.round("score", 6).alias("score"))


@query("d03_control_margin", f"""WITH {SAMPLES_SQL}, {_TEMPLATES}, rol AS (SELECT template, (n + 7) % 32 AS n, ti, tq FROM tpl), {_score('tpl', 'sc')}, {_score('rol', 'co')},
b AS (SELECT vec_id, label, max(sc.score) AS exact, max(co.score) AS control FROM sc JOIN co USING (vec_id, label, template) GROUP BY 1, 2)
SELECT vec_id, label, round(exact, 6) AS exact, round(control, 6) AS control, round(exact - control, 6) AS margin FROM b""")
def control_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = _scores(spark, sf_dir, 0).groupBy("vec_id", "label").agg(F.max("score").alias("exact"))
    control = _scores(spark, sf_dir, 7).groupBy("vec_id", "label").agg(F.max("score").alias("control"))
    both = exact.join(control, ["vec_id", "label"])
    return both.select("vec_id", "label", F.round("exact", 6).alias("exact"), F.round("control", 6).alias("control"), F.round(F.col("exact") - F.col("control"), 6).alias("margin"))


@query("d12_anchor_power", f"""WITH {SAMPLES_SQL}, f AS (SELECT vec_id, n // 8 AS frame, sum(i)::DOUBLE AS x, sum(q)::DOUBLE AS y, sum(sqrt((i * i + q * q)::DOUBLE)) AS a, avg((i * i + q * q)::DOUBLE) AS p FROM smp GROUP BY 1, 2)
SELECT vec_id, round(sum(x * x + y * y) / sum(a * a), 6) AS anchor, round(avg(p) / 1073741824, 9) AS tracker FROM f GROUP BY 1""")
def anchor_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of eight samples within each vector's row: nothing is shuffled."""
    part = lambda c, f: F.slice(F.col(c), f * 8 + 1, F.lit(8))
    sized = lambda f: kernels.energy(part("i", f), part("q", f))
    frame = lambda f: F.struct(
        kernels.total(part("i", f), "bigint").cast("double").alias("x"), kernels.total(part("q", f), "bigint").cast("double").alias("y"), kernels.total(F.transform(sized(f), lambda e: F.sqrt(e))).alias("a"), (kernels.total(sized(f), "bigint") / 8.0).alias("p")
    )
    rows = sample_arrays(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), frame).alias("f"))
    of = lambda f: kernels.total(F.transform("f", f))
    return rows.select("vec_id", F.round(of(lambda s: s["x"] * s["x"] + s["y"] * s["y"]) / of(lambda s: s["a"] * s["a"]), 6).alias("anchor"), F.round(of(lambda s: s["p"]) / 4 / 1073741824, 9).alias("tracker"))


@query("d13_differential_score", f"""WITH {SAMPLES_SQL}, l AS (SELECT vec_id, i::DOUBLE AS x, q::DOUBLE AS y, lag(i::DOUBLE) OVER w AS a, lag(q::DOUBLE) OVER w AS b FROM smp WINDOW w AS (PARTITION BY vec_id ORDER BY n)),
s AS (SELECT vec_id, sum(x * a + y * b) AS re, sum(y * a - x * b) AS im, sum(sqrt((x * x + y * y) * (a * a + b * b))) AS c FROM l WHERE a IS NOT NULL GROUP BY 1)
SELECT vec_id, round(sqrt(re * re + im * im) / c, 6) AS score, round(atan2(im, re) / (2 * pi()), 6) AS frequency FROM s""")
def differential_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kernels.differential(sample_arrays(spark, sf_dir), ["vec_id"], "i", "q")
    return found.select("vec_id", F.round("score", 6).alias("score"), F.round("frequency", 6).alias("frequency"))


_DFT = "dft AS (SELECT vec_id, b::INT AS bin, sum(i * cos(-2 * pi() * (b * n % 64) / 64) - q * sin(-2 * pi() * (b * n % 64) / 64)) AS re, sum(i * sin(-2 * pi() * (b * n % 64) / 64) + q * cos(-2 * pi() * (b * n % 64) / 64)) AS im FROM smp, range(64) AS r(b) GROUP BY 1, 2)"


@query("d14_glrt_grid", f"""WITH {SAMPLES_SQL}, {_DFT}, c AS (SELECT vec_id, sum(sqrt((i * i + q * q)::DOUBLE)) AS a FROM smp GROUP BY 1), g AS (SELECT vec_id, bin, round((re * re + im * im) / (a * a), 9) AS s FROM dft JOIN c USING (vec_id))
SELECT vec_id, bin AS best_bin, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, bin) AS r FROM g) WHERE r = 1""")
def glrt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    ceiling = rows.groupBy("vec_id").agg(F.sum(F.sqrt(F.col("i") * F.col("i") + F.col("q") * F.col("q"))).alias("a"))
    grid = kernels.rotated_sums(rows, ["vec_id"], "n", "i", "q", 64, 64).join(ceiling, "vec_id")
    score = F.round((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("a") * F.col("a")), 9)
    best = grid.groupBy("vec_id").agg(F.min(F.struct((-score).alias("s"), "bin")).alias("x"))
    return best.select("vec_id", F.col("x.bin").alias("best_bin"), F.round(-F.col("x.s"), 6).alias("score"))


@query("d01_waterfall_bins", f"""WITH {SAMPLES_SQL}, win AS (SELECT vec_id, label, n, i * (0.5 - 0.5 * cos(2 * pi() * n / 32)) AS i, q * (0.5 - 0.5 * cos(2 * pi() * n / 32)) AS q FROM smp),
dft AS (SELECT vec_id, label, b, sum(i * cos(-2 * pi() * (b * n % 32) / 32) - q * sin(-2 * pi() * (b * n % 32) / 32)) AS re, sum(i * sin(-2 * pi() * (b * n % 32) / 32) + q * cos(-2 * pi() * (b * n % 32) / 32)) AS im FROM win, range(32) AS r(b) GROUP BY 1, 2, 3)
SELECT label AS time_bin, ((b + 16) % 32 // 4)::INT AS freq_bin, count(DISTINCT vec_id) AS spectra, round(greatest(-160.0, 10 * log10(sum(re * re + im * im) / count(DISTINCT vec_id) / (32 * 12 * 1073741824.0::DOUBLE))), 4) AS power_db FROM dft GROUP BY 1, 2""")
def waterfall_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    hann = F.expr("0.5D - 0.5D * cos(2 * pi() * n / 32)")
    rows = samples(spark, sf_dir).select("vec_id", "label", "n", (F.col("i") * hann).alias("i"), (F.col("q") * hann).alias("q"))
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    found = kernels.rotated_sums(rows, ["vec_id", "label"], "n", "i", "q", 32, 32).groupBy(F.col("label").alias("time_bin"), F.expr("(bin + 16) % 32 div 4").cast("int").alias("freq_bin")).agg(F.count_distinct("vec_id").alias("spectra"), F.sum(power).alias("p"))
    return found.select("time_bin", "freq_bin", "spectra", F.round(F.greatest(F.lit(-160.0), 10 * F.log10(F.col("p") / F.col("spectra") / (32 * 12 * 1073741824.0))), 4).alias("power_db"))


@query("d18_dechirp", f"""WITH {SAMPLES_SQL}, r AS (SELECT vec_id, i * cos(a) - q * sin(a) AS x, i * sin(a) + q * cos(a) AS y FROM (SELECT *, -2 * pi() * (0.03125::DOUBLE * n + 0.001::DOUBLE * n * n) AS a FROM smp)) SELECT vec_id, round(sum(x), 2) AS di, round(sum(y), 2) AS dq FROM r GROUP BY 1""")
def dechirp(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = kernels.dechirp(samples(spark, sf_dir), "n", "i", "q", 0.03125, 0.001)
    return turned.groupBy("vec_id").agg(F.round(F.sum("di"), 2).alias("di"), F.round(F.sum("dq"), 2).alias("dq"))


@query("d09_quadratic_peak", f"""WITH {OBSERVATIONS_SQL}, n AS (SELECT id, cents AS m, lag(cents) OVER w AS l, lead(cents) OVER w AS r FROM obs WINDOW w AS (PARTITION BY path ORDER BY t_us))
SELECT id, round(greatest(-0.5, least(0.5, 0.5 * (l - r)::DOUBLE / (l - 2 * m + r))), 6) + 0.0 AS "offset" FROM n WHERE l < m AND r < m""")
def quadratic_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).selectExpr("id", "cents as m", "lag(cents) over (partition by path order by t_us) as l", "lead(cents) over (partition by path order by t_us) as r").where("l < m and r < m")
    found = rows.select("id", F.round(kernels.peak_offset(F.col("l").cast("double"), F.col("m").cast("double"), F.col("r").cast("double")), 6).alias("offset"))
    return found.withColumn("offset", F.col("offset") + 0.0)


@query("d29_int16_lossless", "SELECT vec_id, count(*) FILTER (x * 32767 <> round_even(x * 32767, 0)) AS fractional, count(*) FILTER (abs(x * 32767) > 32767) AS outside FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def int16_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.expr("transform(embedding, x -> cast(x as double) * 32767)").alias("v"))
    return rows.select("vec_id", F.expr("cast(size(filter(v, x -> x <> bround(x, 0))) as bigint)").alias("fractional"), F.expr("cast(size(filter(v, x -> abs(x) > 32767)) as bigint)").alias("outside"))


@query("o03_greedy_suppression")
def greedy_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = observations(spark, sf_dir).select("path", F.expr("t_us div 1000000").alias("second"), "cents", "id")
    return kernels.suppress(peaks, ["path"], "second", "cents", "id", 6 * 3600)
