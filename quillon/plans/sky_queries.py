"""Sky operators on synthetic directions: embeddings as unit vectors, observations as instants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import sky
from quillon.functions.rounding import rounded
from quillon.plans.registry import query
from quillon.sources.tables import OBSERVATIONS_SQL, observations, table


@query("g02_sidereal_time", f"""WITH {OBSERVATIONS_SQL}, c AS (SELECT id, (floor((t_us - 946728000000000) / 86400000000.0::DOUBLE) + ((t_us - 946728000000000) - floor((t_us - 946728000000000) / 86400000000.0::DOUBLE) * 86400000000) / 86400000000.0::DOUBLE) / 36525.0::DOUBLE AS t FROM obs),
s AS (SELECT id, (67310.54841::DOUBLE + t * (876600.0::DOUBLE * 3600 + 8640184.812866) + t * t * 0.093104::DOUBLE - t * t * t * 6.2e-6::DOUBLE) / 240.0 AS d FROM c) SELECT id, round(d - 360 * floor(d / 360), 5) AS gmst FROM s""")
def sidereal_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("id", F.round(sky.gmst_degrees(F.col("t_us")), 5).alias("gmst"))


def _directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of objects: each vector's components in fours as azimuth and elevation of a moment."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "posexplode(transform(sequence(0, 15), i -> slice(embedding, 4 * i + 1, 4))) as (sample, v)")
    x, y, z = (F.col("v")[i].cast("double") for i in range(3))
    flat = F.sqrt(x * x + y * y)
    return rows.select("vec_id", "label", "sample", F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0)).alias("az"), F.degrees(F.atan2(z, flat)).alias("el"))


_DIR = """dir AS (SELECT vec_id, label, s::INT AS sample, d - 360 * floor(d / 360) AS az, el FROM (SELECT vec_id, label, s, degrees(atan2(embedding[4 * s + 1]::DOUBLE, embedding[4 * s + 2]::DOUBLE)) AS d,
degrees(atan2(embedding[4 * s + 3]::DOUBLE, sqrt(embedding[4 * s + 1]::DOUBLE * embedding[4 * s + 1]::DOUBLE + embedding[4 * s + 2]::DOUBLE * embedding[4 * s + 2]::DOUBLE))) AS el FROM embeddings, range(16) AS r(s)))"""


@query("g04_boresight_screen", f"""WITH {_DIR}, u AS (SELECT *, acos(greatest(-1, least(1, cos(radians(el)) * cos(radians(50)) * cos(radians(az - 120)) + sin(radians(el)) * sin(radians(50))))) * 180 / pi() AS sep FROM dir),
f AS (SELECT vec_id, bool_or(sep <= 25 - 2 AND el > 10 + 2) AS strict, bool_or(sep <= 25 + 2 AND el > 10 - 2) AS relaxed, bool_or(el > 10) AS up, min(sep) AS nearest FROM u GROUP BY 1)
SELECT CASE WHEN strict THEN 'definite' WHEN relaxed THEN 'ambiguous' WHEN up THEN 'outside_cone' ELSE 'below_mask' END AS class, count(*) AS objects, round(min(nearest), 4) AS nearest FROM f GROUP BY 1""")
def boresight_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    sep, el = sky.separation_degrees(F.col("az"), F.col("el"), F.lit(120.0), F.lit(50.0)), F.col("el")
    rows = _directions(spark, sf_dir).withColumn("sep", sep)
    flags = rows.groupBy("vec_id").agg(F.bool_or((F.col("sep") <= 23) & (el > 12)).alias("strict"), F.bool_or((F.col("sep") <= 27) & (el > 8)).alias("relaxed"), F.bool_or(el > 10).alias("up"), F.min("sep").alias("nearest"))
    kind = F.expr("case when strict then 'definite' when relaxed then 'ambiguous' when up then 'outside_cone' else 'below_mask' end")
    return flags.groupBy(kind.alias("class")).agg(F.count("*").alias("objects"), F.round(F.min("nearest"), 4).alias("nearest"))


@query("g03_look_angles", """WITH s AS (SELECT c_custkey AS object, -60 + c_nationkey * 5.0::DOUBLE AS lat, (c_custkey * 37 % 360)::DOUBLE AS lon, c_acctbal / 10.0 + 1200 AS h FROM customer),
e AS (SELECT object, (n + h) * cos(radians(lat)) * cos(radians(lon)) AS x, (n + h) * cos(radians(lat)) * sin(radians(lon)) AS y, (n * (1 - 0.0066943799901413165::DOUBLE) + h) * sin(radians(lat)) AS z FROM (SELECT *, 6378.137::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * sin(radians(lat)) ** 2) AS n FROM s)),
o AS (SELECT n * cos(radians(48)) * cos(radians(11)) AS ox, n * cos(radians(48)) * sin(radians(11)) AS oy, n * (1 - 0.0066943799901413165::DOUBLE) * sin(radians(48)) AS oz FROM (SELECT 6378.137::DOUBLE / sqrt(1 - 0.0066943799901413165::DOUBLE * sin(radians(48)) ** 2) AS n)),
d AS (SELECT object, x - ox AS x, y - oy AS y, z - oz AS z FROM e, o), l AS (SELECT object, sqrt(x * x + y * y + z * z) AS r, -sin(radians(11)) * x + cos(radians(11)) * y AS ea, -sin(radians(48)) * cos(radians(11)) * x - sin(radians(48)) * sin(radians(11)) * y + cos(radians(48)) * z AS no,
cos(radians(48)) * cos(radians(11)) * x + cos(radians(48)) * sin(radians(11)) * y + sin(radians(48)) * z AS up FROM d)
SELECT object, round(degrees(atan2(ea, no)) - 360 * floor(degrees(atan2(ea, no)) / 360), 4) AS azimuth, round(degrees(asin(up / r)), 4) AS elevation, round(r, 3) AS range_km FROM l""")
def look_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey as object", "-60 + c_nationkey * 5D as lat", "cast(c_custkey * 37 % 360 as double) as lon", "c_acctbal / 10D + 1200 as h")
    x, y, z = sky.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("h"))
    ox, oy, oz = sky.geodetic_to_ecef(F.lit(48.0), F.lit(11.0), F.lit(0.0))
    az, el, reach = sky.look_angles(F.lit(48.0), F.lit(11.0), x - ox, y - oy, z - oz)
    return rows.select("object", rounded(az, 4).alias("azimuth"), rounded(el, 4).alias("elevation"), rounded(reach, 3).alias("range_km"))


@query("g07_two_pass_field", f"""WITH {_DIR}, u AS (SELECT *, acos(greatest(-1, least(1, cos(radians(el)) * cos(radians(50)) * cos(radians(az - 120)) + sin(radians(el)) * sin(radians(50))))) * 180 / pi() AS sep FROM dir),
c AS (SELECT vec_id, bool_or(sep <= 25 - 6 AND el > 10 + 6) AS strict, bool_or(sep <= 25 + 6 AND el > 10 - 6) AS relaxed FROM u WHERE sample % 4 = 0 GROUP BY 1), r AS (SELECT u.vec_id, bool_or(sep <= 25 AND el > 10) AS inside, min(sep) AS nearest FROM u JOIN c ON c.vec_id = u.vec_id AND relaxed AND NOT strict GROUP BY 1)
SELECT c.vec_id, CASE WHEN strict THEN 'definite' WHEN NOT relaxed THEN 'excluded' WHEN inside THEN 'refined_in' ELSE 'refined_out' END AS class, round(nearest, 4) AS nearest FROM c LEFT JOIN r ON r.vec_id = c.vec_id""")
def two_pass_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarse pass over every fourth sample with a margin for what may happen between them, and a fine pass over all samples of the objects that
    it leaves open; the coarse pass decides what is read again."""
    sep, el = sky.separation_degrees(F.col("az"), F.col("el"), F.lit(120.0), F.lit(50.0)), F.col("el")
    rows = _directions(spark, sf_dir).withColumn("sep", sep)
    coarse = rows.where("sample % 4 = 0").groupBy("vec_id").agg(F.bool_or((F.col("sep") <= 19) & (el > 16)).alias("strict"), F.bool_or((F.col("sep") <= 31) & (el > 4)).alias("relaxed"))
    fine = rows.join(coarse.where("relaxed and not strict").select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").agg(F.bool_or((F.col("sep") <= 25) & (el > 10)).alias("inside"), F.min("sep").alias("nearest"))
    kind = F.expr("case when strict then 'definite' when not relaxed then 'excluded' when inside then 'refined_in' else 'refined_out' end")
    return coarse.join(fine, "vec_id", "left").select("vec_id", kind.alias("class"), F.round("nearest", 4).alias("nearest"))


def _cubic(knots: int) -> list[list[float]]:
    """Least-squares weights of the four coefficients of a cubic on evenly spaced knots from -1 to 1."""
    t = np.linspace(-1.0, 1.0, knots)
    return np.linalg.pinv(np.vander(t, 4, increasing=True)).tolist()


_KNOTS, _SPAN_S = 9, 120.0
_RATE = "({a} * sin(({k} - 4) / 3.0 + {b} % 7) + ({k} - 4) * 0.05)"
_FIT = [" + ".join(f"{w!r}::DOUBLE * y{k}" for k, w in enumerate(row)) for row in _cubic(_KNOTS)]


@query("g09_doppler_fit", f"""WITH r AS (SELECT s_suppkey AS object, {", ".join(f"-{_RATE.format(a='(s_acctbal / 1500.0::DOUBLE)', b='s_suppkey', k=k)} / 299792.458::DOUBLE * 11325000000 AS y{k}" for k in range(_KNOTS))} FROM supplier), f AS (SELECT *, {", ".join(f"{x} AS c{i}" for i, x in enumerate(_FIT))} FROM r)
SELECT object, round(y4, 3) + 0.0 AS doppler_hz, round(c0, 2) + 0.0 AS frequency_hz, round(c1 / {_SPAN_S}, 4) + 0.0 AS slope, round(2 * c2 / {_SPAN_S} / {_SPAN_S}, 6) + 0.0 AS acceleration, round(6 * c3 / {_SPAN_S} / {_SPAN_S} / {_SPAN_S}, 8) + 0.0 AS jerk FROM f""")
def doppler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doppler shifts of nine range rates about a moment, the cubic through them by least squares and its derivatives there.  On even knots the fit is a
    fixed weight for each knot and coefficient, so it is a sum of columns."""
    rate = lambda k: F.expr(_RATE.format(a="(s_acctbal / 1500D)", b="s_suppkey", k=k).replace("3.0", "3D").replace("0.05", "0.05D"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object"), *[sky.doppler_hz(rate(k), F.lit(11_325_000_000.0)).alias(f"y{k}") for k in range(_KNOTS)])
    c = [sum((F.col(f"y{k}") * w for k, w in enumerate(row)), F.lit(0.0)) for row in _cubic(_KNOTS)]
    return rows.select("object", (F.round("y4", 3) + 0.0).alias("doppler_hz"), (F.round(c[0], 2) + 0.0).alias("frequency_hz"), (F.round(c[1] / _SPAN_S, 4) + 0.0).alias("slope"), (F.round(2 * c[2] / _SPAN_S**2, 6) + 0.0).alias("acceleration"), (F.round(6 * c[3] / _SPAN_S**3, 8) + 0.0).alias("jerk"))


@query("g09_doppler_shift", """SELECT s_suppkey AS object, round(-(s_acctbal / 1500.0) / 299792.458::DOUBLE * 11325000000, 3) AS doppler_hz FROM supplier""")
def doppler_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.col("s_acctbal") / 1500.0
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object"), F.round(sky.doppler_hz(rate, F.lit(11_325_000_000.0)), 3).alias("doppler_hz"))


@query("g10_predictions", f"""WITH {_DIR}, u AS (SELECT *, acos(greatest(-1, least(1, cos(radians(el)) * cos(radians(50)) * cos(radians(az - 120)) + sin(radians(el)) * sin(radians(50))))) * 180 / pi() AS sep FROM dir)
SELECT vec_id, count(*) FILTER (el > 10) AS visible, min(sample) FILTER (el > 10) AS first_sample, max(sample) FILTER (el > 10) AS last_sample, arg_min(sample, struct_pack(x := round(sep, 6), s := sample)) AS nearest_sample, round(min(sep), 4) AS separation, round(arg_min(az, struct_pack(x := round(sep, 6), s := sample)), 4) AS azimuth, round(arg_min(el, struct_pack(x := round(sep, 6), s := sample)), 4) AS elevation FROM u GROUP BY 1 HAVING count(*) FILTER (el > 10) > 0""")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each object that rises over the mask: when it is up, and where it is nearest to the boresight."""
    sep = sky.separation_degrees(F.col("az"), F.col("el"), F.lit(120.0), F.lit(50.0))
    rows = _directions(spark, sf_dir).withColumn("sep", sep)
    up = F.when(F.col("el") > 10, F.col("sample"))
    near = F.min(F.struct(F.round("sep", 6).alias("x"), "sample", "az", "el"))
    found = rows.groupBy("vec_id").agg(F.count(up).alias("visible"), F.min(up).alias("first_sample"), F.max(up).alias("last_sample"), near.alias("n"), F.min("sep").alias("sep")).where("visible > 0")
    return found.select("vec_id", "visible", "first_sample", "last_sample", F.col("n.sample").alias("nearest_sample"), F.round("sep", 4).alias("separation"), F.round("n.az", 4).alias("azimuth"), F.round("n.el", 4).alias("elevation"))


@query("g11_sky_tracks", f"""WITH {_DIR}, v AS (SELECT vec_id, sample, az, el, sample - row_number() OVER (PARTITION BY vec_id ORDER BY sample) AS island FROM dir WHERE el > 0)
SELECT vec_id, min(sample) AS first_sample, count(*) AS points, string_agg(printf('%.2f %.2f', (90 - el) / 90 * sin(radians(az)), (90 - el) / 90 * cos(radians(az))), ';' ORDER BY sample) AS track FROM v GROUP BY vec_id, island""")
def sky_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks over the horizon as a sky view draws them: a piece for each time that an object is up, in the view's plane."""
    rows = _directions(spark, sf_dir).where("el > 0").withColumn("island", F.expr("sample - row_number() over (partition by vec_id order by sample)"))
    point = F.format_string("%.2f %.2f", (90 - F.col("el")) / 90 * F.sin(F.radians("az")), (90 - F.col("el")) / 90 * F.cos(F.radians("az")))
    pieces = rows.groupBy("vec_id", "island").agg(F.min("sample").alias("first_sample"), F.count("*").alias("points"), F.array_sort(F.collect_list(F.struct("sample", point.alias("p")))).alias("x"))
    return pieces.select("vec_id", "first_sample", "points", F.array_join("x.p", ";").alias("track"))


@query("o11_closest_first", f"""WITH {_DIR}, u AS (SELECT vec_id, label, max(el) AS top, min(acos(greatest(-1, least(1, cos(radians(el)) * cos(radians(50)) * cos(radians(az - 120)) + sin(radians(el)) * sin(radians(50))))) * 180 / pi()) AS sep FROM dir GROUP BY 1, 2)
SELECT vec_id, tier, rank FROM (SELECT vec_id, tier, row_number() OVER (ORDER BY tier, round(sep, 6), vec_id)::INT AS rank FROM (SELECT *, CASE WHEN sep <= 25 THEN 0 WHEN top > 10 THEN 1 ELSE 2 END AS tier FROM u)) WHERE rank <= 100""")
def closest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    sep = sky.separation_degrees(F.col("az"), F.col("el"), F.lit(120.0), F.lit(50.0))
    rows = _directions(spark, sf_dir).groupBy("vec_id").agg(F.max("el").alias("top"), F.min(sep).alias("sep"))
    rows = rows.select("vec_id", F.expr("case when sep <= 25 then 0 when top > 10 then 1 else 2 end").alias("tier"), F.round("sep", 6).alias("sep"))
    # the report lists a hundred; the limit comes before the rank, so that ranking is over those only
    return rows.orderBy("tier", "sep", "vec_id").limit(100).selectExpr("vec_id", "tier", "row_number() over (order by tier, sep, vec_id) as rank")


@query("f11_element_checksum", """WITH l AS (SELECT p_partkey AS object, '1 ' || lpad(p_partkey::VARCHAR, 5, '0') || 'U 24001A   24' || lpad((p_size % 366)::VARCHAR, 3, '0') || '.12345678  .00001234  00000-0 -12345-3 0  999' AS line FROM part)
SELECT object, (list_sum(list_transform(string_split(substr(line, 1, 68), ''), lambda c: CASE WHEN c = '-' THEN 1 WHEN c >= '0' AND c <= '9' THEN c::INT ELSE 0 END)) % 10)::INT AS checksum FROM l""")
def element_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("concat('1 ', lpad(p_partkey, 5, '0'), 'U 24001A   24', lpad(p_size % 366, 3, '0'), '.12345678  .00001234  00000-0 -12345-3 0  999')")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object"), sky.element_checksum(line).alias("checksum"))
