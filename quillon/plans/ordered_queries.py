"""Ordered operators on observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import ordered
from quillon.plans.registry import query
from quillon.sources.tables import OBSERVATIONS_SQL, observations

HOUR = 3_600_000_000


@query("w01_best_per_time", f"WITH {OBSERVATIONS_SQL} SELECT path, t_us // {HOUR} AS hour, id, cents, k FROM (SELECT *, row_number() OVER (PARTITION BY path, t_us // {HOUR} ORDER BY cents DESC, abs(k), id) AS r FROM obs) WHERE r = 1")
def best_per_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("hour", F.expr(f"t_us div {HOUR}"))
    return ordered.best_per_time(rows, ["path", "hour"], F.desc("cents"), F.abs("k"), F.asc("id")).select("path", "hour", "id", "cents", "k")


@query("w02_gap_segments", f"""WITH {OBSERVATIONS_SQL}, g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER w > {6 * HOUR} THEN 1 ELSE 0 END AS new FROM obs WINDOW w AS (PARTITION BY path ORDER BY t_us, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY t_us, id)::BIGINT AS segment FROM g)
SELECT path, segment, count(*) AS n, min(t_us) AS first_us, max(t_us) AS last_us, sum(cents)::BIGINT AS cents FROM s GROUP BY 1, 2""")
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.gap_segments(observations(spark, sf_dir), ["path"], "t_us", 6 * HOUR, "id")
    return rows.groupBy("path", "segment").agg(F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.sum("cents").alias("cents"))


@query("w03_local_peaks", f"""WITH {OBSERVATIONS_SQL}, n AS (SELECT id, path, t_us, cents, coalesce(lag(cents) OVER w, -1e18) AS b, coalesce(lead(cents) OVER w, -1e18) AS a FROM obs WINDOW w AS (PARTITION BY path ORDER BY t_us))
SELECT id, path, t_us, cents FROM n WHERE cents >= b AND cents >= a AND (cents > b OR cents > a)""")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.local_peaks(observations(spark, sf_dir).select("id", "path", "t_us", "cents"), ["path"], "t_us", "cents")


@query("w04_threshold_intervals", f"""WITH {OBSERVATIONS_SQL}, n AS (
  SELECT path, t_us, cents, cents >= 5000 AS up, lag(t_us) OVER w AS t0, lag(cents) OVER w AS v0, lead(t_us) OVER w AS t1, lead(cents) OVER w AS v1, row_number() OVER w AS r FROM obs WINDOW w AS (PARTITION BY path ORDER BY t_us)
), u AS (SELECT *, r - row_number() OVER (PARTITION BY path ORDER BY t_us) AS g FROM n WHERE up),
e AS (SELECT path, g, arg_min(t_us, t_us) AS ft, arg_min(cents, t_us) AS fv, min_by(t0, t_us) AS t0, first(v0 ORDER BY t_us) AS v0, first(t0 ORDER BY t_us) AS ft0, max(t_us) AS lt, last(cents ORDER BY t_us) AS lv, last(v1 ORDER BY t_us) AS v1, last(t1 ORDER BY t_us) AS t1, count(*) AS points FROM u GROUP BY path, g)
SELECT path, round(CASE WHEN v0 IS NULL THEN ft::DOUBLE ELSE ft0 + (5000 - v0)::DOUBLE / (fv - v0) * (ft - ft0) END / 1e6, 3) AS start_s,
  round(CASE WHEN v1 IS NULL THEN lt::DOUBLE ELSE t1 + (5000 - v1)::DOUBLE / (lv - v1) * (lt - t1) END / 1e6, 3) AS end_s, v0 IS NULL AS start_clipped, v1 IS NULL AS end_clipped, points FROM e""")
def threshold_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordered.threshold_intervals(observations(spark, sf_dir).select("path", "t_us", "cents"), ["path"], "t_us", "cents", 5000)
    return found.select("path", F.round(F.col("start") / 1e6, 3).alias("start_s"), F.round(F.col("end") / 1e6, 3).alias("end_s"), "start_clipped", "end_clipped", "points")


@query("w06_hysteresis", f"""WITH {OBSERVATIONS_SQL}, q AS (SELECT path, t_us, CASE WHEN kind = 'click' THEN NULL ELSE cents // 1000 END AS queued FROM obs),
f AS (SELECT *, CASE WHEN queued IS NULL OR queued > 20 THEN TRUE WHEN queued < 10 THEN FALSE END AS forced FROM q)
SELECT path, t_us, queued, coalesce(last_value(forced IGNORE NULLS) OVER (PARTITION BY path ORDER BY t_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS suppressed FROM f""")
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("path", "t_us", F.expr("case when kind = 'click' then null else cents div 1000 end").alias("queued"))
    return ordered.hysteresis(rows, ["path"], "t_us", "queued", 20, 10)


@query("w05_phase_episodes", f"""WITH {OBSERVATIONS_SQL}, s AS (SELECT id, path, t_us, cents / 10000.0::DOUBLE AS phase FROM obs),
d AS (SELECT *, phase - lag(phase) OVER w - (t_us - lag(t_us) OVER w) * 2e-10 AS x, t_us - lag(t_us) OVER w AS dt FROM s WINDOW w AS (PARTITION BY path ORDER BY t_us)),
i AS (SELECT *, x + 0.5 - floor(x + 0.5) - 0.5 AS innovation FROM d)
SELECT id, path, round(innovation, 6) AS innovation, sum(CASE WHEN dt > {12 * HOUR} OR abs(innovation) > 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY t_us)::BIGINT AS episode FROM i""")
def phase_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("id", "path", "t_us", (F.col("cents") / F.lit(10000.0)).alias("phase"))
    found = ordered.phase_episodes(rows, ["path"], "t_us", "phase", F.lit(2e-10), 12 * HOUR, 0.1)
    return found.select("id", "path", F.round("innovation", 6).alias("innovation"), "episode")


@query("a09_longest_harm_run", f"""WITH {OBSERVATIONS_SQL}, n AS (SELECT path, t_us, cents < 3000 AS harm, row_number() OVER (PARTITION BY path ORDER BY t_us, id) AS r FROM obs),
g AS (SELECT path, r - row_number() OVER (PARTITION BY path ORDER BY r) AS g FROM n WHERE harm), c AS (SELECT path, g, count(*) AS run FROM g GROUP BY 1, 2)
SELECT p.path, coalesce(max(run), 0) AS longest_run FROM (SELECT DISTINCT path FROM obs) p LEFT JOIN c ON p.path = c.path GROUP BY 1""")
def longest_harm_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.longest_run(observations(spark, sf_dir), ["path"], ["t_us", "id"], F.col("cents") < 3000)


@query("w08_connected_spans", f"""WITH {OBSERVATIONS_SQL}, s AS (SELECT kind, id, t_us AS a, t_us + cents * 100000 AS b FROM obs),
m AS (SELECT *, max(b) OVER (PARTITION BY kind ORDER BY a, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN a - reach > 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY kind ORDER BY a, id)::BIGINT AS grp FROM m)
SELECT kind, grp AS "group", min(a) AS first_us, max(b) AS last_us, count(*) AS n FROM g GROUP BY 1, 2""")
def connected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = observations(spark, sf_dir).select("kind", "id", F.col("t_us").alias("a"), (F.col("t_us") + F.col("cents") * 100_000).alias("b"))
    found = ordered.connected_spans(spans, ["kind"], "a", "b", 60_000_000, "id")
    return found.groupBy("kind", "group").agg(F.min("a").alias("first_us"), F.max("b").alias("last_us"), F.count("*").alias("n"))


@query("w09_held_out_folds", f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY t_us, id) - 1 AS i, (t_us - min(t_us) OVER (PARTITION BY path)) // {24 * HOUR} AS b FROM obs)
SELECT path, (b % 5)::BIGINT AS fold, count(*) AS n, count(*) FILTER (i % 3 = 2) AS held_out, sum(cents)::BIGINT AS cents FROM r GROUP BY 1, 2""")
def held_out_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).selectExpr("*", "row_number() over (partition by path order by t_us, id) - 1 as i", f"(t_us - min(t_us) over (partition by path)) div {24 * HOUR} as b")
    return rows.groupBy("path", F.expr("pmod(b, 5)").alias("fold")).agg(F.count("*").alias("n"), F.count_if(F.expr("i % 3 = 2")).alias("held_out"), F.sum("cents").alias("cents"))


@query("w10_timing_estimates", f"""WITH {OBSERVATIONS_SQL} SELECT path, min(t_us) AS first_us, max(t_us) AS last_us, arg_min(id, struct_pack(t := t_us, i := id)) AS first_id, arg_max(id, struct_pack(t := t_us, i := id)) AS last_id,
CASE WHEN count(*) > 1 THEN round((max(t_us) - min(t_us))::DOUBLE / (count(*) - 1), 3) END AS period_us FROM obs GROUP BY 1""")
def timing_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("t_us", "id")
    period = F.when(F.count("*") > 1, F.round((F.max("t_us") - F.min("t_us")) / (F.count("*") - 1), 3))
    return observations(spark, sf_dir).groupBy("path").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.min_by("id", order).alias("first_id"), F.max_by("id", order).alias("last_id"), period.alias("period_us"))


@query("w11_counter_regressions", f"""WITH {OBSERVATIONS_SQL}, d AS (SELECT kind, k - lag(k) OVER (PARTITION BY kind ORDER BY t_us, id) AS step FROM obs)
SELECT kind, count(*) FILTER (step < 0) AS regressions, count(*) FILTER (step > 1) AS gaps, sum(CASE WHEN step > 1 THEN step - 1 ELSE 0 END)::BIGINT AS missing FROM d GROUP BY 1""")
def counter_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered.lagged(observations(spark, sf_dir).select("kind", "k", "t_us", "id"), ["kind"], ["t_us", "id"], "k", "before").selectExpr("kind", "k - before as step")
    return rows.groupBy("kind").agg(F.count_if(F.col("step") < 0).alias("regressions"), F.count_if(F.col("step") > 1).alias("gaps"), F.sum(F.expr("case when step > 1 then step - 1 else 0 end").cast("long")).alias("missing"))


@query("w12_ranked_prefix", f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT path, kind, id, cents, row_number() OVER (PARTITION BY path, kind ORDER BY cents DESC, id)::INT AS rank, count(*) OVER (PARTITION BY path, kind) AS source_count FROM obs)
SELECT *, greatest(source_count - 3, 0) AS truncated_count FROM r WHERE rank <= 3""")
def ranked_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("path", "kind", "id", "cents")
    return ordered.ranked_prefix(rows, ["path", "kind"], 3, F.desc("cents"), F.asc("id"))


@query("w13_tail_slope", f"""WITH {OBSERVATIONS_SQL}, t AS (SELECT *, max(t_us) OVER (PARTITION BY path) AS last FROM obs)
SELECT path, count(*) AS n, round(regr_slope(cents, (t_us - last) / 3.6e9), 4) AS slope FROM t WHERE t_us >= last - {120 * HOUR} GROUP BY 1 HAVING count(*) > 2""")
def tail_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).selectExpr("*", "max(t_us) over (partition by path) as last").where(f"t_us >= last - {120 * HOUR}")
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.round(F.expr("regr_slope(cents, (t_us - last) / 3.6e9D)"), 4).alias("slope")).where("n > 2")


@query("o08_decimate_even", f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT id, path, t_us, row_number() OVER (PARTITION BY path ORDER BY t_us, id) - 1 AS i, count(*) OVER (PARTITION BY path) AS n FROM obs)
SELECT id, path, t_us FROM r WHERE n <= 12 OR i IN (SELECT round_even(j * (r.n - 1) / 11.0::DOUBLE, 0) FROM range(12) AS s(j))""")
def decimate_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.decimate_even(observations(spark, sf_dir).select("id", "path", "t_us"), ["path"], ["t_us", "id"], 12)


@query("o09_decimate_extrema", f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT id, path, cents, row_number() OVER (PARTITION BY path ORDER BY t_us, id) - 1 AS i, count(*) OVER (PARTITION BY path) AS n FROM obs),
b AS (SELECT *, (i * 8 // n)::INT AS bucket FROM r)
SELECT id, path, cents, bucket FROM b SEMI JOIN (SELECT path, bucket, unnest([min(i), max(i), arg_min(i, struct_pack(c := cents, i := i)), arg_min(i, struct_pack(c := -cents, i := i))]) AS i FROM b GROUP BY 1, 2) m USING (path, bucket, i)""")
def decimate_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.decimate_extrema(observations(spark, sf_dir).select("id", "path", "t_us", "cents"), ["path"], ["t_us", "id"], "cents", 8).select("id", "path", "cents", "bucket")


@query("t03_session_windows", f"""WITH {OBSERVATIONS_SQL}, g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY path ORDER BY t_us, id) < {4 * HOUR} THEN 0 ELSE 1 END AS new FROM obs),
s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY t_us, id) AS s FROM g)
SELECT path, min(t_us) AS start_us, max(t_us) + {4 * HOUR} AS end_us, count(*) AS n FROM s GROUP BY path, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("ts", F.timestamp_micros("t_us"))
    found = rows.groupBy("path", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    return found.select("path", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")
