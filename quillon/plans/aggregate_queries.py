"""Aggregate operators on observations, sample vectors and labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.rounding import rounded
from quillon.operators import aggregates as agg
from quillon.operators import kernels
from quillon.plans.registry import query
from quillon.sources.tables import OBSERVATIONS_SQL, SAMPLES_SQL, observations, sample_arrays, samples, table

HOUR = 3_600_000_000


@query("a01_window_power_summary", f"""WITH {OBSERVATIONS_SQL}, w AS (SELECT path, t_us // {HOUR} AS win, count(*) AS n, sum(cents * cents)::BIGINT AS energy, max(t_us) - min(t_us) AS spread FROM obs GROUP BY 1, 2),
g AS (SELECT path, unnest(range(a, b + 1)) AS win FROM (SELECT path, min(t_us // {HOUR}) AS a, max(t_us // {HOUR}) AS b FROM obs GROUP BY 1))
SELECT g.path, g.win AS "window", coalesce(n, 0) AS n, energy, round(energy / (n * 1073741824.0::DOUBLE), 12) AS mean_power, round(10 * log10(energy / (n * 1073741824.0::DOUBLE)), 6) AS power_db,
count(*) FILTER (n IS NULL) OVER (PARTITION BY g.path) AS uncovered FROM g LEFT JOIN w ON w.path = g.path AND w.win = g.win""")
def window_power_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of each hour of each path, hours without observations as rows without power, with the path's uncovered hours."""
    rows = observations(spark, sf_dir)
    sums = rows.groupBy("path", F.expr(f"t_us div {HOUR}").alias("window")).agg(F.count("*").alias("n"), F.sum(F.col("cents") * F.col("cents")).alias("energy"))
    whole = agg.dense_windows(rows, "path", "t_us", HOUR).join(sums, ["path", "window"], "left")
    found = agg.power(F.col("energy"), F.col("n"))
    # an hour whose observations are all zero has power, though none in decibels
    found["power_db"] = F.when(F.col("energy") == 0, F.lit(float("-inf"))).otherwise(found["power_db"])
    whole = whole.select("path", "window", F.coalesce("n", F.lit(0)).alias("n"), "energy", rounded(found["mean_power"], 12).alias("mean_power"), rounded(found["power_db"], 6).alias("power_db"), F.col("n").isNull().alias("empty"))
    return whole.selectExpr("path", "window", "n", "energy", "mean_power", "power_db", "count_if(empty) over (partition by path) as uncovered")


@query("a01_quality_summary", f"""WITH {SAMPLES_SQL} SELECT label, count(*) AS samples, count(*) FILTER (abs(i) >= 12000) + count(*) FILTER (abs(q) >= 12000) AS clipped_components, count(*) FILTER (abs(i) >= 12000 OR abs(q) >= 12000) AS clipped_samples,
min(i) AS min_i, max(i) AS max_i, min(q) AS min_q, max(q) AS max_q, min(i) = max(i) AND min(q) = max(q) AS constant FROM smp GROUP BY 1""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted within each vector's row first, so a row for each vector is all that is grouped."""
    far = lambda c: F.transform(c, lambda x: (F.abs(x) >= 12_000).cast("long"))
    either = F.zip_with(far("i"), far("q"), lambda a, b: F.greatest(a, b))
    rows = sample_arrays(spark, sf_dir).select(
        "label", F.size("i").alias("n"), (kernels.total(far("i"), "bigint") + kernels.total(far("q"), "bigint")).alias("components"), kernels.total(either, "bigint").alias("clipped"),
        *[f(c).alias(f"{name}_{c}") for c in ("i", "q") for name, f in (("min", F.array_min), ("max", F.array_max))],
    )
    ends = [g(f"{name}_{c}").alias(f"{name}_{c}") for c in ("i", "q") for name, g in (("min", F.min), ("max", F.max))]
    found = rows.groupBy("label").agg(F.sum("n").alias("samples"), F.sum("components").alias("clipped_components"), F.sum("clipped").alias("clipped_samples"), *ends)
    return found.withColumn("constant", F.expr("min_i = max_i and min_q = max_q"))


@query("a02_coverage", f"""WITH {OBSERVATIONS_SQL}, b AS (SELECT path, t_us AS a, t_us + {2 * HOUR} AS e FROM obs), r AS (SELECT *, max(e) OVER (PARTITION BY path ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b)
SELECT path, sum(e - greatest(a, coalesce(reach, a)))::BIGINT AS observed, count(*) FILTER (a > reach) + CASE WHEN max(e) < 1706745600000000 THEN 1 ELSE 0 END AS uncovered_regions, round(sum(e - greatest(a, coalesce(reach, a)))::DOUBLE / 2678400000000, 6) AS coverage FROM r WHERE e > coalesce(reach, 0) GROUP BY 1""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = observations(spark, sf_dir).selectExpr("path", "t_us as a", f"t_us + {2 * HOUR} as e").selectExpr("*", "max(e) over (partition by path order by a rows between unbounded preceding and 1 preceding) as reach")
    own = F.sum(F.col("e") - F.greatest("a", F.coalesce("reach", "a")))
    tail = F.when(F.max("e") < 1_706_745_600_000_000, 1).otherwise(0)
    return blocks.where("e > coalesce(reach, 0)").groupBy("path").agg(own.alias("observed"), (F.count_if(F.col("a") > F.col("reach")) + tail).alias("uncovered_regions"), F.round(own / F.lit(2_678_400_000_000.0), 6).alias("coverage"))


@query("a03_power_summary", f"""WITH {SAMPLES_SQL}, s AS (SELECT vec_id, count(*) AS n, sum(i * i + q * q)::BIGINT AS energy FROM smp GROUP BY 1)
SELECT vec_id, n, energy, round(energy / (n * 1073741824.0::DOUBLE), 12) AS mean_power, round(10 * log10(energy / (n * 1073741824.0::DOUBLE)), 6) AS power_db, round(sqrt(energy / (n * 1073741824.0::DOUBLE)), 9) AS rms FROM s""")
def power_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = sample_arrays(spark, sf_dir).select("vec_id", F.size("i").cast("long").alias("n"), kernels.total(kernels.energy(F.col("i"), F.col("q")), "bigint").alias("energy"))
    found = agg.power(F.col("energy"), F.col("n"))
    return sums.select("vec_id", "n", "energy", F.round(found["mean_power"], 12).alias("mean_power"), F.round(found["power_db"], 6).alias("power_db"), F.round(found["rms"], 9).alias("rms"))


@query("a08_replay_blocks_tiers", f"""WITH {OBSERVATIONS_SQL}, b AS (SELECT path, t_us // {24 * HOUR} AS block, median(cents - 5000) AS delta, median(cents - 40 * k) AS margin, count(*) AS n FROM obs GROUP BY 1, 2),
p AS (SELECT path, count(*) AS blocks, median(delta) AS delta, median(margin) AS margin, count(*) FILTER (delta < -3000) AS harmful, quantile_disc(delta, 0.1) AS q10 FROM b GROUP BY 1)
SELECT path, blocks, delta, margin, harmful, q10, CASE WHEN blocks < 3 THEN 'geometry_only' WHEN margin < 2000 THEN 'geometry_only' WHEN harmful > 0.25 * blocks THEN 'rejected' WHEN delta >= 300 THEN 'improved' WHEN delta >= -1500 THEN 'stable' ELSE 'rejected' END AS tier FROM p""")
def replay_blocks_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    blocks = rows.groupBy("path", F.expr(f"t_us div {24 * HOUR}").alias("block")).agg(F.median(F.col("cents") - 5000).alias("delta"), F.median(F.col("cents") - 40 * F.col("k")).alias("margin"))
    paths = blocks.groupBy("path").agg(F.count("*").alias("blocks"), F.median("delta").alias("delta"), F.median("margin").alias("margin"), F.count_if(F.col("delta") < -3000).alias("harmful"), F.expr("percentile_disc(0.1) within group (order by delta)").alias("q10"))
    tier = F.expr("case when blocks < 3 then 'geometry_only' when margin < 2000 then 'geometry_only' when harmful > 0.25 * blocks then 'rejected' when delta >= 300 then 'improved' when delta >= -1500 then 'stable' else 'rejected' end")
    return paths.withColumn("tier", tier)


@query("a10_quantile_higher", f"WITH {OBSERVATIONS_SQL}, r AS (SELECT kind, abs(k) AS v, row_number() OVER (PARTITION BY kind ORDER BY abs(k)) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM obs) SELECT kind, v AS quantile, n FROM r WHERE i = ceil((n - 1) * 0.95::DOUBLE)")
def quantile_higher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.quantile_higher(observations(spark, sf_dir).select("kind", F.abs("k").alias("v")), ["kind"], "v", 0.95)


@query("a13_transition_counts", f"""WITH {OBSERVATIONS_SQL}, f AS (SELECT path, cents >= 5000 AS b, lead(cents >= 5000) OVER (PARTITION BY path ORDER BY t_us, id) AS a FROM obs)
SELECT path, count(*) FILTER (b AND a) AS kept, count(*) FILTER (b AND NOT a) AS lost, count(*) FILTER (NOT b AND a) AS gained, count(*) FILTER (NOT b AND NOT a) AS absent FROM f WHERE a IS NOT NULL GROUP BY 1""")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).selectExpr("path", "cents >= 5000 as b", "lead(cents >= 5000) over (partition by path order by t_us, id) as a").where("a is not null")
    return agg.transitions(rows, ["path"], F.col("b"), F.col("a"))


@query("a14_wilson_bounds", """WITH g AS (SELECT lang, source, count(*) AS trials, sum(quality)::BIGINT AS successes FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT lang, source, trials, successes, round(greatest(0.0, (successes / trials + 2.7055434540954142 / (2 * trials) - 1.6448536269514722 * sqrt(successes / trials * (1 - successes / trials) / trials + 2.7055434540954142 / (4 * trials * trials))) / (1 + 2.7055434540954142 / trials)), 6) AS lower,
CASE WHEN trials < 3 THEN 'insufficient' WHEN successes >= 0.9::DOUBLE * trials THEN 'accepted' ELSE 'rejected' END AS status FROM (SELECT lang, source, trials::DOUBLE AS trials, successes::DOUBLE AS successes FROM g)""")
def wilson_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    groups = rows.groupBy("lang", "source").agg(F.count("*").cast("double").alias("trials"), F.sum("quality").cast("double").alias("successes"))
    status = F.expr("case when trials < 3 then 'insufficient' when successes >= 0.9D * trials then 'accepted' else 'rejected' end")
    return groups.select("lang", "source", "trials", "successes", F.round(agg.wilson_lower(F.col("successes"), F.col("trials")), 6).alias("lower"), status.alias("status"))


@query("a15_exact_bounds")
def exact_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    groups = rows.groupBy("lang").agg(F.count("*").alias("trials"), F.sum("quality").alias("successes"))
    return groups.withColumn("lower", F.round(agg.exact_lower("successes", "trials"), 9))


_Z = 1.6448536269514722
_T = " + ".join(f"{x!r}::DOUBLE / (n - 1) ** {k}" for k, x in enumerate([(_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384, (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160], 1))


@query("a16_paired_t", f"""WITH {OBSERVATIONS_SQL}, p AS (SELECT path, avg(cents) FILTER (kind = 'view') - avg(cents) FILTER (kind = 'click') AS d FROM obs GROUP BY 1), s AS (SELECT count(d) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM p)
SELECT n, round(m, 4) AS mean, CASE WHEN n > 1 THEN round(m - ({_Z!r}::DOUBLE + {_T}) * sd / sqrt(n), 4) END AS lower FROM s""")
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided lower bound of the mean difference of pairs, by Student's t."""
    pairs = observations(spark, sf_dir).groupBy("path").agg((F.avg(F.expr("case when kind = 'view' then cents end")) - F.avg(F.expr("case when kind = 'click' then cents end"))).alias("d"))
    sums = pairs.agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"))
    t = agg.t_quantile(agg.Z_95, F.col("n") - 1)
    return sums.select("n", F.round("m", 4).alias("mean"), F.round(F.col("m") - t * F.col("sd") / F.sqrt("n"), 4).alias("lower"))


@query("a19_calibration_stats", f"""WITH {OBSERVATIONS_SQL}, m AS (SELECT path, median(cents) AS median, count(*) AS n FROM obs GROUP BY 1), d AS (SELECT o.path, median(abs(o.cents - m.median)) AS mad, max(abs(o.cents - m.median)) AS radius FROM obs o JOIN m ON m.path = o.path GROUP BY 1),
g AS (SELECT path, max(gap) AS widest FROM (SELECT path, cents - lag(cents) OVER (PARTITION BY path ORDER BY cents, id) AS gap FROM obs) GROUP BY 1)
SELECT m.path, n, m.median, mad, round(1.4826 * mad, 4) AS sigma, radius, widest, concat_ws(',', CASE WHEN n < 50 THEN 'few' END, CASE WHEN 1.4826 * mad > 4500 THEN 'spread' END, CASE WHEN widest > 4000 THEN 'gap' END) AS reasons FROM m JOIN d ON d.path = m.path JOIN g ON g.path = m.path""")
def calibration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    located = agg.median_by(rows, ["path"], "cents")
    radius = rows.join(located.select("path", "median"), "path").groupBy("path").agg(F.max(F.abs(F.col("cents") - F.col("median"))).alias("radius"))
    widest = rows.selectExpr("path", "cents - lag(cents) over (partition by path order by cents, id) as gap").groupBy("path").agg(F.max("gap").alias("widest"))
    reasons = F.expr("concat_ws(',', if(n < 50, 'few', null), if(1.4826D * mad > 4500, 'spread', null), if(widest > 4000, 'gap', null))")
    whole = located.join(radius, "path").join(widest, "path")
    return whole.select("path", "n", "median", "mad", F.round(1.4826 * F.col("mad"), 4).alias("sigma"), "radius", "widest", reasons.alias("reasons"))


@query("a21_soak_summary", f"""WITH {OBSERVATIONS_SQL} SELECT kind, count(*) AS trials, count(DISTINCT path) AS runs, sum(cents)::BIGINT AS active, min(t_us) AS first_us, max(t_us) AS last_us, arg_max(id, struct_pack(t := t_us, i := id)) AS last_id, round(sum(cents)::DOUBLE / ((max(t_us) - min(t_us)) / 1e4), 8) AS duty FROM obs GROUP BY 1""")
def soak_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    duty = F.round(F.sum("cents") / ((F.max("t_us") - F.min("t_us")) / 1e4), 8)
    return observations(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("trials"), F.count_distinct("path").alias("runs"), F.sum("cents").alias("active"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.max_by("id", F.struct("t_us", "id")).alias("last_id"), duty.alias("duty"))


@query("a22_policy_violations", f"""WITH {OBSERVATIONS_SQL}, s AS (SELECT path, count(*) AS n, max(cents) AS peak, min(k) AS low FROM obs GROUP BY 1)
SELECT path, unnest(list_filter([CASE WHEN n < 60 THEN 'too_few' END, CASE WHEN peak > 30000 THEN 'peak' END, CASE WHEN low < 1 THEN 'control' END], lambda x: x IS NOT NULL)) AS violation FROM s""")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = observations(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"), F.max("cents").alias("peak"), F.min("k").alias("low"))
    found = F.expr("filter(array(if(n < 60, 'too_few', null), if(peak > 30000, 'peak', null), if(low < 1, 'control', null)), x -> x is not null)")
    return sums.select("path", F.explode(found).alias("violation"))


@query("a25_equivalence_band", f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT kind, abs(cents - 5000) AS v, row_number() OVER (PARTITION BY kind ORDER BY abs(cents - 5000)) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM obs),
q AS (SELECT kind, v FROM r WHERE i = ceil((n - 1) * 0.95::DOUBLE)) SELECT count(*) AS "groups", count(*) = 5 AS complete, (max(v) * 2)::BIGINT AS band FROM q""")
def equivalence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("kind", F.abs(F.col("cents") - 5000).alias("v"))
    return agg.quantile_higher(rows, ["kind"], "v", 0.95).agg(F.count("*").alias("groups"), (F.count("*") == 5).alias("complete"), (F.max("quantile") * 2).alias("band"))


@query("a26_circular_reference", f"""WITH {OBSERVATIONS_SQL}, s AS (SELECT path, sum(k) AS w, sum(k * cos(2 * pi() * (cents % 2273) / 2273)) AS c, sum(k * sin(2 * pi() * (cents % 2273) / 2273)) AS s FROM obs WHERE k > 0 GROUP BY 1)
SELECT path, w::BIGINT AS weight, round(atan2(s, c), 6) AS reference, round(sqrt(c * c + s * s) / w, 6) AS concentration FROM s""")
def circular_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = F.expr("2 * pi() * (cents % 2273) / 2273")
    sums = observations(spark, sf_dir).where("k > 0").groupBy("path").agg(F.sum("k").alias("weight"), F.sum(F.col("k") * F.cos(angle)).alias("c"), F.sum(F.col("k") * F.sin(angle)).alias("s"))
    return sums.select("path", "weight", F.round(F.atan2("s", "c"), 6).alias("reference"), F.round(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("weight"), 6).alias("concentration"))


@query("a27_status_rollup", f"""WITH {OBSERVATIONS_SQL}, s AS (SELECT path, max(CASE kind WHEN 'error' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END) AS r FROM obs WHERE cents > 12000 GROUP BY 1)
SELECT path, CASE r WHEN 4 THEN 'insufficient_data' WHEN 3 THEN 'partial_coverage' WHEN 2 THEN 'no_result' ELSE 'complete' END AS status FROM s""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["complete", "no_result", "partial_coverage", "insufficient_data"]
    rank = F.coalesce(agg.rank_by_class({"error": 3, "click": 2, "view": 1}, "kind"), F.lit(0))
    return observations(spark, sf_dir).where("cents > 12000").groupBy("path").agg(F.max(rank).alias("r")).select("path", F.element_at(F.array(*map(F.lit, names)), F.col("r") + 1).alias("status"))


@query("a29_receiver_combine", f"""WITH {SAMPLES_SQL}, p AS (SELECT label, vec_id, sum(i)::BIGINT AS x, (sum(i * i + q * q) // 32)::BIGINT AS noise FROM smp GROUP BY 1, 2)
SELECT label, count(*) AS receivers, round(sum(x::DOUBLE / noise) / sum(1.0::DOUBLE / noise), 3) AS combined FROM p WHERE noise > 0 GROUP BY 1""")
def receiver_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = samples(spark, sf_dir).groupBy("label", "vec_id").agg(F.sum("i").alias("x"), F.expr("sum(i * i + q * q) div 32").alias("noise")).where("noise > 0")
    return parts.groupBy("label").agg(F.count("*").alias("receivers"), F.round(F.sum(F.col("x") / F.col("noise")) / F.sum(1 / F.col("noise")), 3).alias("combined"))


@query("a32_radio_pair_reduce", f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT path, kind, count(*) AS n, max(cents) AS peak FROM obs GROUP BY 1, 2)
SELECT a.path, a.peak AS view_peak, b.peak AS click_peak, least(a.n, b.n) AS common, a.peak - b.peak AS difference FROM r a JOIN r b ON a.path = b.path AND a.kind = 'view' AND b.kind = 'click'""")
def radio_pair_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = lambda kind, x: F.expr(f"case when kind = '{kind}' then {x} end")
    sums = observations(spark, sf_dir).groupBy("path").agg(F.max(when("view", "cents")).alias("view_peak"), F.max(when("click", "cents")).alias("click_peak"), F.count(when("view", "1")).alias("v"), F.count(when("click", "1")).alias("c"))
    return sums.where("v > 0 and c > 0").select("path", "view_peak", "click_peak", F.least("v", "c").alias("common"), (F.col("view_peak") - F.col("click_peak")).alias("difference"))


@query("t02_probe_windows", f"""WITH {OBSERVATIONS_SQL} SELECT kind, (t_us // {HOUR} - d) * {HOUR} AS start_us, count(*) AS n, sum(cents)::BIGINT AS cents FROM obs, range(4) AS r(d) GROUP BY 1, 2""")
def probe_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("ts", F.timestamp_micros("t_us")).groupBy("kind", F.window("ts", "4 hours", "1 hour").alias("w"))
    return rows.agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).select("kind", F.unix_micros("w.start").alias("start_us"), "n", "cents")
