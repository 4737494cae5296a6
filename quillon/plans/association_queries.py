"""Associations and classifications composed of the operators: derivative matches, epochs, reconstructed paths, lift tiers, phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import intervals
from quillon.plans.interval_queries import _DAYS, DAY, _days
from quillon.plans.registry import query
from quillon.sources.tables import OBSERVATIONS_SQL, SAMPLES_SQL, observations, samples, table

HOUR = 3_600_000_000


@query("j12_derivative_candidates", f"""WITH {OBSERVATIONS_SQL}, {_DAYS}, s AS (SELECT path, track, day, a, b, (fb - fa)::DOUBLE / (b - a) * 3.6e9 AS slope FROM days)
SELECT x.track AS left_track, y.track AS right_track, round(abs(x.slope - y.slope), 4) AS score FROM s x JOIN s y ON x.day = y.day AND x.path // 10 = y.path // 10 AND x.path < y.path AND x.a < y.b AND y.a < x.b AND abs(x.slope - y.slope) <= 400""")
def derivative_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = _days(spark, sf_dir).selectExpr("path div 10 as scope", "day", "path", "track", "a", "b", "cast(fb - fa as double) / (b - a) * 3.6e9D as slope")
    side = lambda s: tracks.select("scope", "day", *[F.col(c).alias(f"{s}{c}") for c in ("path", "track", "a", "b", "slope")])
    pairs = intervals.overlap_join(side("x"), side("y"), ["scope", "day"], ("xa", "xb"), ("ya", "yb"), DAY).where("xpath < ypath and abs(xslope - yslope) <= 400")
    return pairs.selectExpr("xtrack as left_track", "ytrack as right_track", "round(abs(xslope - yslope), 4) as score")


@query("j21_element_age", f"""WITH {OBSERVATIONS_SQL}, e AS (SELECT kind, max(t_us) AS epoch FROM obs WHERE t_us < 1706000000000000 GROUP BY 1) SELECT id, o.kind, (t_us - epoch) // 1000000 AS age_s FROM obs o JOIN e ON e.kind = o.kind WHERE t_us >= epoch""")
def element_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    epochs = rows.where("t_us < 1706000000000000").groupBy("kind").agg(F.max("t_us").alias("epoch"))
    return rows.join(epochs, "kind").where("t_us >= epoch").selectExpr("id", "kind", "(t_us - epoch) div 1000000 as age_s")


@query("u06_path_reconstruction", f"""WITH {OBSERVATIONS_SQL}, n AS (SELECT id, path, t_us, cents, CASE WHEN abs(cents - lag(cents) OVER w) <= 3000 AND t_us - lag(t_us) OVER w <= {8 * HOUR} THEN 0 ELSE 1 END AS head FROM obs WINDOW w AS (PARTITION BY path ORDER BY t_us, id)),
b AS (SELECT *, sum(head) OVER (PARTITION BY path ORDER BY t_us, id) AS branch FROM n) SELECT path, branch::BIGINT AS branch, count(*) AS members, min_by(id, t_us) AS head_id, string_agg(id, ',' ORDER BY t_us, id) AS ids FROM b GROUP BY 1, 2 HAVING count(*) > 2""")
def path_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen edges join each observation with the one before; a branch is what hangs together, in order."""
    w = "over (partition by path order by t_us, id)"
    rows = observations(spark, sf_dir).selectExpr("id", "path", "t_us", f"if(abs(cents - lag(cents) {w}) <= 3000 and t_us - lag(t_us) {w} <= {8 * HOUR}, 0L, 1L) as head").selectExpr("id", "path", "t_us", f"sum(head) {w} as branch")
    found = rows.groupBy("path", "branch").agg(F.count("*").alias("members"), F.array_sort(F.collect_list(F.struct("t_us", "id"))).alias("x")).where("members > 2")
    return found.selectExpr("path", "branch", "members", "x[0].id as head_id", "array_join(transform(x, y -> cast(y.id as string)), ',') as ids")


@query("a12_lift_classification", f"""WITH {OBSERVATIONS_SQL}, r AS (SELECT path, t_us // {DAY} AS block, cents - 5000 AS delta, cents - 50 * k AS margin FROM obs), b AS (SELECT path, block, median(delta) AS delta, median(margin) AS margin FROM r GROUP BY 1, 2),
h AS (SELECT path, block, delta < -2000 AS harm, block - row_number() OVER (PARTITION BY path, delta < -2000 ORDER BY block) AS island FROM b), l AS (SELECT path, max(c) AS run FROM (SELECT path, island, count(*) AS c FROM h WHERE harm GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT path, count(*) AS evaluated, max(block) - min(block) + 1 AS eligible, median(delta) AS delta, median(margin) AS margin, count(*) FILTER (delta < -2000) AS harmful FROM b GROUP BY 1)
SELECT p.path, evaluated, eligible, round(least(1.0, evaluated / eligible), 6) AS coverage, coalesce(run, 0) AS harm_run, CASE WHEN evaluated < 3 OR evaluated < 0.5 * eligible THEN 'geometry_only' WHEN margin < 500 THEN 'geometry_only' WHEN harmful > 0.25 * evaluated AND coalesce(run, 0) > 2 THEN 'rejected' WHEN delta >= 500 THEN 'improved' WHEN delta >= -500 THEN 'stable' ELSE 'rejected' END AS tier FROM p LEFT JOIN l ON l.path = p.path""")
def lift_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).selectExpr("path", f"t_us div {DAY} as block", "cents - 5000 as delta", "cents - 50 * k as margin")
    blocks = rows.groupBy("path", "block").agg(F.median("delta").alias("delta"), F.median("margin").alias("margin"))
    # runs are of consecutive days, so days without observations end them
    runs = blocks.where("delta < -2000").selectExpr("path", "block - row_number() over (partition by path order by block) as island").groupBy("path", "island").agg(F.count("*").alias("c")).groupBy("path").agg(F.max("c").alias("run"))
    paths = blocks.groupBy("path").agg(F.count("*").alias("evaluated"), F.expr("max(block) - min(block) + 1").alias("eligible"), F.median("delta").alias("delta"), F.median("margin").alias("margin"), F.count_if(F.col("delta") < -2000).alias("harmful"))
    tier = F.expr("case when evaluated < 3 or evaluated < 0.5 * eligible then 'geometry_only' when margin < 500 then 'geometry_only' when harmful > 0.25 * evaluated and harm_run > 2 then 'rejected' when delta >= 500 then 'improved' when delta >= -500 then 'stable' else 'rejected' end")
    whole = paths.join(runs, "path", "left").withColumn("harm_run", F.coalesce("run", F.lit(0)))
    return whole.select("path", "evaluated", "eligible", F.round(F.least(F.lit(1.0), F.col("evaluated") / F.col("eligible")), 6).alias("coverage"), "harm_run", tier.alias("tier"))


@query("d19_locked_integration", f"""WITH {SAMPLES_SQL}, f AS (SELECT vec_id, n // 8 AS frame, sum(i)::DOUBLE AS x, sum(q)::DOUBLE AS y, sum((i * i + q * q)::DOUBLE) AS e FROM smp GROUP BY 1, 2), r AS (SELECT vec_id, x AS rx, y AS ry FROM f WHERE frame = 0),
a AS (SELECT f.vec_id, (x * rx + y * ry) / sqrt(rx * rx + ry * ry) AS p, sqrt(x * x + y * y) AS m, e FROM f JOIN r ON r.vec_id = f.vec_id WHERE rx * rx + ry * ry > 0)
SELECT vec_id, round(avg(p), 3) AS coherent, round(avg(m), 3) AS incoherent, round(sum(p) * sum(p) / (4 * sum(m * m)), 6) AS coherence FROM a GROUP BY 1""")
def locked_integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames turned by the phase of the first and added: what is left of their lengths is coherence."""
    frames = samples(spark, sf_dir).groupBy("vec_id", F.expr("n div 8").alias("frame")).agg(F.sum("i").cast("double").alias("x"), F.sum("q").cast("double").alias("y"))
    first = frames.where("frame = 0 and x * x + y * y > 0").selectExpr("vec_id", "x as rx", "y as ry")
    turned = frames.join(first, "vec_id").selectExpr("vec_id", "(x * rx + y * ry) / sqrt(rx * rx + ry * ry) as p", "sqrt(x * x + y * y) as m")
    return turned.groupBy("vec_id").agg(F.round(F.avg("p"), 3).alias("coherent"), F.round(F.avg("m"), 3).alias("incoherent"), F.round(F.sum("p") * F.sum("p") / (4 * F.sum(F.col("m") * F.col("m"))), 6).alias("coherence"))


@query("d22_phase_increment", f"""WITH {SAMPLES_SQL}, f AS (SELECT vec_id, n // 4 AS frame, atan2(sum(q)::DOUBLE, sum(i)::DOUBLE) / (2 * pi()) AS phase, (n // 4) % 3 = 2 AS held FROM smp GROUP BY 1, 2, 4),
d AS (SELECT vec_id, frame, held, phase - lag(phase) OVER (PARTITION BY vec_id ORDER BY frame) AS x FROM f), w AS (SELECT vec_id, held, x + 0.5 - floor(x + 0.5) - 0.5 AS step FROM d WHERE x IS NOT NULL),
m AS (SELECT vec_id, median(step) AS increment FROM w WHERE NOT held GROUP BY 1) SELECT w.vec_id, round(increment, 6) AS increment, round(median(abs(step - increment)) FILTER (held), 6) AS held_out_error FROM w JOIN m ON m.vec_id = w.vec_id GROUP BY 1, increment""")
def phase_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step of phase from frame to frame, fitted on two frames of three and held against the third."""
    frames = samples(spark, sf_dir).groupBy("vec_id", F.expr("n div 4").alias("frame")).agg(F.expr("atan2(cast(sum(q) as double), cast(sum(i) as double)) / (2 * pi())").alias("phase"))
    steps = frames.selectExpr("vec_id", "frame % 3 = 2 as held", "phase - lag(phase) over (partition by vec_id order by frame) as x").where("x is not null").selectExpr("vec_id", "held", "pmod(x + 0.5D, 1D) - 0.5D as step")
    fitted = steps.where("not held").groupBy("vec_id").agg(F.median("step").alias("increment"))
    return steps.join(fitted, "vec_id").groupBy("vec_id", "increment").agg(F.expr("median(case when held then abs(step - increment) end)").alias("e")).select("vec_id", F.round("increment", 6).alias("increment"), F.round("e", 6).alias("held_out_error"))


@query("g08_sampling_grid", "SELECT s_suppkey AS object, i::INT AS knot, round(10.0 * i / (s_suppkey % 5 + 2), 6)::DOUBLE AS offset_s, round(1.5 * 10.0 / (s_suppkey % 5 + 2) / 2, 6)::DOUBLE AS margin_deg FROM supplier, range(7) AS r(i) WHERE i <= s_suppkey % 5 + 2")
def sampling_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as object", "s_suppkey % 5 + 2 as n").selectExpr("object", "n", "explode(sequence(0, int(n))) as knot")
    return rows.selectExpr("object", "knot", "round(10D * knot / n, 6) as offset_s", "round(1.5D * 10D / n / 2, 6) as margin_deg")
