"""Schedules, projections, predicates, scalar functions and further lifecycle operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import catalog
from quillon.plans.catalog_queries import _JOBS, _S, _jobs, _products, _sessions
from quillon.plans.registry import query
from quillon.sources.shared import ensure_checkpoint_dir
from quillon.sources.tables import OBSERVATIONS_SQL, observations, table

HOUR = 3_600_000_000


@query("s02_block_iteration", f"""WITH {_S}, r AS (SELECT DISTINCT radio, shipped, (sum(quantity) OVER (PARTITION BY radio, shipped))::BIGINT AS length FROM prd), b AS (SELECT radio, shipped, length, unnest(range(0, length, 16)) AS start FROM r)
SELECT radio, shipped, start::BIGINT AS start, least(16, length - start)::BIGINT AS count FROM b""")
def block_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    refills = _products(spark, sf_dir).groupBy("radio", "shipped").agg(F.sum("quantity").alias("length"))
    return refills.selectExpr("radio", "shipped", "length", "explode(sequence(0L, length - 1, 16L)) as start").selectExpr("radio", "shipped", "start", "least(16L, length - start) as count")


@query("s04_block_geometry", f"""WITH {OBSERVATIONS_SQL}, b AS (SELECT path, id, t_us, k, t_us - lag(t_us) OVER w AS step, k <> lag(k) OVER w AS moved FROM obs WINDOW w AS (PARTITION BY path ORDER BY id))
SELECT path, id, CASE WHEN step <= 0 THEN 'order' WHEN step > {200 * HOUR} THEN 'range' ELSE 'receiver' END AS violation FROM b WHERE step <= 0 OR step > {200 * HOUR} OR (moved AND k = 7)""")
def block_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = "over (partition by path order by id)"
    rows = observations(spark, sf_dir).selectExpr("path", "id", "k", f"t_us - lag(t_us) {w} as step", f"k <> lag(k) {w} as moved")
    wrong = rows.where(f"step <= 0 or step > {200 * HOUR} or (moved and k = 7)")
    return wrong.selectExpr("path", "id", f"case when step <= 0 then 'order' when step > {200 * HOUR} then 'range' else 'receiver' end as violation")


@query("p03_even_windows", f"WITH {_S} SELECT session, i::INT AS place, (i * greatest(bytes // 100 - 50, 0) // 7)::BIGINT AS start FROM ses, range(8) AS r(i) WHERE bytes // 100 > 50 OR i = 0")
def even_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).selectExpr("session", "bytes", "explode(if(bytes div 100 > 50, sequence(0, 7), array(0))) as place").selectExpr("session", "place", "place * greatest(bytes div 100 - 50, 0L) div 7 as start")


@query("p05_topological_levels", """WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS node, conv_id * 1000 + turn - 1 AS parent FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)),
l AS (SELECT conv_id * 1000 + turn AS node, 0 AS level FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1) UNION ALL SELECT e.node, l.level + 1 FROM l JOIN e ON e.parent = l.node)
SELECT node, max(level)::INT AS level FROM l GROUP BY 1""")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each node: its longest way from a root.  A conversation is a chain, so that is its place since the last break."""
    nodes = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn").distinct()
    rows = nodes.selectExpr("conv_id", "turn", "turn - row_number() over (partition by conv_id order by turn) as run")
    return rows.selectExpr("conv_id * 1000 + turn as node", "int(row_number() over (partition by conv_id, run order by turn) - 1) as level")


@query("p12_tuning_draw", f"WITH {_S}, h AS (SELECT session, ('0x' || substr(sha256('draw/' || session), 1, 15))::BIGINT % 100 AS b FROM ses) SELECT session, b AS bucket, CASE WHEN b < 50 THEN 'same' WHEN b < 75 THEN 'opposite' ELSE 'independent' END AS branch FROM h")
def tuning_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.expr("cast(conv(substr(sha2(concat('draw/', session), 256), 1, 15), 16, 10) as bigint) % 100")
    return _sessions(spark, sf_dir).select("session", bucket.alias("bucket")).withColumn("branch", F.expr("case when bucket < 50 then 'same' when bucket < 75 then 'opposite' else 'independent' end"))


@query("p13_channel_centres", """SELECT p_partkey AS profile, (p_size % 8 + 1)::INT AS channel, e AS edge, 10700000000 + (p_size % 8) * 250000000 + CASE e WHEN 'lower' THEN -120000000 ELSE 120000000 END - 9750000000 AS if_hz FROM part, (VALUES ('lower'), ('upper')) AS v(e)""")
def channel_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as profile", "p_size % 8 as c", "explode(array('lower', 'upper')) as edge")
    return rows.selectExpr("profile", "int(c + 1) as channel", "edge", "10700000000 + c * 250000000 + if(edge = 'lower', -120000000, 120000000) - 9750000000 as if_hz")


@query("p15_capture_plans", """SELECT p_partkey AS profile, (p_retailprice * 1000)::BIGINT AS duration_us, p_size * 2500 AS rate, ((p_retailprice * 1000)::BIGINT * p_size * 2500) % 1000000 = 0 AS integral, CASE WHEN ((p_retailprice * 1000)::BIGINT * p_size * 2500) % 1000000 = 0 THEN (p_retailprice * 1000)::BIGINT * p_size * 2500 // 1000000 END AS samples FROM part""")
def capture_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as profile", "cast(bround(p_retailprice * 1000, 0) as bigint) as duration_us", "p_size * 2500 as rate")
    return rows.selectExpr("profile", "duration_us", "rate", "duration_us * rate % 1000000 = 0 as integral", "case when duration_us * rate % 1000000 = 0 then duration_us * rate div 1000000 end as samples")


@query("p17_eligibility", f"WITH {_S} SELECT session, CASE WHEN priority LIKE '1%' THEN 'test' WHEN state = 'P' THEN 'pending' WHEN bytes < 20000 THEN 'small' ELSE 'eligible' END AS class FROM ses")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).selectExpr("session", "case when priority like '1%' then 'test' when state = 'P' then 'pending' when bytes < 20000 then 'small' else 'eligible' end as class")


@query("p19_point_weights", f"WITH {OBSERVATIONS_SQL} SELECT id, round(least(greatest(cents / 100.0 - k, 0) / greatest(k / 100.0, 0.02), 16), 6)::DOUBLE AS weight FROM obs")
def point_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.least(F.greatest(F.col("cents") / 100 - F.col("k"), F.lit(0.0)) / F.greatest(F.col("k") / 100, F.lit(0.02)), F.lit(16.0))
    return observations(spark, sf_dir).select("id", F.round(weight, 6).alias("weight"))


@query("p20_duplicate_ids", "SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey * 10 + l_linenumber").alias("id")).agg(F.count("*").alias("copies")).where("copies > 1")


@query("f03_json_path", "SELECT event_id AS id, json_extract_string(props, '$.k') AS k, json_extract(props, '$.missing') IS NULL AS absent FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("absent"))


@query("f07_julian_day", f"WITH {OBSERVATIONS_SQL} SELECT id, t_us // 86400000000 + 2440587 + CASE WHEN t_us % 86400000000 >= 43200000000 THEN 1 ELSE 0 END AS day, ((t_us + 43200000000) % 86400000000) AS rest_us FROM obs")
def julian_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).selectExpr("id", "(t_us + 43200000000) div 86400000000 + 2440587 as day", "(t_us + 43200000000) % 86400000000 as rest_us")


@query("f13_polynomials", "SELECT c_custkey AS id, round(((0.5::DOUBLE * x - 3) * x + 2) * x - 7, 4) AS value, round((1.5::DOUBLE * x - 6) * x + 2, 4) AS slope FROM (SELECT c_custkey, c_acctbal / 1000.0 AS x FROM customer)")
def polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and derivative by Horner's rule over coefficients, highest power first."""
    c = F.array(*map(F.lit, (0.5, -3.0, 2.0, -7.0)))
    value = F.aggregate(c, F.lit(0.0), lambda s, a: s * F.col("x") + a)
    slope = F.aggregate(F.transform(F.slice(c, 1, 3), lambda a, i: a * (3 - i)), F.lit(0.0), lambda s, a: s * F.col("x") + a)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 1000).alias("x")).select("id", F.round(value, 4).alias("value"), F.round(slope, 4).alias("slope"))


@query("j06_authorised_inputs", f"""WITH {_JOBS} SELECT e.job, e.needs AS input, p.radio FROM edges e JOIN jobs d ON d.job = e.needs AND d.state = 'succeeded' JOIN (SELECT session * 10 + line AS job, min(radio) AS radio FROM prd GROUP BY 1) p ON p.job = e.needs""")
def authorised_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, edges = _jobs(spark, sf_dir)
    products = _products(spark, sf_dir).groupBy(F.expr("session * 10 + line").alias("needs")).agg(F.min("radio").alias("radio"))
    done = jobs.where("state = 'succeeded'").select(F.col("job").alias("needs"))
    return edges.join(done, "needs", "left_semi").join(products, "needs").select("job", F.col("needs").alias("input"), "radio")


@query("j07_not_current", f"""WITH {_S}, cur AS (SELECT arg_max(session, struct_pack(c := created, s := session)) AS session FROM ses WHERE state = 'F' GROUP BY owner) SELECT p.session, count(*) AS products, sum(quantity)::BIGINT AS bytes FROM prd p WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.session = p.session) GROUP BY 1""")
def not_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = _sessions(spark, sf_dir).where("state = 'F'").groupBy("owner").agg(F.max_by("session", F.struct("created", "session")).alias("session"))
    return _products(spark, sf_dir).join(current.select("session"), "session", "left_anti").groupBy("session").agg(F.count("*").alias("products"), F.sum("quantity").alias("bytes"))


@query("j16_nearest_basin", f"""WITH {OBSERVATIONS_SQL}, h AS (SELECT path, t_us // {6 * HOUR} AS probe, id, cents, kind FROM obs), m AS (SELECT r.id, b.id AS basin, row_number() OVER (PARTITION BY r.id ORDER BY abs(r.cents - b.cents), b.id) AS n FROM h r JOIN h b ON b.path = r.path AND b.probe = r.probe AND b.kind = 'purchase' AND abs(r.cents - b.cents) <= 4000 WHERE r.kind = 'view')
SELECT r.id, m.basin FROM h r LEFT JOIN m ON m.id = r.id AND n = 1 WHERE r.kind = 'view'""")
def nearest_basin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("probe", F.expr(f"t_us div {6 * HOUR}"))
    views, basins = rows.where("kind = 'view'"), rows.where("kind = 'purchase'").selectExpr("path", "probe", "id as basin", "cents as at")
    near = views.join(basins, ["path", "probe"]).where("abs(cents - at) <= 4000").groupBy("id").agg(F.min(F.struct(F.abs(F.col("cents") - F.col("at")).alias("d"), "basin")).alias("x")).select("id", "x.basin")
    return views.select("id").join(near, "id", "left")


@query("a17_stratum_gates", """WITH g AS (SELECT lang, source, count(*) AS n, avg(quality) AS q, avg(toxic) AS t FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2), s AS (SELECT *, CASE WHEN n < 3 THEN 'insufficient' WHEN q < 0.5 THEN 'quality' WHEN t > 0.5 THEN 'toxic' ELSE 'pass' END AS gate FROM g)
SELECT lang, count(*) AS strata, count(*) FILTER (gate = 'pass') AS passed, min(n) AS smallest, CASE WHEN count(*) FILTER (gate NOT IN ('pass', 'insufficient')) > 0 THEN 'failed' WHEN count(*) FILTER (gate = 'pass') = 0 THEN 'insufficient' ELSE 'accepted' END AS status FROM s GROUP BY 1""")
def stratum_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    strata = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    strata = strata.withColumn("gate", F.expr("case when n < 3 then 'insufficient' when q < 0.5 then 'quality' when t > 0.5 then 'toxic' else 'pass' end"))
    status = F.expr("case when count_if(gate not in ('pass', 'insufficient')) > 0 then 'failed' when count_if(gate = 'pass') = 0 then 'insufficient' else 'accepted' end")
    return strata.groupBy("lang").agg(F.count("*").alias("strata"), F.count_if(F.col("gate") == "pass").alias("passed"), F.min("n").alias("smallest"), status.alias("status"))


@query("a20_trial_aggregate", f"WITH {OBSERVATIONS_SQL} SELECT kind, count(*) AS trials, count(*) FILTER (cents >= 2000) AS committed, round(sum(cents)::DOUBLE / count(*), 4) AS mean, min(cents) AS least, max(cents) AS most FROM obs GROUP BY 1")
def trial_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("trials"), F.count_if(F.col("cents") >= 2000).alias("committed"), F.round(F.sum("cents") / F.count("*"), 4).alias("mean"), F.min("cents").alias("least"), F.max("cents").alias("most"))


@query("a28_exclusion_accounting", f"""WITH {_S}, c AS (SELECT CASE WHEN state = 'P' THEN 'pending' WHEN bytes < 20000 THEN 'small' WHEN priority LIKE '1%' THEN 'test' ELSE 'used' END AS reason, bytes FROM ses) SELECT reason, count(*) AS objects, sum(bytes)::BIGINT AS bytes, (SELECT count(*) FROM c) AS total FROM c GROUP BY 1""")
def exclusion_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sessions(spark, sf_dir).selectExpr("case when state = 'P' then 'pending' when bytes < 20000 then 'small' when priority like '1%' then 'test' else 'used' end as reason", "bytes")
    counts = rows.groupBy("reason").agg(F.count("*").alias("objects"), F.sum("bytes").alias("bytes"))
    return counts.selectExpr("*", "sum(objects) over () as total")  # a row a reason


@query("a31_best_of_scan", f"WITH {OBSERVATIONS_SQL} SELECT path, kind, max(cents) AS best, arg_max(id, struct_pack(c := cents, i := -id)) AS best_id, count(*) AS dwells, count(*) FILTER (cents >= 9000) AS hits FROM obs GROUP BY 1, 2")
def best_of_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("path", "kind").agg(F.max("cents").alias("best"), F.max_by("id", F.struct(F.col("cents"), -F.col("id"))).alias("best_id"), F.count("*").alias("dwells"), F.count_if(F.col("cents") >= 9000).alias("hits"))


@query("o10_waterfall_grid", f"""WITH {OBSERVATIONS_SQL}, g AS (SELECT t_us // {6 * HOUR} AS tb, cents // 500 AS fb, count(*) AS n FROM obs GROUP BY 1, 2), r AS (SELECT *, dense_rank() OVER (ORDER BY tb) - 1 AS ti, dense_rank() OVER (ORDER BY fb) - 1 AS fi FROM g) SELECT tb, fb, n FROM r WHERE ti % 4 = 0 AND fi % 2 = 0""")
def waterfall_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth time and second frequency that occur; ranks are over the distinct times and frequencies, two short lists."""
    cells = observations(spark, sf_dir).groupBy(F.expr(f"t_us div {6 * HOUR}").alias("tb"), F.expr("cents div 500").alias("fb")).agg(F.count("*").alias("n"))
    every = lambda c, k: cells.select(c).distinct().selectExpr(c, f"row_number() over (order by {c}) - 1 as i").where(f"i % {k} = 0").select(c)
    return cells.join(every("tb", 4), "tb", "left_semi").join(every("fb", 2), "fb", "left_semi").select("tb", "fb", "n")


@query("o13_newest_snapshots", f"WITH {_S} SELECT session, created, greatest((SELECT count(*) FROM ses) - 25, 0) AS omitted FROM ses ORDER BY created DESC, session DESC LIMIT 25")
def newest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.page(_sessions(spark, sf_dir).select("session", "created"), [F.desc("created"), F.desc("session")], 25)
    return rows.select("session", "created", F.greatest(F.col("total") - 25, F.lit(0).cast("long")).alias("omitted"))


@query("u02_closure_available", """WITH RECURSIVE e AS (SELECT conv_id * 1000 + turn AS node, conv_id * 1000 + turn - 1 AS parent FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)),
reach AS (SELECT max(conv_id * 1000 + turn) AS root, max(conv_id * 1000 + turn) AS node FROM conversations GROUP BY conv_id UNION ALL SELECT r.root, e.parent FROM reach r JOIN e ON e.node = r.node)
SELECT root, count(*) AS members, bool_and(c.role <> 'system') AS available FROM reach JOIN conversations c ON c.conv_id = node // 1000 AND c.turn = node % 1000 GROUP BY 1""")
def closure_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    nodes = turns.selectExpr("conv_id", "conv_id * 1000 + turn as node", "role")
    edges = nodes.selectExpr("node", "node - 1 as parent").join(nodes.selectExpr("node as parent"), "parent", "left_semi")
    reach = catalog.lineage(edges.select("node", "parent"), nodes.groupBy("conv_id").agg(F.max("node").alias("node")).select("node"))
    return reach.join(nodes.select("node", "role"), "node").groupBy("root").agg(F.count("*").alias("members"), F.bool_and(F.col("role") != "system").alias("available"))


@query("u07_track_families", f"""WITH RECURSIVE {OBSERVATIONS_SQL}, t AS (SELECT path * 100000 + t_us // {24 * HOUR} AS track, path // 30 AS scope, t_us // {24 * HOUR} AS day, min(cents) AS lo, max(cents) AS hi FROM obs GROUP BY 1, 2, 3), e AS (SELECT x.track AS a, y.track AS b FROM t x JOIN t y ON x.scope = y.scope AND x.day = y.day AND x.track < y.track AND abs(x.hi - y.hi) <= 150 AND abs(x.lo - y.lo) <= 150),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM d UNION SELECT d.b, r.root FROM r JOIN d ON d.a = r.node) SELECT node AS track, min(root) AS family FROM r GROUP BY 1""")
def track_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators import fitting

    days = observations(ensure_checkpoint_dir(spark), sf_dir).groupBy("path", F.expr(f"t_us div {24 * HOUR}").alias("day")).agg(F.min("cents").alias("lo"), F.max("cents").alias("hi"))
    days = days.selectExpr("path * 100000 + day as track", "path div 30 as scope", "day", "lo", "hi", "hi div 151 as h")
    other = days.selectExpr("track as b", "scope", "day", "lo as lo_b", "hi as hi_b", "explode(array(hi div 151 - 1, hi div 151, hi div 151 + 1)) as h")
    pairs = days.join(other, ["scope", "day", "h"]).where("track < b and abs(hi - hi_b) <= 150 and abs(lo - lo_b) <= 150")
    return fitting.potentials(pairs.selectExpr("track as a", "b", "0L as delta")).select(F.col("node").alias("track"), F.col("root").alias("family"))


@query("u09_retention_union", f"""WITH {_S} SELECT 'session' AS kind, session AS id, created AS at, bytes FROM ses WHERE state = 'F' AND bytes > 250000 UNION ALL SELECT 'artifact', session * 10 + line, min(shipped), sum(quantity)::BIGINT FROM prd WHERE status = 'F' GROUP BY 1, 2 HAVING sum(quantity) > 60""")
def retention_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _sessions(spark, sf_dir).where("state = 'F' and bytes > 250000").selectExpr("'session' as kind", "session as id", "created as at", "bytes")
    artifacts = _products(spark, sf_dir).where("status = 'F'").groupBy(F.expr("session * 10 + line").alias("id")).agg(F.min("shipped").alias("at"), F.sum("quantity").alias("bytes")).where("bytes > 60")
    return sessions.unionByName(artifacts.withColumn("kind", F.lit("artifact")))


@query("c07_register_product", "SELECT 'sha256:' || sha256(source) AS product, count(*) AS offers, arg_min(doc_id, doc_id) AS registered, count(DISTINCT lang) > 1 AS conflict FROM documents GROUP BY source")
def register_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("offers"), F.min("doc_id").alias("registered"), (F.count_distinct("lang") > 1).alias("conflict"))
    return rows.select(F.concat(F.lit("sha256:"), F.sha2("source", 256)).alias("product"), "offers", "registered", "conflict")


@query("c14_reconcile_merge", f"""WITH {_S}, store AS (SELECT session, bytes + CASE WHEN session % 5 = 0 THEN 7 ELSE 0 END AS bytes FROM ses WHERE session % 9 <> 0), extra AS (SELECT session + 10000000 AS session, bytes FROM ses WHERE session % 50 = 1)
SELECT coalesce(c.session, s.session) AS session, coalesce(s.bytes, c.bytes) AS bytes, CASE WHEN c.session IS NULL THEN 'inserted' WHEN s.session IS NULL THEN 'kept' WHEN s.bytes <> c.bytes THEN 'updated' ELSE 'same' END AS action FROM ses c FULL JOIN (SELECT * FROM store UNION ALL SELECT * FROM extra) s ON s.session = c.session""")
def reconcile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _sessions(spark, sf_dir).select("session", "bytes")
    stored = listed.where("session % 9 <> 0").selectExpr("session", "bytes + if(session % 5 = 0, 7, 0) as found").union(listed.where("session % 50 = 1").selectExpr("session + 10000000", "bytes"))
    both = listed.withColumn("known", F.lit(True)).join(stored, "session", "full")
    action = F.expr("case when known is null then 'inserted' when found is null then 'kept' when found <> bytes then 'updated' else 'same' end")
    return both.select("session", F.coalesce("found", "bytes").alias("bytes"), action.alias("action"))


@query("c16_register_conflicts", "SELECT l_suppkey AS radio, l_linenumber AS port, count(DISTINCT l_partkey) AS offered, min(l_partkey) AS kept FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1")
def register_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("radio"), F.col("l_linenumber").alias("port"))
    return rows.agg(F.count_distinct("l_partkey").alias("offered"), F.min("l_partkey").alias("kept")).where("offered > 1")


@query("g12_interpolated_track", f"""WITH {OBSERVATIONS_SQL}, n AS (SELECT path, t_us, cents % 360 AS az, lead(t_us) OVER w AS t1, lead(cents % 360) OVER w AS az1 FROM obs WINDOW w AS (PARTITION BY path ORDER BY t_us)),
g AS (SELECT path, unnest(range((t_us + {6 * HOUR} - 1) // {6 * HOUR}, (t1 + {6 * HOUR} - 1) // {6 * HOUR})) * {6 * HOUR} AS t, t_us, t1, az, az1 FROM n WHERE t1 IS NOT NULL),
a AS (SELECT path, t, az + ((az1 - az + 540) % 360 - 180) * (t - t_us) / (t1 - t_us)::DOUBLE AS v FROM g) SELECT path, t, round(v - 360 * floor(v / 360), 4) AS azimuth FROM a""")
def interpolated_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Azimuth at every sixth hour, along the shorter arc between the observations around it."""
    w = "over (partition by path order by t_us)"
    rows = observations(spark, sf_dir).selectExpr("path", "t_us", "cents % 360 as az", f"lead(t_us) {w} as t1", f"lead(cents % 360) {w} as az1").where("t1 is not null")
    first, last = f"(t_us + {6 * HOUR} - 1) div {6 * HOUR}", f"(t1 + {6 * HOUR} - 1) div {6 * HOUR} - 1"
    grid = rows.where(f"{first} <= {last}").selectExpr("path", "t_us", "t1", "az", "az1", f"explode(transform(sequence({first}, {last}), i -> i * {6 * HOUR})) as t")
    value = F.expr("az + ((az1 - az + 540) % 360 - 180) * (t - t_us) / cast(t1 - t_us as double)")
    return grid.select("path", "t", F.round(F.pmod(value, F.lit(360.0)), 4).alias("azimuth"))


@query("d24_surrogate_evidence", f"""WITH {OBSERVATIONS_SQL}, s AS (SELECT path, avg(cents) FILTER (kind = 'view') AS exact, max(k) AS control, count(*) AS n FROM obs GROUP BY 1)
SELECT path, round(exact - 60 * control, 4) AS margin, concat_ws(',', CASE WHEN n < 60 THEN 'few' END, CASE WHEN exact - 60 * control < 0 THEN 'control' END, CASE WHEN exact IS NULL THEN 'no_exact' END) AS reasons FROM s""")
def surrogate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = observations(spark, sf_dir).groupBy("path").agg(F.avg(F.expr("case when kind = 'view' then cents end")).alias("exact"), F.max("k").alias("control"), F.count("*").alias("n"))
    reasons = F.expr("concat_ws(',', if(n < 60, 'few', null), if(exact - 60 * control < 0, 'control', null), if(exact is null, 'no_exact', null))")
    return sums.select("path", F.round(F.col("exact") - 60 * F.col("control"), 4).alias("margin"), reasons.alias("reasons"))


@query("k13_local_seeds", f"""WITH {OBSERVATIONS_SQL}, p AS (SELECT path, t_us // {24 * HOUR} AS win, id, t_us / 3.6e9 AS t, cents FROM obs), s AS (SELECT x.path, x.win, x.id AS a, y.id AS b, x.t AS t0, x.cents AS c0, (y.cents - x.cents) / (y.t - x.t) AS slope FROM p x JOIN p y ON x.path = y.path AND x.win = y.win AND y.t - x.t >= 0.5),
n AS (SELECT s.path, s.win, a, b, round(slope, 6) AS slope, count(*) AS inliers FROM s JOIN p ON p.path = s.path AND p.win = s.win AND abs(p.cents - c0 - slope * (p.t - t0)) <= 800 GROUP BY 1, 2, 3, 4, s.slope)
SELECT path, win, a, b, slope, inliers FROM (SELECT *, row_number() OVER (PARTITION BY path, win ORDER BY inliers DESC, a, b) AS r FROM n) WHERE r = 1""")
def local_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line through two points of a day that most of the day's points lie on; a day of a path holds few points."""
    points = observations(spark, sf_dir).selectExpr("path", f"t_us div {24 * HOUR} as win", "id", "t_us / 3.6e9D as t", "cents")
    days = points.groupBy("path", "win").agg(F.array_sort(F.collect_list(F.struct("id", "t", "cents"))).alias("p"))
    seeds = days.selectExpr("path", "win", "p", "explode(p) as x").selectExpr("path", "win", "p", "x", "explode(filter(p, y -> y.t - x.t >= 0.5D)) as y")
    seeds = seeds.selectExpr("path", "win", "p", "x", "y.id as b", "(y.cents - x.cents) / (y.t - x.t) as m")
    seeds = seeds.selectExpr("path", "win", "x.id as a", "b", "m", "cast(size(filter(p, z -> abs(z.cents - x.cents - m * (z.t - x.t)) <= 800)) as bigint) as inliers")
    best = seeds.groupBy("path", "win").agg(F.min(F.struct((-F.col("inliers")).alias("n"), "a", "b", "m")).alias("s"))
    return best.select("path", "win", "s.a", "s.b", F.round("s.m", 6).alias("slope"), (-F.col("s.n")).alias("inliers"))


@query("k26_motion_class", f"""WITH {OBSERVATIONS_SQL}, p AS (SELECT path, (t_us - 1704067200000000) / 3.6e9 AS t, cents, k FROM obs WHERE k > 0), f AS (SELECT path, sum(k) AS w, sum(k * t) / sum(k) AS mt, sum(k * cents) / sum(k)::DOUBLE AS mv FROM p GROUP BY 1),
s AS (SELECT p.path, mt, mv, w, sum(k * (t - mt) * (cents - mv)) / sum(k * (t - mt) ** 2) AS slope FROM p JOIN f ON f.path = p.path GROUP BY 1, 2, 3, 4)
SELECT p.path, round(slope, 6) AS slope, round(sqrt(sum(k * (cents - mv - slope * (t - mt)) ** 2) / w), 3) AS rms, CASE WHEN sqrt(sum(k * (cents - mv - slope * (t - mt)) ** 2) / w) > 5200 THEN 'indeterminate' WHEN abs(slope) < 1 THEN 'stationary' ELSE 'dynamic' END AS motion FROM p JOIN s ON s.path = p.path GROUP BY 1, slope, w""")
def motion_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = observations(spark, sf_dir).where("k > 0").selectExpr("path", "(t_us - 1704067200000000) / 3.6e9D as t", "cents", "k")
    centre = p.groupBy("path").agg(F.sum("k").alias("w"), (F.sum(F.expr("k * t")) / F.sum("k")).alias("mt"), (F.sum(F.expr("k * cents")) / F.sum("k")).alias("mv"))
    moved = p.join(centre, "path").selectExpr("path", "w", "k", "t - mt as t", "cents - mv as v")
    slope = moved.groupBy("path").agg((F.sum(F.expr("k * t * v")) / F.sum(F.expr("k * t * t"))).alias("slope"))
    rms = moved.join(slope, "path").groupBy("path", "slope", "w").agg(F.sum(F.expr("k * (v - slope * t) * (v - slope * t)")).alias("e")).selectExpr("path", "slope", "sqrt(e / w) as rms")
    return rms.select("path", F.round("slope", 6).alias("slope"), F.round("rms", 3).alias("rms"), F.expr("case when rms > 5200 then 'indeterminate' when abs(slope) < 1 then 'stationary' else 'dynamic' end").alias("motion"))


@query("k31_alias_vote", f"""WITH {OBSERVATIONS_SQL}, v AS (SELECT path, round_even((cents - 5000) / 2273.0::DOUBLE, 0)::BIGINT AS alias, sum(k)::BIGINT AS votes FROM obs GROUP BY 1, 2) SELECT path, alias, votes FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY votes DESC, abs(alias), alias) AS r FROM v) WHERE r = 1""")
def alias_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = observations(spark, sf_dir).groupBy("path", F.expr("cast(bround((cents - 5000) / 2273D, 0) as bigint)").alias("alias")).agg(F.sum("k").alias("votes"))
    best = votes.groupBy("path").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.abs("alias").alias("s"), "alias")).alias("x"))
    return best.select("path", "x.alias", (-F.col("x.v")).alias("votes"))
