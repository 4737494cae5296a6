"""Products and their bindings, verified slices, symbol workspaces and method rows, surveys in windows, and joint polynomial fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import kernels, partitions, tracks
from quillon.plans.catalog_queries import _S, _products, _sessions
from quillon.plans.registry import query
from quillon.session import ship
from quillon.plans.track_queries import PERIOD, _points
from quillon.sources.tables import OBSERVATIONS_SQL, SAMPLES_SQL, observations, samples, table

#: The kinds of products that can be read, with their versions.
CODECS = [("click", 1), ("click", 2), ("view", 1), ("view", 2), ("view", 3), ("purchase", 3)]
SLICE = 512


@query("p09_reusable_artifacts", f"""WITH {_S} SELECT sha256(part || '/' || quantity) AS digest, count(DISTINCT session) AS runs, count(*) AS members, min(session) AS first_run, count(DISTINCT session) > 1 AS reusable FROM prd GROUP BY 1""")
def reusable_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts by the digest of what they hold, with the runs that they are members of."""
    digest = F.sha2(F.concat_ws("/", "part", "quantity"), 256)
    held = _products(spark, sf_dir).groupBy(digest.alias("digest"), "session").agg(F.count("*").alias("n"))
    held = held.groupBy("digest").agg(F.count("*").alias("runs"), F.sum("n").alias("members"), F.min("session").alias("first_run"))
    return held.withColumn("reusable", F.col("runs") > 1)


@query("p10_product_codec", f"""WITH {OBSERVATIONS_SQL}, p AS (SELECT o.id, o.kind, o.id % 3 + 1 AS version, o.k IS NOT NULL AND json_keys(e.props) = ['k'] AS readable FROM obs o JOIN events e ON e.event_id = o.id),
c AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in CODECS)}) AS v(kind, version))
SELECT id, kind, version, CASE WHEN kind NOT IN (SELECT kind FROM c) THEN 'kind' WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.kind = p.kind AND c.version = p.version) THEN 'version' ELSE 'payload' END AS violation
FROM p WHERE NOT readable OR NOT EXISTS (SELECT 1 FROM c WHERE c.kind = p.kind AND c.version = p.version)""")
def product_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that no codec reads: a kind or a version that isn't known, or a payload that isn't exactly the schema's."""
    pairs = F.concat_ws("/", "kind", "version").isin([f"{k}/{v}" for k, v in CODECS])
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.expr("event_id % 3 + 1").alias("version"), (F.from_json("props", "k int")["k"].isNotNull() & (F.json_object_keys("props") == F.array(F.lit("k")))).alias("readable"))
    known = F.col("kind").isin(sorted({k for k, _ in CODECS}))
    wrong = rows.where(~F.coalesce("readable", F.lit(False)) | ~pairs)
    return wrong.select("id", "kind", "version", F.when(~known, "kind").when(~pairs, "version").otherwise("payload").alias("violation"))


@query("p11_source_binding", f"""WITH {_S}, s AS (SELECT session, sha256('source/' || session || '/' || bytes) AS source, sha256('source/' || session || '/' || (bytes - 1)) AS before FROM ses), r AS (SELECT session, bool_or(flag = 'R') AS stale FROM prd GROUP BY 1),
q AS (SELECT *, sha256('quality/1/' || source) AS quality, CASE WHEN coalesce(stale, FALSE) THEN before ELSE source END AS recorded FROM s LEFT JOIN r USING (session)), t AS (SELECT *, sha256('tracks/2/' || source || '/' || quality) AS tracks FROM q)
SELECT session, source, quality, tracks, recorded = source AS bound FROM t""")
def source_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each stage over those of the stages before it, and whether the source that the products name is the one that is there."""
    stale = _products(spark, sf_dir).groupBy("session").agg(F.bool_or(F.col("flag") == "R").alias("stale"))
    digest = lambda *parts: F.sha2(F.concat_ws("/", *parts), 256)
    rows = _sessions(spark, sf_dir).select("session", digest(F.lit("source"), "session", "bytes").alias("source"), digest(F.lit("source"), "session", F.col("bytes") - 1).alias("before"))
    rows = rows.join(stale, "session", "left").withColumn("recorded", F.when(F.coalesce("stale", F.lit(False)), F.col("before")).otherwise(F.col("source")))
    rows = rows.withColumn("quality", digest(F.lit("quality"), F.lit("1"), "source"))
    return rows.select("session", "source", "quality", digest(F.lit("tracks"), F.lit("2"), "source", "quality").alias("tracks"), (F.col("recorded") == F.col("source")).alias("bound"))


_SLICES = f"slc AS (SELECT page_id, s::INT AS slice, substr(html, 1 + {SLICE} * s, {SLICE}) AS part FROM (SELECT page_id, html, unnest(range((length(html) + {SLICE - 1}) // {SLICE})) AS s FROM pages))"


@query("s18_verified_slices", f"WITH {_SLICES} SELECT page_id, slice, length(part)::INT AS length, sha256(part) AS digest FROM slc")
def verified_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(spark, sf_dir).select("page_id", "slice", F.length("part").alias("length"), F.sha2("part", 256).alias("digest"))


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").where("length(html) > 0").selectExpr("page_id", "html", f"explode(sequence(0, (length(html) - 1) div {SLICE})) as s")
    return rows.selectExpr("page_id", "int(s) as slice", f"substr(html, int(1 + {SLICE} * s), {SLICE}) as part")


@query("s19_ingest_slices", f"""WITH {_SLICES}, m AS (SELECT page_id, slice, sha256(CASE WHEN page_id % 7 = 3 AND slice = 1 THEN part || '!' ELSE part END) AS digest FROM slc)
SELECT page_id, count(*) AS slices, sum(length(part))::BIGINT AS length, count_if(sha256(part) <> digest)::BIGINT AS broken, sha256(string_agg(digest, '' ORDER BY slice)) AS recording FROM slc JOIN m USING (page_id, slice) GROUP BY 1""")
def ingest_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings from their slices, with those that don't have the manifest's digest (the manifest here errs in one slice of every seventh page)."""
    found = _slices(spark, sf_dir).withColumn("held", F.sha2("part", 256))
    manifest = F.when((F.col("page_id") % 7 == 3) & (F.col("slice") == 1), F.sha2(F.concat("part", F.lit("!")), 256)).otherwise(F.col("held"))
    rows = found.withColumn("digest", manifest).groupBy("page_id").agg(F.count("*").alias("slices"), F.sum(F.length("part")).alias("length"), F.count_if(F.col("held") != F.col("digest")).alias("broken"), F.array_sort(F.collect_list(F.struct("slice", "digest"))).alias("x"))
    return rows.select("page_id", "slices", "length", "broken", F.sha2(F.array_join(F.col("x.digest"), ""), 256).alias("recording"))


_WORKSPACE = f"""{SAMPLES_SQL}, tpl AS (SELECT label, n, sum(i)::BIGINT AS ti, sum(q)::BIGINT AS tq FROM smp GROUP BY 1, 2), wrk AS (
SELECT vec_id, s.n // 4 AS symbol, sum(t.ti * i + t.tq * q)::BIGINT AS re, sum(t.ti * q - t.tq * i)::BIGINT AS im, sum(c.ti * i + c.tq * q)::BIGINT AS control_re, sum(c.ti * q - c.tq * i)::BIGINT AS control_im, sum(i * i + q * q)::BIGINT AS support,
sum(t.ti * t.ti + t.tq * t.tq)::BIGINT AS energy, sum(c.ti * c.ti + c.tq * c.tq)::BIGINT AS control_energy
FROM smp s JOIN tpl t ON t.label = s.label AND t.n = s.n JOIN tpl c ON c.label = s.label AND c.n = (s.n + 25) % 32 GROUP BY 1, 2)"""


def _workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each symbol of four samples with its label's template and with the rolled one, in whole numbers."""
    rows = samples(spark, sf_dir)
    exact = kernels.templates(rows, "label", "n", "i", "q")
    control = kernels.rolled(exact, "n", 7, 32).select("template", "n", F.col("ti").alias("ci"), F.col("tq").alias("cq"))
    shapes = exact.join(control, ["template", "n"]).withColumnRenamed("template", "label")
    met = rows.join(shapes, ["label", "n"])
    sums = {"re": "ti * i + tq * q", "im": "ti * q - tq * i", "control_re": "ci * i + cq * q", "control_im": "ci * q - cq * i", "support": "i * i + q * q", "energy": "ti * ti + tq * tq", "control_energy": "ci * ci + cq * cq"}
    return met.groupBy("vec_id", F.expr("int(n div 4)").alias("symbol")).agg(*[F.sum(F.expr(x)).alias(name) for name, x in sums.items()])


@query("d11_symbol_workspace", f"WITH {_WORKSPACE} SELECT vec_id, symbol, re, im, control_re, control_im, support FROM wrk")
def symbol_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).drop("energy", "control_energy")


@query("d16_method_rows", f"""WITH {_WORKSPACE}, m AS (SELECT vec_id, sum(sqrt(re::DOUBLE * re + im::DOUBLE * im)) / sum(sqrt(energy::DOUBLE * support)) AS e1, sum(sqrt(control_re::DOUBLE * control_re + control_im::DOUBLE * control_im)) / sum(sqrt(control_energy::DOUBLE * support)) AS c1,
count_if(re > 0) / 8 AS e2, count_if(control_re > 0) / 8 AS c2 FROM wrk GROUP BY 1 HAVING sum(support) > 0), r AS (SELECT vec_id, 'symbolwise' AS method, e1 AS e, c1 AS c FROM m UNION ALL SELECT vec_id, 'sign_accuracy', e2, c2 FROM m)
SELECT vec_id, method, round(e, 6) AS exact, round(c, 6) AS control, round(e - c, 6) + 0.0 AS margin FROM r""")
def method_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each method: its score, its control's score and the margin."""
    size = lambda x, y: F.sqrt(F.col(x).cast("double") * F.col(x) + F.col(y).cast("double") * F.col(y))
    ceiling = lambda x: F.sqrt(F.col(x).cast("double") * F.col("support"))
    sums = _workspace(spark, sf_dir).groupBy("vec_id").agg(
        (F.sum(size("re", "im")) / F.sum(ceiling("energy"))).alias("e1"),
        (F.sum(size("control_re", "control_im")) / F.sum(ceiling("control_energy"))).alias("c1"),
        (F.count_if(F.col("re") > 0) / 8).alias("e2"),
        (F.count_if(F.col("control_re") > 0) / 8).alias("c2"),
        F.sum("support").alias("support"),
    )
    rows = sums.where("support > 0").selectExpr("vec_id", "stack(2, 'symbolwise', e1, c1, 'sign_accuracy', e2, c2) as (method, e, c)")
    return rows.select("vec_id", "method", F.round("e", 6).alias("exact"), F.round("c", 6).alias("control"), (F.round(F.col("e") - F.col("c"), 6) + 0.0).alias("margin"))


_SURVEY = f"""{OBSERVATIONS_SQL}, spn AS (SELECT path, min(t_us) AS t0, max(t_us) AS t1 FROM obs GROUP BY 1 HAVING max(t_us) > min(t_us)),
win AS (SELECT o.*, t0, t1, least(7, (t_us - t0) * 8 // (t1 - t0))::INT AS "window" FROM obs o JOIN spn USING (path)),
srv AS (SELECT path, "window", count(*) AS n, max(cents) AS best, min(t0) AS t0, min(t1) AS t1 FROM win GROUP BY 1, 2)"""


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observations with their window, of eight even ones over each path's span, and the survey of the windows."""
    rows = observations(spark, sf_dir)
    span = rows.groupBy("path").agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1")).where("t1 > t0")
    rows = rows.join(span, "path").withColumn("window", F.expr("int(least(7, (t_us - t0) * 8 div (t1 - t0)))"))
    return rows, rows.groupBy("path", "window").agg(F.count("*").alias("n"), F.max("cents").alias("best"))


@query("d25_sparse_survey", f'WITH {_SURVEY} SELECT path, "window", n, best, row_number() OVER (PARTITION BY path ORDER BY best DESC, "window")::INT AS rank FROM srv')
def sparse_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = Window.partitionBy("path").orderBy(F.desc("best"), "window")
    return _windows(spark, sf_dir)[1].withColumn("rank", F.row_number().over(place))


@query("d26_dense_refinement", f"""WITH {_SURVEY}, top AS (SELECT path, "window" FROM srv QUALIFY row_number() OVER (PARTITION BY path ORDER BY best DESC, "window") <= 2)
SELECT path, "window", least(3, ((t_us - t0) * 8 - "window" * (t1 - t0)) * 4 // (t1 - t0))::INT AS part, count(*) AS n, sum(cents)::BIGINT AS cents, min(id) AS first_id FROM win JOIN top USING (path, "window") GROUP BY 1, 2, 3""")
def dense_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best windows of each path again, in four parts."""
    rows, survey = _windows(spark, sf_dir)
    place = Window.partitionBy("path").orderBy(F.desc("best"), "window")
    top = survey.withColumn("rank", F.row_number().over(place)).where("rank <= 2").select("path", "window")
    dense = rows.join(top, ["path", "window"]).withColumn("part", F.expr("int(least(3, ((t_us - t0) * 8 - window * (t1 - t0)) * 4 div (t1 - t0)))"))
    return dense.groupBy("path", "window", "part").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.min("id").alias("first_id"))


@query("d28_raw_validation", f"""WITH {OBSERVATIONS_SQL}, s AS (SELECT path, id, k, cents, t_us - lag(t_us) OVER (PARTITION BY path ORDER BY id) AS step FROM obs),
v AS (SELECT path, count(*) AS n, count_if(step <= 0)::BIGINT AS disordered, count_if(step > 360000000000)::BIGINT AS gaps, count_if(cents >= 49000 OR cents <= 1)::BIGINT AS clipped, count_if(k IS NULL)::BIGINT AS unmarked FROM s GROUP BY 1)
SELECT *, disordered = 0 AND unmarked = 0 AND 20 * gaps <= n AND 100 * clipped <= n AS valid FROM v""")
def raw_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, gaps, clipping and marks of each path's raw observations, and whether they may be used."""
    step = F.col("t_us") - F.lag("t_us").over(Window.partitionBy("path").orderBy("id"))
    counts = observations(spark, sf_dir).withColumn("step", step).groupBy("path").agg(
        F.count("*").alias("n"), F.count_if(F.col("step") <= 0).alias("disordered"), F.count_if(F.col("step") > 360_000_000_000).alias("gaps"), F.count_if((F.col("cents") >= 49_000) | (F.col("cents") <= 1)).alias("clipped"), F.count_if(F.col("k").isNull()).alias("unmarked")
    )
    return counts.withColumn("valid", F.expr("disordered = 0 and unmarked = 0 and 20 * gaps <= n and 100 * clipped <= n"))


@query("k33_trajectory_table", f"""WITH {OBSERVATIONS_SQL}, w AS (SELECT *, (t_us - 1704067200000000) // 604800000000 AS week FROM obs)
SELECT path, week, kind AS method, count(*) AS n, min(t_us) AS start_us, max(t_us) AS end_us, max(cents) AS best, -max(struct_pack(c := cents, i := -id)).i AS best_id, sum(k)::BIGINT AS control FROM w GROUP BY 1, 2, 3""")
def trajectory_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("week", F.expr("(t_us - 1704067200000000) div 604800000000"))
    out = rows.groupBy("path", "week", F.col("kind").alias("method")).agg(F.count("*").alias("n"), F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.max(F.struct("cents", (-F.col("id")).alias("minus"))).alias("x"), F.sum("k").alias("control"))
    return out.select("path", "week", "method", "n", "start_us", "end_us", F.col("x.cents").alias("best"), (-F.col("x.minus")).alias("best_id"), "control")


@query("k17_joint_polynomials")
def joint_polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By path and week the degree, 1 or 2, whose fit jointly with whole multiples of the period has the smaller criterion."""
    fits = [tracks.lifted_polynomial(_points(ship(spark), sf_dir), ["path", "week"], PERIOD, degree).withColumn("degree", F.lit(degree)) for degree in (1, 2)]
    both = fits[0].unionByName(fits[1]).withColumn("k", F.row_number().over(Window.partitionBy("path", "week").orderBy("bic", "degree"))).where("k = 1")
    return both.select("path", "week", "degree", "n", F.round("a0", 3).alias("a0"), F.round("a1", 5).alias("a1"), F.round("a2", 7).alias("a2"), F.round("rms", 3).alias("rms"), F.round("held_rms", 3).alias("held_rms"))


@query("u05_set_partitions", """WITH RECURSIVE item AS (SELECT n_regionkey AS region, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS place FROM nation),
grow AS (SELECT region, 1::BIGINT AS place, [0] AS blocks FROM item WHERE place = 1 UNION ALL SELECT g.region, g.place + 1, list_append(g.blocks, b::INT) FROM grow g JOIN item i ON i.region = g.region AND i.place = g.place + 1 JOIN range(8) AS r(b) ON b <= list_max(g.blocks) + 1)
SELECT region, blocks, list_max(blocks) + 1 AS n_blocks FROM grow g WHERE place = (SELECT max(place) FROM item i WHERE i.region = g.region)""")
def set_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All partitions of each region's nations, as the block of each nation in order of names."""
    sizes = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("size"))
    return partitions.set_partitions(sizes, "size", 8).select("region", "blocks", (F.array_max("blocks") + 1).alias("n_blocks"))
