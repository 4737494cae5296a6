"""Sources and sinks: compressed timelines, bundles with manifests, snapshot names and element-set files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import sky
from quillon.plans.registry import query
from quillon.session import ship
from quillon.sources import bundles, timeline
from quillon.sources.shared import ensure_checkpoint_dir
from quillon.sources.tables import OBSERVATIONS_SQL, observations, table


@query("s03_timeline", f"""WITH {OBSERVATIONS_SQL} SELECT t_us // 86400000000 AS chunk, row_number() OVER (PARTITION BY t_us // 86400000000 ORDER BY t_us, id) - 1 AS line_no, id, path, kind, cents FROM obs""")
def timeline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations packed as a compressed timeline of JSON lines for each day, and read back with the schema."""
    rows = observations(ship(spark), sf_dir).select("id", "path", "kind", "cents", "t_us")
    packed = timeline.packed(rows, ["t_us", "id"], "t_us div 86400000000")
    return timeline.unpacked(packed, "chunk", "id long, path long, kind string, cents long")


@query("s10_bundle_publish", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def bundle_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents published as a bundle, beside one whose writer was lost before its manifest: readers find the first only."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    store = f"{base}/bundles-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    bundles.stage(rows, store)
    bundles.publish(rows, store)
    (held,) = bundles.committed(spark, store)
    return bundles.read(spark, store, held).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


_NAMES = "nam AS (SELECT 'set_' || strftime(o_orderdate, '%Y%m%d') || 'T' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || CASE WHEN o_orderkey % 13 = 0 THEN '.txt' WHEN o_orderkey % 17 = 0 THEN '.tle.part' ELSE '.tle' END AS name FROM orders)"


@query("s21_snapshot_listing", f"""WITH {_NAMES}, l AS (SELECT DISTINCT name, regexp_extract(name, '^set_([0-9]{{8}})T([0-9]{{2}})[.]tle$', 1) AS day, regexp_extract(name, '^set_([0-9]{{8}})T([0-9]{{2}})[.]tle$', 2) AS hour FROM nam)
SELECT name, day, hour::INT AS hour, row_number() OVER (PARTITION BY day ORDER BY hour DESC, name)::INT AS place FROM l WHERE day <> ''""")
def snapshot_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as their file names tell them, newest first within a day; names of another form are no snapshots."""
    kind = F.expr("case when o_orderkey % 13 = 0 then '.txt' when o_orderkey % 17 = 0 then '.tle.part' else '.tle' end")
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("set_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), kind).alias("name")).distinct()
    pattern = "^set_([0-9]{8})T([0-9]{2})[.]tle$"
    rows = names.select("name", F.regexp_extract("name", pattern, 1).alias("day"), F.regexp_extract("name", pattern, 2).alias("hour")).where("day <> ''")
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("hour"), "name"))
    return rows.select("name", "day", F.col("hour").cast("int").alias("hour"), place.alias("place"))


_LINE1 = "'1 ' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') || 'U 24001A   24' || lpad((p_size % 366)::VARCHAR, 3, '0') || '.12345678  .00001234  00000-0 -12345-3 0  999'"
_LINE2 = "'2 ' || lpad(((p_partkey + CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END) % 100000)::VARCHAR, 5, '0') || ' 053.0000 ' || lpad((p_size % 360)::VARCHAR, 3, '0') || '.0000 0001000 090.0000 270.0000 15.06000000 1234'"
_SUM = "(list_sum(list_transform(string_split(substr({0}, 1, 68), ''), lambda c: CASE WHEN c = '-' THEN 1 WHEN c >= '0' AND c <= '9' THEN c::INT ELSE 0 END)) % 10)"
_ELEMENTS = f"""raw AS (SELECT p_partkey // 50 AS file, p_partkey, {_LINE1} AS one, {_LINE2} AS two FROM part), sums AS (SELECT *, {_SUM.format('one')}::INT AS s1, {_SUM.format('two')}::INT AS s2 FROM raw),
lin AS (SELECT file, p_partkey * 3 AS line_no, 'OBJECT ' || p_partkey AS line FROM sums WHERE p_partkey % 2 = 0 UNION ALL SELECT file, p_partkey * 3 + 1, one || (CASE WHEN p_partkey % 7 = 0 THEN (s1 + 1) % 10 ELSE s1 END)::VARCHAR FROM sums
UNION ALL SELECT file, p_partkey * 3 + 2, two || s2::VARCHAR || CASE WHEN p_partkey % 23 = 0 THEN ' ' ELSE '' END FROM sums WHERE p_partkey % 11 <> 0)"""


def _element_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-set files of fifty parts each, line by line: names before even ones, some lines missing, too long or with a wrong sum."""
    one = "concat('1 ', lpad(p_partkey % 100000, 5, '0'), 'U 24001A   24', lpad(p_size % 366, 3, '0'), '.12345678  .00001234  00000-0 -12345-3 0  999')"
    two = "concat('2 ', lpad((p_partkey + if(p_partkey % 19 = 0, 1, 0)) % 100000, 5, '0'), ' 053.0000 ', lpad(p_size % 360, 3, '0'), '.0000 0001000 090.0000 270.0000 15.06000000 1234')"
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey div 50 as file", "p_partkey", f"{one} as one", f"{two} as two")
    rows = rows.withColumns({"s1": sky.element_checksum(F.col("one")), "s2": sky.element_checksum(F.col("two"))})
    lines = F.expr("filter(array(if(p_partkey % 2 = 0, struct(p_partkey * 3 as line_no, concat('OBJECT ', p_partkey) as line), null), struct(p_partkey * 3 + 1 as line_no, concat(one, if(p_partkey % 7 = 0, (s1 + 1) % 10, s1)) as line), if(p_partkey % 11 <> 0, struct(p_partkey * 3 + 2 as line_no, concat(two, s2, if(p_partkey % 23 = 0, ' ', '')) as line), null)), x -> x is not null)")
    return rows.select("file", F.explode(lines).alias("x")).select("file", "x.line_no", "x.line")


@query("s22_element_sets", f"""WITH {_ELEMENTS}, p AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM lin WINDOW w AS (PARTITION BY file ORDER BY line_no)),
e AS (SELECT file, line_no, line AS one, CASE WHEN after LIKE '2 %' THEN after END AS two, CASE WHEN before NOT LIKE '1 %' AND before NOT LIKE '2 %' THEN before END AS name FROM p WHERE line LIKE '1 %')
SELECT file, line_no, name, substr(one, 3, 5) AS object, CASE WHEN two IS NULL THEN 'unpaired' WHEN length(one) <> 69 OR length(two) <> 69 THEN 'length' WHEN substr(one, 3, 5) <> substr(two, 3, 5) THEN 'object'
WHEN substr(one, 69, 1) <> {_SUM.format('one')}::VARCHAR OR substr(two, 69, 1) <> {_SUM.format('two')}::VARCHAR THEN 'checksum' ELSE 'ok' END AS status FROM e""")
def element_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines paired to element sets of two lines with or without a name, and what is wrong with a set: its form, its objects or its sums."""
    w = Window.partitionBy("file").orderBy("line_no")
    lines = _element_lines(spark, sf_dir).withColumns({"before": F.lag("line").over(w), "after": F.lead("line").over(w)}).where("line like '1 %'")
    sets = lines.selectExpr("file", "line_no", "line as one", "case when after like '2 %' then after end as two", "case when before not like '1 %' and before not like '2 %' then before end as name")
    wrong = lambda c: F.substring(c, 69, 1) != sky.element_checksum(F.col(c)).cast("string")
    status = F.when(F.col("two").isNull(), "unpaired").when((F.length("one") != 69) | (F.length("two") != 69), "length").when(F.substring("one", 3, 5) != F.substring("two", 3, 5), "object").when(wrong("one") | wrong("two"), "checksum").otherwise("ok")
    return sets.select("file", "line_no", "name", F.substring("one", 3, 5).alias("object"), status.alias("status"))
