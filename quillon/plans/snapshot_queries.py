"""Snapshots of states at any instant, stages within a tier and a budget, and canonical digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.canonical import canonical_digest
from quillon.operators import catalog
from quillon.plans.catalog_queries import _S, _sessions
from quillon.plans.registry import query
from quillon.sources.tables import micros, table

#: Microseconds of the instants at which runs are looked at.
INSTANTS = [725_846_400_000_000, 800_000_000_000_000, 883_612_800_000_000]
#: What an event of a run leads to; a presentation follows the seal.
STATES = {"created": "pending", "shipped": "running", "received": "sealed", "presented": "presented"}
TIERS = ["quick", "standard", "deep"]


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of runs: created with the order, first shipment, last receipt, and a presentation at the last committed day if that is later."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session")).agg(F.min("l_shipdate").alias("shipped"), F.max("l_shipdate").alias("received"))
    both = _sessions(spark, sf_dir).select("session", F.col("created")).join(lines, "session")
    both = both.select("session", "created", micros("shipped").alias("shipped"), micros("received").alias("received"))
    events = F.explode(F.array(*[F.struct(F.lit(k).alias("event"), t.alias("t"), F.lit(i).alias("turn")) for i, (k, t) in enumerate((("created", F.col("created")), ("shipped", F.col("shipped")), ("received", F.col("received")), ("presented", F.col("received") + 30 * 86_400_000_000)))])).alias("e")
    return both.select("session", events).select("session", "e.*")


@query("c17_run_snapshots", f"""WITH {_S}, l AS (SELECT session, min(shipped) AS shipped, max(shipped) AS received FROM prd GROUP BY 1), b AS (SELECT s.session, s.created, l.shipped, l.received FROM ses s JOIN l USING (session)),
e AS (SELECT session, 'pending' AS state, created AS t, 0 AS turn FROM b UNION ALL SELECT session, 'running', shipped, 1 FROM b UNION ALL SELECT session, 'sealed', received, 2 FROM b UNION ALL SELECT session, 'presented', received + 2592000000000, 3 FROM b),
i(instant) AS (VALUES {', '.join(f'({t})' for t in INSTANTS)})
SELECT instant::BIGINT AS instant, session, arg_max(state, t * 4 + turn) AS state, max(t) AS since FROM e JOIN i ON e.t <= i.instant GROUP BY 1, 2""")
def run_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = catalog.state_intervals(run_events(spark, sf_dir), ["session"], ["turn"], "t", STATES)
    return catalog.as_of(spans, INSTANTS).select("instant", "session", "state", "since")


@query("p06_stage_prefix", f"""WITH {_S}, m AS (SELECT session, line, sum(quantity)::BIGINT AS cost, row_number() OVER (PARTITION BY session ORDER BY line) AS pos FROM prd GROUP BY 1, 2),
n AS (SELECT session, pos AS line, floor(log2(pos))::INT AS level, cost, CASE WHEN pos <= 2 THEN 0 WHEN pos <= 5 THEN 1 ELSE 2 END AS tier FROM m),
o AS (SELECT *, row_number() OVER w AS place, (sum(cost) OVER w)::BIGINT AS spent, max(CASE WHEN tier <= 1 THEN line END) OVER (PARTITION BY session) AS last FROM n WINDOW w AS (PARTITION BY session ORDER BY level, line ROWS UNBOUNDED PRECEDING))
SELECT session AS graph, session * 10 + line AS node, place::INT AS place, spent FROM o WHERE line <= last AND spent <= 100""")
def stage_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as stages: a line needs the one in half its place; up to the standard tier, for a hundred units."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("graph"), "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("cost"))
    lines = lines.selectExpr("graph", "cost", "row_number() over (partition by graph order by l_linenumber) as line")
    nodes = lines.select("graph", (F.col("graph") * 10 + F.col("line")).alias("node"), "cost", F.when(F.col("line") <= 2, "quick").when(F.col("line") <= 5, "standard").otherwise("deep").alias("tier"))
    edges = lines.where("line > 1").selectExpr("graph * 10 + line as node", "graph * 10 + line div 2 as needs")
    return catalog.stage_prefix(nodes, edges, TIERS, "standard", 100)


@query("f01_canonical_digests", """WITH l AS (SELECT l_orderkey AS k, list({'flag': l_returnflag, 'line': l_linenumber, 'quantity': l_quantity::BIGINT} ORDER BY l_linenumber, l_returnflag, l_quantity) AS lines FROM lineitem GROUP BY 1)
SELECT o_orderkey AS session, 'sha256:' || sha256(to_json({'lines': l.lines, 'owner': o_custkey, 'priority': o_orderpriority, 'state': o_orderstatus})::VARCHAR) AS digest FROM orders JOIN l ON l.k = o_orderkey""")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as session", "struct(l_linenumber as line, l_returnflag as flag, cast(l_quantity as bigint) as quantity) as x")
    lines = lines.groupBy("session").agg(F.array_sort(F.collect_list("x")).alias("lines"))  # the lines of an order, which a document holds anyway
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey as session", "o_custkey as owner", "o_orderpriority as priority", "o_orderstatus as state").join(lines, "session")
    rows = rows.select("session", F.struct("state", "priority", "owner", "lines").alias("document"))
    return rows.select("session", canonical_digest(F.col("document"), rows.schema["document"].dataType).alias("digest"))
