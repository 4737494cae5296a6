"""Chains of observations: tracks before detection, path covers and their branches, order along links.  Times in hours, values in hundredths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import chains
from quillon.plans.registry import query
from quillon.session import ship
from quillon.sources.tables import OBSERVATIONS_SQL, observations

HOUR = 3_600_000_000
_START = 1_704_067_200_000_000

#: Slopes in hundredths an hour; the rest as ``chains.detected_tracks`` names it.
TRACKS = {"slopes": [-200.0, -100.0, 0.0, 100.0, 200.0], "gap": 72.0, "gate": 1500.0, "period": 22727.0, "point": 0.4, "bend": 0.5, "wait": 0.002, "support": 4, "span": 24.0, "tracks": 3}
#: Reach of a link in microseconds; weights of errors in value, slope, acceleration and of a missed step of an hour, and the errors allowed; what a path's ends cost.
COVER = {"reach": 48 * HOUR, "step": float(HOUR), "weights": (1.0, 0.75, 0.5, 0.01), "most": (4000.0, 400.0, 200.0), "ends": 1.5}


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("path", "id", ((F.col("t_us") - _START) / float(HOUR)).alias("t"), F.col("cents").cast("double").alias("f"), (F.col("k") / 50.0).alias("w"))


@query("k07_detected_tracks")
def detected_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tracks, point by point: nothing is cut between days."""
    found = chains.detected_tracks(track_points(ship(spark), sf_dir), ["path"], **TRACKS)
    return found.select("path", "track", "id", "place", F.round("slope", 6).alias("slope"), F.round("rms", 4).alias("rms"))


def cover_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("path", "id", F.col("t_us").alias("t"), F.col("cents").cast("double").alias("f"), ((F.col("k") - 50) * 2.0).alias("slope"), F.lit(0.0).alias("acceleration"))


@query("k23_covered_paths")
def covered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation with its branch (its first observation), its place there, and whether its path's cover stayed when hints were refitted, and after how many rounds."""
    found = chains.covered_paths(cover_points(ship(spark), sf_dir), ["path"], **COVER)
    return found.select("path", "id", F.col("head").alias("branch"), "place", "converged", "rounds")


@query("u06_linked_branches", f"""WITH RECURSIVE {OBSERVATIONS_SQL}, n AS (SELECT id, path, t_us, lag(id) OVER w AS before, abs(cents - lag(cents) OVER w) <= 3000 AND t_us - lag(t_us) OVER w <= {8 * HOUR} AS linked FROM obs WINDOW w AS (PARTITION BY path ORDER BY t_us, id)),
e AS (SELECT id, CASE WHEN linked THEN before END AS before FROM n), r AS (SELECT id AS node, id AS head, 0::BIGINT AS place FROM e WHERE before IS NULL UNION ALL SELECT e.id, r.head, r.place + 1 FROM r JOIN e ON e.before = r.node)
SELECT node, head, place FROM r""")
def linked_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = "over (partition by path order by t_us, id)"
    rows = observations(spark, sf_dir).selectExpr("id", f"lag(id) {w} as before", f"abs(cents - lag(cents) {w}) <= 3000 and t_us - lag(t_us) {w} <= {8 * HOUR} as linked")
    return chains.linked_order(rows.select(F.col("id").alias("node")), rows.where("linked").select(F.col("before").alias("a"), F.col("id").alias("b")))
