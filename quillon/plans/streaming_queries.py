"""Streams over the event file, drained into the shared folder; windows that no later row has closed stay open and are left out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.plans.registry import query
from quillon.session import ship
from quillon.sources.shared import ensure_checkpoint_dir
from quillon.sources.tables import OBSERVATIONS_SQL
from quillon.streaming import tracks

HOUR = 3_600_000_000


def _run(spark: SparkSession, sf_dir: str, build, name: str) -> DataFrame:
    ensure_checkpoint_dir(ship(spark))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    stream = tracks.observation_stream(spark, sf_dir)
    return tracks.drained(build(stream), f"{base}/stream-{name}-{uuid.uuid4().hex}")


@query("t01_stream_tumbling", f"""WITH {OBSERVATIONS_SQL}, w AS (SELECT t_us // {HOUR} * {HOUR} AS start_us, kind, count(*) AS n, sum(cents)::BIGINT AS cents FROM obs GROUP BY 1, 2) SELECT * FROM w WHERE start_us + {HOUR} <= (SELECT max(t_us) // 1000 * 1000 FROM obs) - {2 * HOUR}""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, lambda s: tracks.tumbling(s, "1 hour", "2 hours"), "tumbling")


@query("t03_stream_sessions")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, lambda s: tracks.sessions(s, "4 hours", "2 hours"), "sessions")


@query("t04_stream_filter")
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State by path in the RocksDB store, as a filter over millions of paths needs."""
    store, name = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(store, None)
    spark.conf.set(store, name)
    try:
        return _run(spark, sf_dir, tracks.filtered, "filter")
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
