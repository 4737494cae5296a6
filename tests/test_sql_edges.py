"""Rows that the test tables don't have, against SQL: an hour of zeros, a direction a hair west of north."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillon.functions import sky
from quillon.plans import registry


def test_a01_hour_of_zeros(spark, tmp_path):
    at = [datetime.datetime(2024, 1, 1, h) for h in (0, 2, 2)]
    pq.write_table(pa.table({"event_id": [1, 2, 3], "ts": pa.array(at, pa.timestamp("us")), "user_id": [7, 7, 7], "event_type": ["view"] * 3, "value": [0.0, 1.0, 2.0], "props": ['{"k": 1}'] * 3}), tmp_path / "events.parquet")
    name = "a01_window_power_summary"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = [tuple(r[c] for c in columns) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, found.fetchall())) and any("inf" in repr(r) for r in got)


def test_azimuth_a_hair_west_of_north(spark):
    az, _, _ = sky.look_angles(F.lit(0.0), F.lit(0.0), F.col("x"), F.col("y"), F.lit(1.0))
    got = [r[0] for r in spark.createDataFrame([(1.0, -1e-20), (1.0, 0.0), (1.0, 1.0)], "x double, y double").select(az).collect()]
    x = duckdb.execute("SELECT degrees(atan2(-1e-20::DOUBLE, 1))").fetchone()[0]
    assert got == [duckdb.execute("SELECT ?::DOUBLE - 360 * floor(?::DOUBLE / 360)", [x, x]).fetchone()[0], 0.0, 45.0] and got[0] == 360.0
