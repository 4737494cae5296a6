"""Votes counted in one ordered pass: what travels, keys that cross batches, and rows that the test tables don't have."""

import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillon.operators import fitting
from quillon.plans import registry

NAMES = ["k35_line_banks", "k03_hough_votes", "k03_hough_lines"]


@pytest.mark.parametrize("name", NAMES)
def test_cells_are_not_a_table(spark, sf_dir, name):
    found = registry.queries()[name](spark, sf_dir)._jdf.queryExecution()
    plan, executed = found.sparkPlan().toString(), found.executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Window", "Aggregate")) and executed.count("Exchange") == 1
    # each point twice only where its key already is
    assert "Generate" not in executed or executed.index("Generate") < executed.index("Exchange")


def _events(folder):
    rng = np.random.default_rng(35)
    start = datetime.datetime(2024, 1, 1)
    rows = [(int(rng.integers(0, 5)), start + datetime.timedelta(seconds=int(rng.integers(-900_000, 2_500_000))), float(rng.integers(-3000, 9000)) / 100, f'{{"k": {rng.integers(0, 4)}}}') for _ in range(400)]
    rows += [(9, start + datetime.timedelta(hours=int(i) % 3), float(i % 4), '{"k": 1}') for i in range(120)]  # many equal counts
    rows += [(None if i % 2 else 2, None if i % 3 else start, None if i % 5 else 1.5, '{"k": 3}' if i % 7 else "{}") for i in range(90)]
    rows += [(20, start, 3.0, "{}"), (20, start, 40.0, "{}"), (21, None, None, "{}"), (22, start, None, '{"k": 50}'), (22, start, 1.0, '{"k": 1}')]
    # a point a rounding below a whole period, for which SQL's floor gives the bin after the last, and values beyond what hundredths can say
    rows += [(30, start + datetime.timedelta(seconds=14_760), -1.23, '{"k": 9}'), (31, start + datetime.timedelta(seconds=3720), 0.31, '{"k": 9}'), (32, start + datetime.timedelta(hours=5), 8.7e14, '{"k": 2}'), (32, start, -9.1e16, '{"k": 2}')]
    user, ts, value, props = zip(*rows, strict=True)
    pq.write_table(pa.table({"event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array(user, pa.int64()), "event_type": ["view"] * len(rows), "value": pa.array(value, pa.float64()), "props": props}), folder / "events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return db


@pytest.mark.parametrize("batch", ["7", "10000"])
@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_are_those_of_sql(spark, tmp_path, name, batch):
    want = _events(tmp_path).execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r[c] for c in columns) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = want.fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    if name == "k35_line_banks":
        assert any(r[columns.index("bin")] == 16 for r in got) and any(r[0] is None for r in got)


def test_empty_table_has_no_votes(spark):
    points = spark.createDataFrame([], "key long, t double, v double, w int")
    found = fitting.hough_banks(points, ["key"], "t", "v", "w", [0.0, 1.0], 10.0, 4, 2, 1, 1.0)
    assert found.count() == 0 and found.schema["votes"].dataType.simpleString() == "bigint"
