"""Fits by key: many small keys leave a task in few batches, and a key may cross batches."""

from quillon.operators import fitting


def test_small_keys_share_batches_and_long_ones_cross_them(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rows = spark.range(3000).selectExpr("if(id < 500, 0L, id div 2) as key", "id", "cast(id as double) as v")
        found = fitting.by_key(rows, ["key"], ["id"], ["v"], "key long, n long, first double", lambda v: (len(v), v[0]))
        sizes = found.mapInArrow(lambda batches: (__import__("pyarrow").RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert {r.key: (r.n, r.first) for r in found.collect()} == {0: (500, 0.0)} | {k: (2, 2.0 * k) for k in range(250, 1500)}
        assert len(sizes) < 200
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
