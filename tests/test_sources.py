import zstandard
import pytest
from pyspark.sql import functions as F

from quillon.operators import catalog, ordered
from quillon.sources import bundles, timeline


def test_timeline_files_are_read_as_streams(spark, tmp_path):
    lines = [f'{{"id": {i}, "name": "é{i}"}}' for i in range(10_000)]
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress("\n".join(lines).encode()))
    # several frames one after another, and a line that isn't of the schema
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.compress(b'{"id": 1}\n') + zstandard.compress(b"not json\n"))
    (tmp_path / "c.jsonl.zst").write_bytes(zstandard.compress(b""))
    rows = timeline.read_timeline(spark, str(tmp_path), "id long, name string")
    assert rows.where("path like '%a.jsonl.zst'").agg(F.count("*"), F.sum("id"), F.max("line_no"), F.max("name")).first()[:3] == (10_000, sum(range(10_000)), 9_999)
    assert sorted((r.line_no, r.id, r.name) for r in rows.where("path like '%b.jsonl.zst'").collect()) == [(0, 1, None), (1, None, None)]
    assert rows.where("path like '%c.jsonl.zst'").count() == 0


def test_packed_and_unpacked_are_inverse(spark):
    rows = spark.createDataFrame([(i, i % 3, None if i % 5 == 0 else f"n\n{i}") for i in range(50)], "id long, part int, name string")
    back = timeline.unpacked(timeline.packed(rows, ["id"], "part"), "chunk", "id long, part int, name string")
    assert sorted(map(tuple, back.select("id", "part", "name").collect())) == sorted(map(tuple, rows.collect()))
    assert [r.id for r in back.where("chunk = 1").orderBy("line_no").collect()] == [i for i in range(50) if i % 3 == 1]
    assert timeline.packed(rows.where("false"), ["id"], "part").count() == 0


def test_a_bundle_is_there_with_its_manifest_only(spark, tmp_path):
    store, rows = str(tmp_path), spark.range(100).withColumn("x", F.col("id") * 2)
    lost = bundles.stage(rows, store)
    held = bundles.publish(rows, store)
    assert bundles.committed(spark, store) == [held]
    assert bundles.read(spark, store, held).count() == 100
    with pytest.raises(ValueError, match="no manifest|unlisted"):
        bundles.read(spark, store, lost)
    files = sorted((tmp_path / "data" / held).glob("*.parquet"))
    files[0].write_bytes(files[0].read_bytes() + b"x")
    files[1].unlink()
    (tmp_path / "data" / held / "other.parquet").write_bytes(b"y")
    (tmp_path / "data" / held / f".{files[0].name}.crc").unlink(missing_ok=True)
    assert sorted(r.status for r in bundles.inspected(spark, store, held).collect() if r.status != "ok") == ["digest", "missing", "unlisted"]
    with pytest.raises(ValueError, match="digest"):
        bundles.read(spark, store, held)


def test_topological_order_with_cycles_chains_and_missing_needs(spark):
    edges = [(i, i - 1) for i in range(1, 30)] + [(100, 101), (101, 100), (102, 100), (29, 3), (29, 3)]
    nodes = spark.createDataFrame([(i,) for i in [*range(30), 100, 101, 102, 200]], "node long")
    got = {r.node: (r.level, r.cyclic) for r in catalog.topological(nodes, spark.createDataFrame(edges, "node long, needs long")).collect()}
    assert got == {**{i: (i, False) for i in range(30)}, 100: (None, True), 101: (None, True), 102: (None, True), 200: (0, False)}
    with pytest.raises(ValueError, match="isn't there"):
        catalog.topological(nodes, spark.createDataFrame([(1, 77)], "node long, needs long"))


def test_places_and_values_before_over_ranges(spark):
    rows = spark.createDataFrame([(i % 2, (i * 37) % 101, i) for i in range(400)], "kind int, t long, id long").repartition(3)
    plain = rows.selectExpr("id", "row_number() over (partition by kind order by t, id) as place", "lag(t * 2) over (partition by kind order by t, id) as before")
    want = sorted(map(tuple, plain.collect()))
    placed = catalog.ranked(rows, ["kind"], ["t", "id"], "place")
    both = ordered.lagged(placed.withColumn("v", F.col("t") * 2), ["kind"], ["t", "id"], "v", "before")
    assert sorted(map(tuple, both.select("id", "place", "before").collect())) == want


def test_streamed_state_goes_over_batches_and_stops_at_keys(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.createDataFrame([(k, i, i + k) for k in range(5) for i in range(30)], "key long, t long, x long").repartition(4)
        got = ordered.streamed(rows, ["key"], ["t"], ["t", "x"], "key long, t long, total long", lambda: 0, lambda s, r: (s + r[1], (r[0], s + r[1])))
        assert sorted(map(tuple, got.collect())) == sorted((k, i, sum(j + k for j in range(i + 1))) for k in range(5) for i in range(30))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
