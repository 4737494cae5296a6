import pytest
from pyspark.sql import functions as F

from quillon.session import ship
from quillon.sources import slices


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Forty streams of 100 blocks of 50 samples each; sample n of stream s is s * 10000 + n in one receiver, and its negative in the other."""
    ship(spark)
    blocks = spark.range(4000).selectExpr("id % 40 as stream", "(id div 40) * 50 as start", "50L as count")
    blocks = blocks.withColumn("i", F.expr("transform(sequence(0L, 49L), n -> stream * 10000 + start + n)")).withColumn("q", F.expr("transform(i, x -> -x)"))
    path = f"file://{tmp_path_factory.mktemp('recording')}/r"
    slices.write_blocks(blocks, path, 1 << 14)
    return path


def _samples(rows, column):
    return sorted(x for r in rows.collect() for x in r[column])


@pytest.mark.parametrize(("stream", "start", "count"), [(0, 0, 1), (7, 1234, 777), (39, 4999, 1), (39, 4999, 5000), (3, 0, 5000), (3, 50, 50), (41, 0, 10), (5, 5000, 3), (5, 17, 0)])
def test_a_slice_is_its_samples(spark, folder, stream, start, count):
    rows = slices.read_slice(spark, folder, stream, start, count, ["i"])
    assert rows.columns == ["start", "i"]
    assert _samples(rows, "i") == ([stream * 10000 + n for n in range(start, min(start + count, 5000))] if stream < 40 else [])
    assert all(r.i[0] == stream * 10000 + r.start for r in rows.collect())


def test_only_touched_row_groups_are_planned(folder):
    def planned(*parts):
        return slices.BlockReader(folder, list(parts), ["stream", "start", "end", "i"]).partitions()

    size = lambda parts: sum(p.bytes for p in parts)
    whole = slices.BlockReader(folder, None, ["stream"]).partitions()
    groups = sum(len(p.row_groups) for p in whole)
    assert groups > 30
    one, stream, two = planned((7, 1000, 1001)), planned((7, 0, 5000)), planned((7, 0, 5000), (31, 0, 5000))
    assert sum(len(p.row_groups) for p in one) <= 4 and size(one) <= size(whole) / 10
    assert size(one) <= size(stream) <= size(two) <= size(whole) / 5
    assert planned((99, 0, 10)) == [] == planned((7, 5000, 6000))


def test_receivers_that_are_not_asked_for_are_not_read(folder):
    reader = slices.BlockReader(folder, [(7, 0, 100)], ["stream", "start", "end", "q"])
    (batch,) = [b for p in reader.partitions() for b in reader.read(p)]
    assert batch.schema.names == ["stream", "start", "end", "q"] and batch.num_rows == 2


def test_filters_of_the_query_are_planned_with(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = slices.read_blocks(spark, folder, ["i"]).where("stream = 11 and start < 500 and end > 450")
        assert _samples(rows, "i") == [11 * 10000 + n for n in range(450, 500)]
        assert rows.rdd.getNumPartitions() <= 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert slices.read_blocks(spark, folder, ["q"]).count() == 4000


def test_many_slices_in_one_pass(spark, folder):
    wanted = [(1, 10, 20), (1, 15, 100), (1, 10, 20), (2, 0, 0), (30, 4990, 100)]
    rows = slices.read_slices(spark, folder, wanted, ["q"])
    got = {}
    for r in rows.collect():
        got.setdefault(r.slice, []).extend(r.q)
    assert {k: sorted(v, reverse=True) for k, v in got.items()} == {i: [-(s * 10000 + n) for n in range(a, min(a + c, 5000))] for i, (s, a, c) in enumerate(wanted) if c}
    with pytest.raises(ValueError):
        slices.read_slices(spark, folder, [(1, -1, 5)], ["q"])
