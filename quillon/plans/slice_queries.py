"""Slices of recordings: sample vectors as streams of blocks, written with their index and read by the slice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import catalog
from quillon.plans.registry import query
from quillon.session import ship
from quillon.sources import slices
from quillon.sources.shared import ensure_checkpoint_dir
from quillon.sources.tables import table

#: Stream, first sample and length: within a stream, at its beginning, beyond its end, and where there is nothing.
SLICES = [(0, 40, 5_000), (3, 0, 33), (7, 100, 10**12), (0, 41, 1), (9, 10**9, 5)]


def recording(spark: SparkSession, sf_dir: str) -> str:
    """Writes embeddings as blocks of 32 samples, a label's vectors one after another as a stream, and gives the folder."""
    ensure_checkpoint_dir(ship(spark))
    whole = table(spark, sf_dir, "embeddings").selectExpr("label", "vec_id", "transform(embedding, x -> cast(bround(cast(x as double) * 32767, 0) as bigint)) as v")
    placed = catalog.ranked(whole, ["label"], ["vec_id"], "place")
    part = lambda k: f"transform(sequence(0, 31), n -> v[2 * n + {k}])"
    blocks = placed.selectExpr("label as stream", "(place - 1) * 32 as start", "32L as count", f"{part(0)} as i", f"{part(1)} as q")
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/recording-{uuid.uuid4().hex}"
    slices.write_blocks(blocks, folder)
    return folder


_R = """smp AS (
  SELECT label::BIGINT AS stream, ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 32)::BIGINT AS start, embedding FROM embeddings
), one AS (
  SELECT stream, start + n AS sample, round_even(embedding[2 * n + 1]::DOUBLE * 32767, 0)::BIGINT AS i, round_even(embedding[2 * n + 2]::DOUBLE * 32767, 0)::BIGINT AS q FROM smp, range(32) AS r(n)
)"""


@query("s01_stream_slices", f"""WITH {_R}, s(slice, stream, lo, hi) AS (VALUES {', '.join(f'({i}::INT, {s}, {a}, {a + n})' for i, (s, a, n) in enumerate(SLICES))})
SELECT slice, s.stream::BIGINT AS stream, sample, i, q FROM one JOIN s ON s.stream = one.stream AND sample >= lo AND sample < hi""")
def stream_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slices.read_slices(spark, recording(spark, sf_dir), SLICES, ["i", "q"])
    return rows.select("slice", "stream", "start", F.posexplode(F.arrays_zip("i", "q")).alias("n", "x")).select("slice", "stream", (F.col("start") + F.col("n")).alias("sample"), "x.i", "x.q")


@query("s07_receiver_projection", f"WITH {_R} SELECT stream, count(*) AS samples, sum(q)::BIGINT AS total, sum(q * q)::BIGINT AS energy FROM one GROUP BY 1")
def receiver_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slices.read_blocks(spark, recording(spark, sf_dir), ["q"])
    fold = lambda f: F.sum(F.aggregate(F.col("q"), F.lit(0).cast("long"), f))
    return rows.groupBy("stream").agg(F.sum(F.size("q")).alias("samples"), fold(lambda a, x: a + x).alias("total"), fold(lambda a, x: a + x * x).alias("energy"))
