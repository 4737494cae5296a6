"""Survey and dense acquisition on windows of recordings: sparse windows first, then all windows about the best of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import acquisition
from quillon.operators.windows import halo_windows
from quillon.plans.acquisition_queries import PERIOD, _vectors
from quillon.plans.registry import query
from quillon.plans.slice_queries import recording
from quillon.sources import slices
from quillon.sources.shared import kept

#: Samples of a window, of a step of the survey and of the dense stage, and of a range; windows that the survey hands on, and dense ones on each side.
LENGTH, EVERY, DENSE, REACH, BEST = 40, 72, 8, 1024, 2
#: Streams are numbered below 2^20, so a window's number fits in 64 bits.
_SHIFT = 1 << 43


def _windows(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    """Windows (id, stream, start, i, q) with their stream's pattern (ti, tq)."""
    blocks = slices.read_blocks(spark, recording(spark, sf_dir), ["i", "q"])
    found = halo_windows(blocks, ["i", "q"], LENGTH, every, REACH)
    shapes = _vectors(spark, sf_dir).select(F.col("label").cast("long").alias("stream"), "ti", "tq").groupBy("stream").agg(F.first("ti").alias("ti"), F.first("tq").alias("tq"))
    return found.join(shapes, "stream").withColumn("id", F.col("stream") * _SHIFT + F.col("start"))


def survey(windows: DataFrame) -> DataFrame:
    """stream, start, epoch, bin and score of each window's best cell."""

    def work(frames, x, t, scores):
        e, b = acquisition.best_cell(scores)
        return [(e, b - acquisition.BINS, float(scores[e, b]))]

    found = acquisition.each(windows, "id long, epoch int, bin int, score double", work, PERIOD)
    return found.select(F.floor(F.col("id") / _SHIFT).alias("stream"), (F.col("id") % _SHIFT).alias("start"), "epoch", "bin", F.round("score", 6).alias("score"))


def best_windows(found: DataFrame) -> DataFrame:
    """The survey's best windows of each stream, by score, then start."""
    place = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("score"), "start"))
    return found.withColumn("place", place).where(F.col("place") <= BEST)


@query("d25_window_survey")
def window_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(_windows(spark, sf_dir, EVERY))


@query("d26_dense_acquisition")
def dense_acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole acquisition on every dense window that begins within a survey's best window, and there alone."""
    top = kept(best_windows(window_survey(spark, sf_dir)).select("stream", F.col("start").alias("surveyed")))
    starts = top.select("stream", "surveyed", F.explode(F.sequence(F.col("surveyed"), F.col("surveyed") + LENGTH - 1, F.lit(DENSE).cast("long"))).alias("start"))
    dense = _windows(spark, sf_dir, DENSE).join(starts.select("stream", "start").distinct(), ["stream", "start"], "left_semi")

    def work(frames, x, t, scores):
        outcome, found = acquisition.acquired(frames, x, t, scores)
        return [(outcome, r, d["epoch"], d["frequency"], d["margin"], d["conditioned"]) for r, d in enumerate(found, 1)] or [(outcome, *[None] * 5)]

    found = acquisition.each(dense, "id long, outcome string, rank int, epoch int, frequency double, margin double, conditioned double", work, PERIOD)
    return found.select(F.floor(F.col("id") / _SHIFT).alias("stream"), (F.col("id") % _SHIFT).alias("start"), "outcome", "rank", "epoch", *[F.round(c, 6).alias(c) for c in ("frequency", "margin", "conditioned")])
