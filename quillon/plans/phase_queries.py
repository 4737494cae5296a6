"""Filters and loops on observations: a path's values as phases, its control score as coherence, time in hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import grouped, ordered, phase
from quillon.plans.registry import query
from quillon.session import ship
from quillon.sources.tables import observations

_START = 1_704_067_200_000_000
PERIOD = 2273.0


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(ship(spark), sf_dir).selectExpr("path", "id", "t_us", f"(t_us - {_START}) / 3.6e9D as t", "cents % 1000 / 1000D as carrier", "cents % 733 / 733D as frame", "coalesce(k, 0) / 100D as coherence", "cast(cents as double) as code", "cast(coalesce(k, 0) - 50 as double) as rate")


@query("k27_carrier_filter")
def carrier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five states by path: phase, rate, acceleration, frame phase and drift, with slips and corrections marked."""
    work = phase.CarrierFilter()
    schema = "path long, id long, phase double, rate double, acceleration double, frame double, drift double, slip boolean, corrected boolean"
    found = ordered.streamed(_rows(spark, sf_dir), ["path"], ["t", "id"], ["id", "t", "carrier", "frame", "coherence"], schema, work.start, work.step)
    return found.select("path", "id", *[F.round(c, 6).alias(c) for c in ("phase", "rate", "acceleration", "frame", "drift")], "slip", "corrected")


@query("k27_frame_filter")
def frame_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five states by path from the carrier's phase and rate and the frame's phase, with the exact noise of each step; slips and corrections marked."""
    work = phase.FrameFilter()
    states = ("phase", "rate", "acceleration", "frame", "drift")
    schema = ", ".join(["path long", "id long", "taken boolean", *[f"{c} double" for c in ("phase_off", "rate_off", "frame_off", *states, "phase_sigma")], "slip boolean", "corrected boolean"])
    rows = _rows(spark, sf_dir).withColumn("speed", F.pmod(F.col("code"), F.lit(517.0)) / 517.0 - 0.5)
    found = grouped.in_step(rows, ["path"], ["t", "id"], ["id", "t", "carrier", "speed", "frame", "coherence"], schema, work.starts, work.steps)
    return found.select("path", "id", "taken", *[F.round(c, 6).alias(c) for c in ("phase_off", "rate_off", "frame_off", *states, "phase_sigma")], "slip", "corrected")


@query("k28_filter_product")
def filter_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the filter leaves of each path: how many of its observations were taken, slipped or corrected, and its last state."""
    rows = carrier_filter(spark, sf_dir).join(observations(spark, sf_dir).select("id", "t_us"), "id")
    last = F.max_by(F.struct("phase", "rate", "drift"), F.struct("t_us", "id"))
    found = rows.groupBy("path").agg(F.count("*").alias("n"), F.count_if("slip").alias("slips"), F.count_if("corrected").alias("corrections"), last.alias("x"))
    return found.select("path", "n", "slips", "corrections", "x.phase", "x.rate", "x.drift", (F.col("slips") * 4 <= F.col("n")).alias("usable"))


@query("k29_code_replay")
def code_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = phase.CodeFilter(PERIOD, 250_000.0, 2500.0, 400.0)
    found = ordered.streamed(_rows(spark, sf_dir), ["path"], ["t", "id"], ["id", "t", "code", "rate"], "path long, id long, code double, rate double, innovation double", work.start, work.step)
    return found.select("path", "id", *[F.round(c, 4).alias(c) for c in ("code", "rate", "innovation")])


@query("k30_phase_loop")
def phase_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = phase.PhaseLoop()
    found = ordered.streamed(_rows(spark, sf_dir), ["path"], ["t", "id"], ["id", "t", "carrier"], "path long, id long, epoch int, phase double, frequency double, error double, locked boolean", work.start, work.step)
    return found.select("path", "id", "epoch", *[F.round(c, 6).alias(c) for c in ("phase", "frequency", "error")], "locked")


@query("k30_locked_epochs")
def locked_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop's epochs of each path with how much of each was locked, and the rms error while it was."""
    error = F.when(F.col("locked"), F.col("error") * F.col("error"))
    found = phase_loop(spark, sf_dir).groupBy("path", "epoch").agg(F.count("*").alias("n"), F.count_if("locked").alias("locked"), F.round(F.sqrt(F.avg(error)), 4).alias("rms"))
    return found.where("locked > 0")


@query("k25_activity_tracks")
def activity_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of activity in each segment of a path: no track outlives a gap, so paths are split at gaps first and the segments are independent."""
    rows = ordered.gap_segments(_rows(spark, sf_dir), ["path"], "t_us", 8 * 3_600_000_000, "id")
    work = phase.Activity(8.0, 2000.0)
    return ordered.streamed(rows, ["path", "segment"], ["t", "id"], ["id", "t", "code"], "path long, segment long, id long, track int, members int", work.start, work.step)
