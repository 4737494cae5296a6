"""Operators over ordered rows of a path: runs, peaks, crossings, episodes and hysteresis, as windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.shared import ensure_checkpoint_dir


def _over(keys: list[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def gap_segments(rows: DataFrame, keys: list[str], time: str, gap: int, *tie: str) -> DataFrame:
    """rows with segment: runs split where the time since the row before exceeds the gap."""
    w = _over(keys, time, *tie)
    new = (F.col(time) - F.lag(time).over(w) > gap).cast("int")
    return rows.withColumn("segment", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def best_per_time(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by the given order, which ends in an id."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def local_peaks(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows at least as high as both neighbours and higher than one; beyond the ends lies minus infinity."""
    w = _over(keys, order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    rows = rows.withColumns({"_b": before, "_a": after})
    v = F.col(value)
    at_least = (F.col("_b").isNull() | (v >= F.col("_b"))) & (F.col("_a").isNull() | (v >= F.col("_a")))
    over_one = F.col("_b").isNull() | (v > F.col("_b")) | F.col("_a").isNull() | (v > F.col("_a"))
    return rows.where(at_least & over_one).drop("_b", "_a")


def threshold_intervals(rows: DataFrame, keys: list[str], time: str, value: str, level: int) -> DataFrame:
    """Intervals in which a linearly interpolated value is at least the level: start, end and whether an end is clipped by the data."""
    w = _over(keys, time)
    rows = rows.withColumns({"_up": F.col(value) >= level, "_t0": F.lag(time).over(w), "_v0": F.lag(value).over(w), "_t1": F.lead(time).over(w), "_v1": F.lead(value).over(w)})
    rows = rows.withColumn("_island", F.sum((~F.col("_up")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_up")

    def crossing(t: str, v: str) -> Column:
        share = (F.lit(level) - F.col(v)) / (F.col(value) - F.col(v))
        return F.when(F.col(v).isNull(), F.col(time).cast("double")).otherwise(F.col(t) + share * (F.col(time) - F.col(t)))

    inner = Window.partitionBy(*keys, "_island").orderBy(time)
    whole = Window.partitionBy(*keys, "_island")
    rows = rows.withColumns({"_k": F.row_number().over(inner), "_n": F.count("*").over(whole)})
    first, last = F.col("_k") == 1, F.col("_k") == F.col("_n")
    return rows.groupBy(*keys, "_island").agg(
        F.max(F.when(first, crossing("_t0", "_v0"))).alias("start"),
        F.max(F.when(last, crossing("_t1", "_v1"))).alias("end"),
        F.max(F.when(first, F.col("_v0").isNull())).alias("start_clipped"),
        F.max(F.when(last, F.col("_v1").isNull())).alias("end_clipped"),
        F.count("*").alias("points"),
    ).drop("_island")


def hysteresis(rows: DataFrame, keys: list[str], order: str, value: str, enter: int, leave: int) -> DataFrame:
    """rows with suppressed: on above ``enter``, off below ``leave``, else as before; a null value suppresses at once and leaves the state on."""
    forced = F.when(F.col(value).isNull() | (F.col(value) > enter), True).when(F.col(value) < leave, False)
    state = F.last_value(forced, ignoreNulls=True).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("suppressed", F.coalesce(state, F.lit(False)))


def wrapped(x: Column, period: float | Column = 1.0) -> Column:
    """x less whole periods, in [-period / 2, period / 2)."""
    half = F.lit(period) / 2 if not isinstance(period, Column) else period / 2
    full = F.lit(period) if not isinstance(period, Column) else period
    return F.pmod(x + half, full) - half


def phase_episodes(rows: DataFrame, keys: list[str], time: str, phase: str, rate: Column, gap: int, gate: float) -> DataFrame:
    """rows with innovation (wrapped step less rate times time, in cycles of 1) and episode, which is new after a gap or a failed gate."""
    w = _over(keys, time)
    step = F.col(phase) - F.lag(phase).over(w)
    dt = F.col(time) - F.lag(time).over(w)
    rows = rows.withColumns({"innovation": wrapped(step - rate * dt), "_dt": dt})
    new = ((F.col("_dt") > gap) | (F.abs("innovation") > gate)).cast("int")
    return rows.withColumn("episode", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_dt")


def longest_run(rows: DataFrame, keys: list[str], order: list[str], condition: Column) -> DataFrame:
    """By key the longest stretch of consecutive rows that meet the condition."""
    w = _over(keys, *order)
    rows = rows.withColumns({"_c": condition, "_n": F.row_number().over(w)})
    met = rows.where("_c").withColumn("_g", F.col("_n") - F.row_number().over(w))
    runs = met.groupBy(*keys, "_g").agg(F.count("*").alias("run")).groupBy(*keys).agg(F.max("run").alias("longest_run"))
    return rows.select(*keys).distinct().join(runs, keys, "left").fillna(0, ["longest_run"])


def connected_spans(spans: DataFrame, keys: list[str], start: str, end: str, gap: int, tie: str) -> DataFrame:
    """spans with group: a new one where a span starts more than the gap after all ends before it."""
    w = _over(keys, start, tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col(start) - reach > gap).cast("int")
    return spans.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def ranked_prefix(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, with rank, and source_count and truncated_count of the key."""
    rows = rows.withColumns({"rank": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), "source_count": F.count("*").over(Window.partitionBy(*keys))})
    return rows.where(F.col("rank") <= k).withColumn("truncated_count", F.greatest(F.col("source_count") - k, F.lit(0)))


def decimate_even(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """At most k rows of each key, evenly spaced with both ends: places round(i (n - 1) / (k - 1)), half to even."""
    rows = rows.withColumns({"_i": F.row_number().over(_over(keys, *order)) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    # place p is taken if some i rounds to it: the i nearest to p (k - 1) / (n - 1)
    near = F.expr(f"cast(bround(_i * {k - 1}D / (_n - 1), 0) as bigint)")
    taken = F.lit(False)
    for d in (-1, 0, 1):
        i = near + d
        taken = taken | (i.between(0, k - 1) & (F.bround(i * (F.col("_n") - 1) / F.lit(float(k - 1)), 0) == F.col("_i")))
    return rows.where((F.col("_n") <= k) | taken).drop("_i", "_n")


def decimate_extrema(rows: DataFrame, keys: list[str], order: list[str], value: str, buckets: int) -> DataFrame:
    """First, last, least and greatest row of each of the buckets into which a key's rows fall by place."""
    rows = rows.withColumns({"_i": F.row_number().over(_over(keys, *order)) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    rows = rows.withColumn("bucket", F.expr(f"int(floor(_i * {buckets} / _n))"))
    own = Window.partitionBy(*keys, "bucket")
    up, down = own.orderBy(F.asc(value), "_i"), own.orderBy(F.desc(value), "_i")
    kept = (F.col("_i") == F.min("_i").over(own)) | (F.col("_i") == F.max("_i").over(own))
    rows = rows.withColumn("_keep", kept | (F.row_number().over(up) == 1) | (F.row_number().over(down) == 1))
    return rows.where("_keep").drop("_i", "_n", "_keep")


def streamed(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, start, step) -> DataFrame:
    """A recurrence over each key's rows in order: ``step(state, row)`` gives the new state and a tuple of what comes out (or None), ``start()`` the
    state before a key's first row.

    rows are dealt by key, sorted, and read as a stream: a task holds a batch and one state, however long a key is.  schema: the keys, then
    what comes out.
    """
    fields = [tuple(part.split(" ")) for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            own = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            for key, row in zip(own, zip(*[batch.column(c).to_pylist() for c in columns], strict=True), strict=True):
                if key != held:
                    held, state = key, start()
                state, found = step(state, row)
                if found is not None:
                    out.append((*key, *found))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])

    dealt = rows.select(*dict.fromkeys([*keys, *order, *columns])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def lagged(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the value of the row before, by key and order, however few keys there are: rows are dealt in ranges of (keys, order), and the first of a
    key in a range takes the key's last value of the ranges before.  The dealt rows are kept in the checkpoint folder."""
    ensure_checkpoint_dir(rows.sparkSession)
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    w = Window.partitionBy("_p", *keys).orderBy(*order)
    inside = dealt.withColumns({"_in": F.lag(value).over(w), "_first": F.row_number().over(w) == 1})
    # a row for each key of a range
    lasts = dealt.groupBy("_p", *keys).agg(F.max(F.struct(*order, F.col(value).alias("_value"))).alias("_x"))
    before = F.lag("_x._value").over(Window.partitionBy(*keys).orderBy("_p")).alias("_before")
    return inside.join(lasts.select("_p", *keys, before), ["_p", *keys]).withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_in"))).drop("_p", "_in", "_first", "_before")
