"""Structured Streaming over observation files: tumbling and session windows with watermarks, and a filter with state by track."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators import filters, fitting
from quillon.sources.tables import micros


def observation_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_at_once: int = 1) -> DataFrame:
    """A stream of the observations in a folder's event files: id, path, kind, cents, t_us and ts, the event time."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", pattern).parquet(folder)
    rows = rows.select(F.col("event_id").alias("id"), F.col("user_id").alias("path"), F.col("event_type").alias("kind"), F.expr("cast(bround(value * 100, 0) as bigint)").alias("cents"), micros("ts").alias("t_us"))
    return rows.withColumn("ts", F.timestamp_micros("t_us"))


def tumbling(stream: DataFrame, width: str, late: str) -> DataFrame:
    found = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return found.select(F.unix_micros("w.start").alias("start_us"), "kind", "n", "cents")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    found = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.count("*").alias("n"))
    return found.select("path", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


#: Process and measurement noise of the filter (values in hundredths, time in hours), and its gate in standard deviations.
PROCESS, MEASUREMENT, GATE = 50.0, 4e6, 3.0
FILTERED = "path long, id long, t_us long, level double, rate double, taken boolean, late boolean"


class TrackFilter(StatefulProcessor):
    """Level and rate of each path by a Kalman filter over its rows in order of (t_us, id).

    Rows wait in the state until the watermark has passed them, so files may come in any order within the allowed lateness.  A row
    that comes after a later one of its path was filtered can't be put in order any more: it is given out at once, without level, and marked late.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.track = handle.getValueState("track", "t long, id long, level double, rate double, a double, b double, c double")
        self.waiting = handle.getListState("waiting", "t long, id long, z double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(t), int(i), float(z)) for frame in rows for t, i, z in zip(frame["t_us"], frame["id"], frame["cents"], strict=True)]
        held = self.track.get()
        last = held[:2] if held else None
        late = sorted(x for x in new if last is not None and x[:2] < last)
        waiting = [tuple(x) for x in self.waiting.get()]
        waiting += [x for x in new if last is None or x[:2] >= last]
        yield from self._passed(key, held, waiting, timerValues.getCurrentWatermarkInMs(), late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._passed(key, self.track.get(), [tuple(x) for x in self.waiting.get()], timerValues.getCurrentWatermarkInMs(), [])

    def _passed(self, key, held: tuple | None, waiting: list[tuple], watermark: int, late: list[tuple]) -> Iterator[pd.DataFrame]:
        """Filters what the watermark has passed, keeps the rest and asks to be called when the watermark reaches the first of it.  Gives a frame only if there are rows:
        paths are many, and most calls for one find nothing to give out."""
        waiting.sort()
        ready = [x for x in waiting if x[0] <= watermark * 1000]
        rest = waiting[len(ready) :]
        out = [(i, t, None, None, None, True) for t, i, _ in late]
        if ready:
            before, state = (held[0], tuple(held[2:])) if held else (ready[0][0], filters.kalman_start(ready[0][2], MEASUREMENT))
            for t, i, z in ready:
                state, taken = filters.kalman_step(state, (t - before) / 3.6e9, z, PROCESS, MEASUREMENT, GATE)
                before = t
                out.append((i, t, state[0], state[1], taken, False))
            self.track.update((ready[-1][0], ready[-1][1], *state))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(watermark + 1, rest[0][0] // 1000 + 1))
        elif ready:
            self.waiting.clear()
        if out:
            ids, times, level, rate, taken, was_late = zip(*out, strict=True)
            yield pd.DataFrame({"path": [key[0]] * len(out), "id": ids, "t_us": times, "level": np.array(level, float), "rate": np.array(rate, float), "taken": np.array(taken, object), "late": np.array(was_late, bool)})

    def close(self) -> None:
        pass


def filtered(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """The filter over a stream of observations; rows that the watermark hasn't passed when a run ends stay in its state for the next."""
    # the grouped rows carry no watermark column: with one, late rows would be dropped before the filter sees them
    rows = stream.withWatermark("ts", late).select("path", "id", "cents", "t_us", F.unix_micros("ts").alias("ts_us"))
    # the worker that sets up the state runs beside the driver and has no archive of this package: what it needs goes by value
    modules = [importlib.import_module(x) for x in (__name__, filters.__name__)]
    for module in modules:
        cloudpickle.register_pickle_by_value(module)
    try:
        return rows.groupBy("path").transformWithStateInPandas(TrackFilter(), FILTERED, "Append", "EventTime")
    finally:
        for module in modules:
            cloudpickle.unregister_pickle_by_value(module)


def filter_in_batch(frame: pd.DataFrame) -> pd.DataFrame:
    """What the filter gives for one path's rows in order."""
    frame = frame.sort_values(["t_us", "id"])
    level, rate, taken = fitting.kalman(frame["t_us"].to_numpy() / 3.6e9, frame["cents"].to_numpy(float), PROCESS, MEASUREMENT, GATE)
    return pd.DataFrame({"path": frame["path"], "id": frame["id"], "level": level, "rate": rate, "taken": taken})


def drained(frame: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there into Parquet files under ``path`` and returns them."""
    spark = frame.sparkSession
    run = frame.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/rows")
