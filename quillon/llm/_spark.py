"""Shared folders, checkpoints and small bounded collections."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  A temporary one is set only where the session has none and runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="quillon-")
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir(path)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has, underscores put before them where one has."""
    held, out = {c.lower() for c in columns}, []
    for name in names:
        while name in held:
            name = "_" + name
        out.append(name)
    return out


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the checkpoint folder."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def lean(run):
    """``run``, a function for mapInArrow, that gives back between batches and at the end what Arrow holds unused: workers
    are kept for later tasks, and an idle one would go on holding the space of its largest batches."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()

        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                pool.release_unused()

        yield from run(each())
        pool.release_unused()

    return whole


def at_least(frame: DataFrame, count: str, limit: int) -> int:
    """The smallest threshold for which at most ``limit`` rows have ``count`` >= threshold.

    Counts go into bins exact up to 64 and in steps of a sixteenth of an octave beyond, so that what comes to
    the driver is under a thousand rows.
    """
    c = F.col(count)
    octave = F.floor(F.log2(c.cast("double")))
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), octave - 4))
    bins = frame.groupBy((F.floor(c / step) * step).cast("long").alias("bin")).agg(F.count("*").alias("n")).collect()
    threshold, n = max([int(r["bin"]) for r in bins], default=0) + 1, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        n += r["n"]
        if n > limit:
            break
        threshold = int(r["bin"])
    return threshold


def with_columns_apart(frame: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, renamed: extra columns, whatever their names, take no part."""
    return frame.select([F.col(f"`{old}`").alias(new) for new, old in wanted.items()])


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64, copy=False).view(np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
