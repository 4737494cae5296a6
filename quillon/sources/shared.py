"""The shared checkpoint folder of a session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """Leaves spark.checkpoint.dir as the cluster names it; a temporary folder is set only where there is none on one machine, as in tests."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return spark


def kept(frame: DataFrame) -> DataFrame:
    """The same rows, computed once, from a table in the shared folder.

    For rounds: a checkpoint hands on the estimates of the plan behind it, and after a dozen rounds of joins the planner was found standing still over
    them.  A table's estimate is the size of its files, whatever led there.
    """
    spark = ensure_checkpoint_dir(frame.sparkSession)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = held.get() if held.isDefined() else spark.conf.get("spark.checkpoint.dir")
    path = f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
