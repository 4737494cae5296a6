"""Sending this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent
_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable by Python workers, once an application; nothing to do where PYTHONPATH has it."""
    app = spark.sparkContext.applicationId
    if app in _SENT or str(_HERE.parent) in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return spark
    folder = tempfile.mkdtemp(prefix="quillon-")  # the driver serves the file from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(_HERE, f"{folder}/root/{_HERE.name}", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{_HERE.name}", "zip", f"{folder}/root"))
    _SENT.add(app)
    return spark
