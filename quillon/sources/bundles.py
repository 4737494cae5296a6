"""Bundles: data files, and a manifest that is written last.  What no manifest names isn't there; what it names is held against its digest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bundle's manifest: a row for each data file.
MANIFEST = "bundle string, file string, digest string, bytes long"


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """file, digest and bytes of the data files in a folder, read where they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), F.col("length").alias("bytes"))


def stage(rows: DataFrame, store: str) -> str:
    """Writes the rows as a new bundle's data, and gives its name.  Readers don't see it before ``commit``."""
    bundle = uuid.uuid4().hex
    rows.write.parquet(f"{store}/data/{bundle}")
    return bundle


def commit(spark: SparkSession, store: str, bundle: str) -> None:
    """Writes the bundle's manifest, by which it is there."""
    digests(spark, f"{store}/data/{bundle}").select(F.lit(bundle).alias("bundle"), "file", "digest", "bytes").coalesce(1).write.mode("append").parquet(f"{store}/manifests")


def publish(rows: DataFrame, store: str) -> str:
    bundle = stage(rows, store)
    commit(rows.sparkSession, store, bundle)
    return bundle


def inspected(spark: SparkSession, store: str, bundle: str) -> DataFrame:
    """file and status of what the manifest or the folder of a bundle names: ok, digest, missing or unlisted."""
    listed = spark.read.schema(MANIFEST).parquet(f"{store}/manifests").where(F.col("bundle") == bundle).select("file", F.col("digest").alias("want"))
    both = listed.join(digests(spark, f"{store}/data/{bundle}"), "file", "full")
    status = F.when(F.col("want").isNull(), "unlisted").when(F.col("digest").isNull(), "missing").when(F.col("want") != F.col("digest"), "digest").otherwise("ok")
    return both.select("file", status.alias("status"))


def committed(spark: SparkSession, store: str) -> list[str]:
    """The bundles that are there: one name each, which is what a catalogue lists."""
    return sorted(r["bundle"] for r in spark.read.schema(MANIFEST).parquet(f"{store}/manifests").select("bundle").distinct().collect())


def read(spark: SparkSession, store: str, bundle: str) -> DataFrame:
    """A bundle's rows, after its files were held against the manifest; an error names what differs."""
    wrong = inspected(spark, store, bundle).where("status <> 'ok'").orderBy("file").head(5)
    if bundle not in committed(spark, store) or wrong:
        raise ValueError(f"bundle {bundle} can't be read: {[tuple(r) for r in wrong] or 'no manifest'}")
    return spark.read.parquet(f"{store}/data/{bundle}")
