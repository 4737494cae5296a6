"""The test tables in the roles that the operators speak of: observations, sample vectors, sessions and products.

Times are integer microseconds and measured values integer hundredths, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    days = f"datediff(date({column}), date'1970-01-01') * 86400L"
    return F.expr(f"({days} + hour({column}) * 3600 + minute({column}) * 60) * 1000000L + cast(extract(second from {column}) * 1000000 as bigint)")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: id, path (user), kind, t_us, cents and k, the control score of the properties."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("path"),
        F.col("event_type").alias("kind"),
        micros("ts").alias("t_us"),
        F.expr("cast(bround(value * 100, 0) as bigint)").alias("cents"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


#: The same in DuckDB, to be put before an oracle's other WITH parts.
OBSERVATIONS_SQL = """obs AS (
  SELECT event_id AS id, user_id AS path, event_type AS kind, epoch_us(ts) AS t_us, round_even(value * 100, 0)::BIGINT AS cents, json_extract(props, '$.k')::INT AS k FROM events
)"""


def sample_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 32 interleaved pairs of 16-bit numbers, a row for each vector: vec_id, label, and i and q as arrays.  What is asked of one vector needs no
    shuffle in this form; ``samples`` has a row for each sample."""
    part = lambda k: F.expr(f"transform(sequence(0, 31), n -> cast(bround(cast(embedding[2 * n + {k}] as double) * 32767, 0) as bigint))")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", part(0).alias("i"), part(1).alias("q"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 32 interleaved pairs of 16-bit numbers: vec_id, label, n, i, q."""
    whole = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr("transform(embedding, x -> cast(bround(cast(x as double) * 32767, 0) as bigint))").alias("v"))
    return whole.select("vec_id", "label", F.explode(F.expr("transform(sequence(0, 31), n -> struct(n as n, v[2 * n] as i, v[2 * n + 1] as q))")).alias("s")).select("vec_id", "label", "s.n", "s.i", "s.q")


SAMPLES_SQL = """smp AS (
  SELECT vec_id, label, n::INT AS n, round_even(embedding[2 * n + 1]::DOUBLE * 32767, 0)::BIGINT AS i, round_even(embedding[2 * n + 2]::DOUBLE * 32767, 0)::BIGINT AS q
  FROM embeddings, range(32) AS r(n)
)"""
