"""Set partitions of small groups as growing arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_partitions(groups: DataFrame, size: str, most: int) -> DataFrame:
    """Every partition of each group's ``size`` things: blocks, an array whose entry is the block of each thing, numbered in order of
    their first members.  There are 4140 for eight things, so sizes beyond ``most`` are an error."""
    checked = F.when(F.col(size) <= most, F.col(size)).otherwise(F.raise_error(F.lit(f"more than {most} things")))
    grown = groups.withColumn("_size", checked).where("_size > 0").withColumn("blocks", F.array(F.lit(0)))
    for place in range(1, most):
        more = F.when(F.col("_size") > place, F.sequence(F.lit(0), F.array_max("blocks") + 1)).otherwise(F.array(F.lit(None).cast("int")))
        grown = grown.withColumn("_block", F.explode(more)).withColumn("blocks", F.when(F.col("_block").isNull(), F.col("blocks")).otherwise(F.array_append("blocks", F.col("_block")))).drop("_block")
    return grown.drop("_size")
