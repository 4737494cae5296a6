"""Pairs of rows that lie near each other in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, reach: int) -> DataFrame:
    """Pairs with equal keys and 0 < y - x <= reach: a right row is found from its own bucket and the one before."""
    a = left.withColumn("_b", F.expr(f"floor({x} / {reach})"))
    b = right.withColumn("_b", F.explode(F.array(F.expr(f"floor({y} / {reach})"), F.expr(f"floor({y} / {reach}) - 1"))))
    return a.join(b, [*keys, "_b"]).where((F.col(y) > F.col(x)) & (F.col(y) - F.col(x) <= reach)).drop("_b")
