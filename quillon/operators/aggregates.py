"""Aggregate gates and statistics: power, quality, robust location, transitions, exact and normal bounds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

FULL_SCALE = 32768
#: Fixed value: the 0.95 quantile of the normal distribution.
Z_95 = 1.6448536269514722


def decibels(x: Column, floor: float | None = None) -> Column:
    """10 log10 of a positive number; null otherwise, or the floor if there is one."""
    value = F.when(x > 0, 10 * F.log10(x))
    return value if floor is None else F.coalesce(F.greatest(value, F.lit(floor)), F.lit(floor))


def power(total: Column, count: Column) -> dict[str, Column]:
    """Linear, decibel and rms power of an exact sum of I^2 + Q^2; null without samples, decibels null without power."""
    mean = F.when(count > 0, total / (count * float(FULL_SCALE**2)))
    return {"mean_power": mean, "power_db": decibels(mean), "rms": F.sqrt(mean)}


def dense_windows(rows: DataFrame, key: str, time: str, width: int) -> DataFrame:
    """Every window of each key from its first to its last row, (key, window); a key has as many as its span."""
    spans = rows.groupBy(key).agg(F.expr(f"min({time} div {width})").alias("_a"), F.expr(f"max({time} div {width})").alias("_b"))
    return spans.select(key, F.explode(F.sequence("_a", "_b")).alias("window"))


def wilson_lower(successes: Column, trials: Column, z: float = Z_95) -> Column:
    """One-sided lower bound of a share; null without trials."""
    p = successes / trials
    centre = p + z * z / (2 * trials)
    spread = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    return F.when(trials > 0, F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / trials)))


def t_quantile(z: float, freedom: Column) -> Column:
    """Student's t at the share whose normal quantile is z, by Fisher's expansion in 1 / freedom; within 1e-4 of the exact one from 5 degrees
    of freedom on, within 1e-6 from 12."""
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    some = F.when(freedom > 0, freedom)  # without a degree of freedom there is no quantile
    return sum((F.lit(x) / F.pow(some, F.lit(float(k))) for k, x in enumerate(terms, 1)), F.lit(z))


def median_by(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """median, mad (median absolute deviation) and n of each key, exactly."""
    centre = rows.groupBy(*keys).agg(F.median(value).alias("median"), F.count(value).alias("n"))
    off = rows.join(centre, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return centre.join(off, keys)


def rank_by_class(case: dict[str, int], column: str) -> Column:
    return F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in case.items()])


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray, log_beta: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (modified Lentz), on the side where that converges fast."""
    flip = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 20_000):
        step = np.ones_like(y)
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            step *= d * c
            h *= d * c
        if np.abs(step - 1).max(initial=0.0) < 1e-15:
            break
    front = np.exp(p * np.log(y) + q * np.log1p(-y) - log_beta) / p
    return np.where(flip, 1 - front * h, front * h)


def exact_lower_bounds(k: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """Exact lower bounds of binomial shares: the share at which k or more successes of n have probability alpha, by halving; 0 without
    successes, NaN without trials.  The cost follows the number of shares, and hardly the trials."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    some = (k > 0) & (n > 0)
    a, b = np.where(some, k, 1.0), np.where(some, n - k + 1, 1.0)
    logs = np.array([math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q) for p, q in zip(a, b, strict=True)])
    low, high = np.zeros(len(k)), np.ones(len(k))
    for _ in range(60):
        middle = (low + high) / 2
        less = beta_share(middle, a, b, logs) < alpha
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return np.where(n > 0, np.where(some, (low + high) / 2, 0.0), np.nan)


def clopper_pearson_lower(k: int, n: int, alpha: float = 0.05) -> float:
    """The bound of one share."""
    return float(exact_lower_bounds(np.array([k]), np.array([n]), alpha)[0])


@F.pandas_udf(DoubleType())
def exact_lower(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(exact_lower_bounds(k.to_numpy(), n.to_numpy()))


def transitions(rows: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """Counts of the four combinations of two flags by key."""
    pairs = {"kept": before & after, "lost": before & ~after, "gained": ~before & after, "absent": ~before & ~after}
    return rows.groupBy(*keys).agg(*[F.count_if(v).alias(k) for k, v in pairs.items()])


def quantile_higher(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The least value at whose place, or after it, at most (1 - share) of the others lie: method 'higher'.

    From counts of values, which start in the tasks, in two steps: ranges of values first, then the values of the range in which the
    place lies; so no task sorts a key's rows.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    total = total.withColumn("_place", F.ceil((F.col("_n") - 1) * F.lit(share)))
    # 1024 ranges a key; sorting them, and then one range's values, is bounded by the values' number over 1024
    step = F.greatest((F.col("_high") - F.col("_low")) / 1023.0, F.lit(1e-300))
    ranged = counts.join(total, keys).withColumn("_range", F.floor((F.col(value) - F.col("_low")) / step))
    ranges = ranged.groupBy(*keys, "_range", "_place").agg(F.sum("_c").alias("_r"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("_upto", F.sum("_r").over(upto))
    own = ranges.where((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_r") <= F.col("_place"))).select(*keys, "_range", (F.col("_upto") - F.col("_r")).alias("_before"))
    inside = ranged.join(own, [*keys, "_range"])
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return inside.where((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_c") <= F.col("_place"))).select(*keys, F.col(value).alias("quantile"), F.col("_n").alias("n"))
