"""Interval, as-of and nearest joins, bucketed so that rows meet by an equal key and not all against all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.fitting import potentials
from quillon.operators.ordered import streamed
from quillon.operators.pairs import near_pairs  # noqa: F401  an interval join like the others here
from quillon.sources.shared import kept


def _buckets(start: str, end: str, width: int) -> Column:
    return F.explode(F.sequence(F.expr(f"floor({start} / {width})"), F.expr(f"floor({end} / {width})")))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs with equal keys whose half-open intervals overlap.  Intervals go to the buckets of time that they touch; a pair is
    kept in the bucket in which its overlap begins, so it comes once."""
    x = left.withColumn("_b", _buckets(a[0], a[1], width))
    y = right.withColumn("_b", _buckets(b[0], b[1], width))
    begin = F.floor(F.greatest(a[0], b[0]) / F.lit(width))
    return x.join(y, [*keys, "_b"]).where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (begin == F.col("_b"))).drop("_b")


def containing(points: DataFrame, spans: DataFrame, keys: list[str], time: str, span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of a point and a span [start, end] with equal keys that holds it."""
    x = points.withColumn("_b", F.expr(f"floor({time} / {width})"))
    y = spans.withColumn("_b", _buckets(*span, width))
    return x.join(y, [*keys, "_b"]).where((F.col(span[0]) <= F.col(time)) & (F.col(time) <= F.col(span[1]))).drop("_b")


def nearest(points: DataFrame, marks: DataFrame, keys: list[str], time: str, mark_time: str, mark_id: str) -> DataFrame:
    """points with the nearest mark of equal keys, before or after, at most once each: mark_id and distance; ties to the earlier
    mark, then the smaller id; null without a mark.  One ordered pass each way over both tables."""
    names = points.columns
    both = points.select(*keys, F.col(time).alias("_t"), F.struct(*names).alias("_p"), F.lit(None).cast(marks.schema[mark_time].dataType).alias("_mt"), F.lit(None).cast(marks.schema[mark_id].dataType).alias("_mi"))
    both = both.unionByName(marks.select(*keys, F.col(mark_time).alias("_t"), F.lit(None).cast(both.schema["_p"].dataType).alias("_p"), F.col(mark_time).alias("_mt"), F.col(mark_id).alias("_mi")))
    mark = F.when(F.col("_mt").isNotNull(), F.struct("_mt", "_mi"))
    # of marks at one time the smallest id comes last before points and first after them
    back = Window.partitionBy(*keys).orderBy("_t", F.col("_mi").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("_t", F.col("_mi").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumns({"_before": F.last(mark, ignorenulls=True).over(back), "_after": F.first(mark, ignorenulls=True).over(ahead)}).where("_p is not null")
    gap_before, gap_after = F.col("_t") - F.col("_before._mt"), F.col("_after._mt") - F.col("_t")
    use_before = F.col("_after").isNull() | (F.col("_before").isNotNull() & (gap_before <= gap_after))
    chosen = F.when(use_before, F.col("_before")).otherwise(F.col("_after"))
    return found.select("_p.*", chosen["_mi"].alias(mark_id), F.abs(F.col("_t") - chosen["_mt"]).alias("distance"))


def only_cover(points: DataFrame, spans: DataFrame, keys: list[str], time: str, span: tuple[str, str], width: int, ids: list[str], value: str) -> DataFrame:
    """ids (keys and time among them), the value of the only span [start, end] of equal keys that holds the point, and status: found, not_found or ambiguous.

    One join and one grouping: a point has one bucket of time, so a point that no span holds comes out of it without one; repeated points are one.
    """
    x = points.select(*ids).withColumn("_b", F.expr(f"floor({time} / {width})"))
    y = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], *span, value).withColumn("_s", _buckets(*span, width))
    holds = (F.col("_b") == F.col("_s")) & (F.col(span[0]) <= F.col(time)) & (F.col(time) <= F.col(span[1]))
    for k in keys:
        holds = holds & (F.col(k) == F.col(f"_{k}"))
    found = x.join(y, holds, "left").groupBy(*ids).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    status = F.when(F.col("_low").isNull(), "not_found").when(F.col("_low") == F.col("_high"), "found").otherwise("ambiguous")
    return found.select(*ids, F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias(value), status.alias("status"))


def mutual_best(pairs: DataFrame, left: str, right: str, cost: str, rounds: int = 4) -> DataFrame:
    """Greedy one-to-one matching by (cost, left, right), as taking pairs one by one in that order does.

    In a few rounds every pair that is the best of both its sides is taken.  What is left then are chains in which each pair waits for a better one; they fall apart into
    components, whose pairs are read in order by one task each, which knows what has been taken.  Rounds are kept in the checkpoint folder.
    """
    order = F.struct(cost, left, right)
    taken: list[DataFrame] = []
    rest = kept(pairs.select(left, right, cost))
    for _ in range(rounds):
        if rest.isEmpty():
            break
        best = lambda side: rest.groupBy(side).agg(F.min(order).alias("x")).select("x.*")  # noqa: B023, E731
        now = kept(best(left).join(best(right), [left, right, cost]))
        taken.append(now)
        rest = kept(rest.join(now.select(left), left, "left_anti").join(now.select(right), right, "left_anti"))
    if not rest.isEmpty():
        # left and right numbers may be equal: they are nodes of two kinds
        edges = rest.select((F.col(left) * 2).alias("a"), (F.col(right) * 2 + 1).alias("b"), F.lit(0).cast("long").alias("delta"))
        own = potentials(edges).where("node % 2 = 0").select(F.expr("node div 2").alias(left), F.col("root").alias("_root"))
        rows = rest.join(own, left)

        def step(gone, row):
            a, b, c = row
            if ("l", a) in gone or ("r", b) in gone:
                return gone, None
            gone.update((("l", a), ("r", b)))
            return gone, (a, b, c)

        kind = {"bigint": "long"}.get(rest.schema[cost].dataType.simpleString(), rest.schema[cost].dataType.simpleString())
        found = streamed(rows, ["_root"], [cost, left, right], [left, right, cost], f"_root long, {left} long, {right} long, {cost} {kind}", set, step)
        taken.append(kept(found.drop("_root")))
    out = pairs.select(left, right, cost).where("false")
    for now in taken:
        out = out.unionByName(now)
    return out
