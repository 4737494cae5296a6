"""Windows of samples that cross the rows of a recording, without one task for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def halo_windows(blocks: DataFrame, receivers: list[str], length: int, every: int, reach: int) -> DataFrame:
    """Windows of so many samples that begin at each multiple of ``every``: stream, start and the receivers' arrays.

    blocks: stream, start, end and an array for each receiver; blocks of a stream don't overlap.  They are dealt in ranges of ``reach`` samples by where they begin; those
    that a window of the range before may still touch go there as well, so samples travel once, and a share of a window and a block over reach twice (a range is
    at least as long as these).  A window with a gap in it, or beyond its stream's end, isn't there: nothing is imputed.
    """
    longest = blocks.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    halo = length + longest
    reach = max(reach, halo)
    own = F.floor(F.col("start") / reach)
    # a window begins in a block that begins in its range
    rows = blocks.select("stream", "start", "end", *receivers, own.alias("_own"), F.explode(F.when(F.col("start") < own * reach + halo, F.array(own - 1, own)).otherwise(F.array(own))).alias("_r"))
    order = Window.partitionBy("stream", "_r").orderBy("start")
    held = order.rangeBetween(0, halo)
    # of what follows a block only what its last window needs
    needed = F.col("end") - 1 + length
    listed = {c: F.collect_list(F.struct("start", F.col(c).alias("x"))).over(held) for c in receivers}
    near = lambda c: F.flatten(F.transform(F.filter(F.col(f"_{c}"), lambda b: b["start"] < F.col("_needed")), lambda b: b["x"]))
    rows = rows.withColumns({"_needed": needed} | {f"_{c}": x for c, x in listed.items()}).where("_r = _own")
    upto = F.aggregate(F.col(f"_{receivers[0]}"), F.col("start"), lambda at, b: F.when(b["start"] == at, at + F.size(b["x"])).otherwise(at))
    rows = rows.select("stream", "start", "end", upto.alias("_upto"), *[near(c).alias(c) for c in receivers])
    begin = (F.ceil(F.col("start") / every) * every).cast("long")
    last = F.least(F.col("end") - 1, F.col("_upto") - length)
    rows = rows.where(begin <= last).withColumn("_at", F.explode(F.sequence(begin, last, F.lit(every).cast("long"))))
    return rows.select("stream", F.col("_at").alias("start"), *[F.slice(c, (F.col("_at") - F.col("start") + 1).cast("int"), F.lit(length)).alias(c) for c in receivers])
