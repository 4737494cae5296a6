"""Mixing sources to target weights by Poisson replication; DataFrame functions only.

A source with weight w gets the share w of the bytes of the mixture.  Its mean repetition rate is what it should
have over what it has, and each of its documents is repeated as often as the Poisson distribution of that mean
says for the document's own uniform number, which is the hash of seed and doc_id: the count is the number of
steps of the distribution's sum that lie at or below it.  Copies are then dealt out and ordered by the hash of seed,
doc_id and copy, over all partitions.

Without weights, sources weigh as the square root of their bytes, and the mixture has as many bytes as the input.

A small source among large ones has a large mean: with default weights it grows as the square root of the input.
Means beyond ``MOST_RATE`` take part like all others.  Their sums begin 12 standard deviations below the mean (what lies
below is under 2^-60), so that a source's table grows as the square root of its mean.

Rates make a row for each source; they go to all tasks if their measured size is under ``BROADCAST_BYTES``, else
both sides are dealt over ``SALTS`` salts.

Defined results: a null source is a source of its own; a source whose weight is 0 or missing from given weights, or
that has no bytes, gets no copies; null text has no bytes but its document is repeated as others of its source;
rows that repeat a doc_id get equal counts; other columns stay (copy and order_key get an underscore in front where documents have such columns); an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._spark import cut, fresh

#: Up to this mean the distribution's sums begin at 0; beyond it, 12 standard deviations below the mean.  A given total_bytes
#: that asks for more of a source is refused.
MOST_RATE = 500.0
BROADCAST_BYTES, SALTS = 8 << 20, 32
_NULL = "\u0000null"


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(_NULL))


def uniform(seed: int, *parts: Column) -> Column:
    """52 bits of a hash, as a number in [0, 1)."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(documents: DataFrame, weights: dict[str, float] | None = None, total_bytes: float | None = None) -> DataFrame:
    """source and its mean repetition rate."""
    have = documents.groupBy(_source().alias("src")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("bytes"))
    if weights is None:
        weighed = have.withColumn("w", F.sqrt(F.col("bytes").cast("double")))
    else:
        if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
            raise ValueError("weights must not be negative, and some must be positive")
        known = documents.sparkSession.createDataFrame([(k if k is not None else _NULL, float(v)) for k, v in weights.items()], "src string, w double")
        weighed = have.join(F.broadcast(known), "src", "left").fillna(0.0, ["w"])
    weighed = cut(weighed)
    sums = weighed.agg(F.sum("bytes").cast("double").alias("bytes"), F.sum("w").alias("w")).first()
    total = float((sums["bytes"] or 0.0) if total_bytes is None else total_bytes)
    rate = F.when((F.col("bytes") > 0) & (F.col("w") > 0), F.col("w") / F.lit(float(sums["w"] or 1.0)) * F.lit(total) / F.col("bytes")).otherwise(0.0)
    return weighed.select("src", rate.alias("rate"))


def steps(rate: Column) -> Column:
    """The distribution's sums P(X <= 0), P(X <= 1), ..., far enough that what is left over is below 2^-60."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    logs = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double"))))
    terms = F.transform(logs, lambda x, k: F.exp(k * F.log(rate) - rate - x))
    sums = F.transform(F.sequence(F.lit(1), last + 1), lambda n: F.aggregate(F.slice(terms, 1, n), F.lit(0.0), lambda s, x: s + x))
    return F.when(rate > 0, sums).otherwise(F.array(F.lit(1.0)))


def far_steps(table: DataFrame) -> DataFrame:
    """src, first and steps of sources (src, rate) with rates beyond MOST_RATE: P(first <= X <= k) for k = first, first + 1, ..."""
    rate, k = F.col("rate"), F.col("k").cast("double")
    reach = 12 * F.sqrt(rate) + 20
    rows = table.select("src", "rate", F.floor(rate - reach).cast("int").alias("first"), F.ceil(rate + reach).cast("int").alias("last"))
    rows = rows.select("src", "rate", "first", F.explode(F.sequence("first", "last")).alias("k"))
    # Stirling's series: k is over 200 here, where what it leaves out is below 2^-60
    log = k * F.log1p((rate - k) / k) + k - rate - 0.5 * F.log(2 * math.pi * k) - 1 / (12 * k) + 1 / (360 * k * k * k) - 1 / (1260 * F.pow(k, F.lit(5.0)))
    upto = Window.partitionBy("src").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.sum(F.exp(log)).over(upto))
    # sums never fall, so their order is that of k
    return rows.groupBy("src", "first").agg(F.sort_array(F.collect_list("s")).alias("steps"))


def replicate(documents: DataFrame, weights: dict[str, float] | None = None, seed: int = 1, total_bytes: float | None = None, keep_keys: bool = True) -> DataFrame:
    """documents, each row as often as its source's rate and its hash say, dealt out at random; with keep_keys also copy (from 0) and order_key, or the same
    with an underscore in front where documents have such a column.
    """
    rated = rates(documents, weights, total_bytes)
    near = F.when(F.col("rate") <= MOST_RATE, steps(F.col("rate")))
    table = cut(rated.select("src", "rate", F.lit(0).alias("first"), near.alias("steps")))
    most = table.agg(F.max("rate").alias("most")).first()["most"] or 0.0
    if most > MOST_RATE:
        if total_bytes is not None:
            raise ValueError(f"a source would be repeated {most:.0f} times on average; with total_bytes at most {MOST_RATE:.0f} is allowed")
        table = cut(table.where(F.col("rate") <= MOST_RATE).select("src", "first", "steps").union(far_steps(table.where(F.col("rate") > MOST_RATE))))
    size = table.agg(F.sum(8 * F.size("steps")).alias("bytes")).first()
    table = table.select("src", "first", "steps")
    names = documents.columns
    copy, order = fresh(names, "copy", "order_key")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _source().alias("src"), uniform(seed, F.col("doc_id")).alias("u"))
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(table), "src")
    else:  # dealt over salts, for one source may hold a third of all rows
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("salt", salt).join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["src", "salt"])
    rows = rows.withColumn("count", F.col("first") + F.size(F.filter("steps", lambda x: x <= F.col("u"))))
    rows = rows.where("count > 0").select("row", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    key = F.md5(F.concat_ws("/", F.lit(f"{seed}o"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")), F.col("copy").cast("string")))
    dealt = rows.withColumn("order_key", key).repartition("order_key").sortWithinPartitions("order_key")
    return dealt.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *([F.col("copy").alias(copy), F.col("order_key").alias(order)] if keep_keys else []))


#: DuckDB's counterpart of replicate(documents) with the default weights and seed.
ORACLE = """
WITH have AS (
  SELECT coalesce(source, chr(1) || 'null') AS src, sum(coalesce(strlen(text), 0)) AS bytes FROM documents GROUP BY 1
), rated AS (
  SELECT src, CASE WHEN bytes > 0 THEN sqrt(bytes::DOUBLE) / sum(sqrt(bytes::DOUBLE)) OVER () * (sum(bytes) OVER ())::DOUBLE / bytes ELSE 0.0 END AS rate FROM have
), terms AS (
  SELECT src, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rated, generate_series(0, 200) AS g(k) WHERE rate > 0 AND k <= ceil(rate + 12 * sqrt(rate) + 20)
), sums AS (
  SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS s FROM terms
), drawn AS (
  SELECT d.*, coalesce(source, chr(1) || 'null') AS src, ('0x' || substr(md5('1/' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents d
), counted AS (
  SELECT drawn.doc_id, drawn.text, drawn.lang, drawn.source, drawn.n_chars, (SELECT count(*) FROM sums WHERE sums.src = drawn.src AND s <= u) AS n FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, c::INTEGER AS copy, md5('1o/' || coalesce(doc_id::VARCHAR, 'null') || '/' || c::VARCHAR) AS order_key
FROM (SELECT *, unnest(range(n)) AS c FROM counted WHERE n > 0)
"""
