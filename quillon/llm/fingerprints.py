"""Document fingerprints by a homomorphic multiset hash: sums of wide vectors hashed from paragraphs, modulo powers of two.

A text is the multiset of its paragraphs, the parts between its line feeds (an empty part is a paragraph too, so a text is
known up to their order).  A paragraph's vector has two parts:

* ``EXACT`` lanes modulo 2^32, the words of its SHA-256: equal sums mean equal multisets;
* ``LANES`` lanes modulo 2^16: the sum of a +1 or -1 for each pair of words that follow each other in the paragraph (its first word
  is paired with its beginning), the signs being bits of the pair's hash.

A text's fingerprint is the sum of its paragraphs' vectors, lane by lane, as hex digits.  Its order doesn't matter, and
fingerprints can be added (``plus``) and subtracted (``minus``): paragraphs that come or go need no look at the rest.  The
difference of two fingerprints is that of the paragraphs that only one text has, and the squares of its signed lanes estimate
how many pairs of words those have; so ``likeness`` is 1 for equal texts, near 0 for texts without a pair in common, and a half for
texts that share half their pairs (LANES lanes: give or take a tenth).

Columns and SQL functions only.  Texts travel once, to a range of documents in order; fingerprints are made there: pairs are exploded
and summed in the task that holds the text, two lanes to a sum, and no lane is a row.  Where the ranges begin is read off a pass over ids alone.

Defined results: a null text is an empty one, which is one empty paragraph; a null doc_id comes after all others; rows that share a
doc_id go by a hash of their texts, and rows equal in both follow each other, each the next of the one before, all in one task;
the only document is its own next one; extra columns take no part; an empty table gives no rows.  A text with over 2^31 words isn't one
that a row can hold.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, LANES = 8, 128
_HALF = LANES // 2
_HEX = 8 * EXACT + 4 * LANES
#: Ranges of documents for each shuffle partition.
RANGES = 4


# --- fingerprints as columns -------------------------------------------------------------------------------------


def _lanes(fingerprint: Column) -> tuple[Column, Column]:
    def cut(first: int, digits: int, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substring(fingerprint, i * digits + first, F.lit(digits)), 16, 10).cast("bigint"))

    return cut(1, 8, EXACT), cut(8 * EXACT + 1, 4, LANES)


def _printed(exact: Column, lanes: Column) -> Column:
    def hexed(values: Column, digits: int) -> Column:
        return F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), digits, "0")), "")

    return F.lower(F.concat(hexed(exact, 8), hexed(lanes, 4)))


def _joined(a: Column, b: Column, sign: int) -> Column:
    def lane_by_lane(x: Column, y: Column, modulus: int) -> Column:
        return F.zip_with(x, y, lambda p, q: F.pmod(p + sign * q, F.lit(modulus)))

    (ax, al), (bx, bl) = _lanes(a), _lanes(b)
    return _printed(lane_by_lane(ax, bx, 1 << 32), lane_by_lane(al, bl, 1 << 16))


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs together."""
    return _joined(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """What is left of a's fingerprint when b's paragraphs go."""
    return _joined(a, b, -1)


def _signed(x: Column) -> Column:
    """A lane modulo 2^16 as the number nearest to 0."""
    return F.pmod(x + (1 << 15), F.lit(1 << 16)) - (1 << 15)


def _square(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x * x)


def _alike(same: Column, a: Column, b: Column) -> Column:
    """Share of the pairs of words of both texts that isn't in the difference, from the lanes as arrays."""
    apart = _square(F.zip_with(a, b, lambda x, y: _signed(x - y)))
    both = _square(F.transform(a, _signed)) + _square(F.transform(b, _signed))
    return F.when(same, 1.0).when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / both))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints, estimated from their difference."""
    return _alike(a == b, _lanes(a)[1], _lanes(b)[1])


# --- vectors of texts --------------------------------------------------------------------------------------------


def _exact(text: Column) -> Column:
    """The exact lanes of a text: sums of the words of its paragraphs' SHA-256."""
    digests = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p.cast("binary"), 256))
    word = lambda d, k: F.conv(F.substring(d, F.lit(1 + 8 * k), F.lit(8)), 16, 10).cast("bigint")
    zero = F.array(*[F.lit(0).cast("bigint")] * EXACT)
    return F.aggregate(digests, zero, lambda a, d: F.array(*[(F.get(a, F.lit(k)) + word(d, k)) % (1 << 32) for k in range(EXACT)]))


def _pairs(text: Column) -> Column:
    """A hash of each word (runs without ASCII white space) and the word before it in its paragraph."""
    words = F.transform(F.split(text, "\n", -1), lambda p: F.array_remove(F.split(p, "[ \\t\\x0B\\f\\r]+"), ""))
    return F.flatten(F.transform(words, lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.coalesce(F.get(ws, i - 1), F.lit(""))))))


def _summed(texts: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """keys, carried, exact and lanes (arrays of long) of each row of texts (column text); rows are told apart by keys.

    The rows must be dealt by some of the keys, and aren't dealt again.  Carried columns are numbers.
    """
    kept = [*keys, *carried]
    exact = [f"_x{k}" for k in range(EXACT)]
    rows = texts.withColumn("_x", _exact(F.col("text"))).select(*kept, *[F.get("_x", F.lit(k)).alias(x) for k, x in enumerate(exact)], F.explode_outer(_pairs(F.col("text"))).alias("_h"))
    rows = rows.withColumn("_g", F.xxhash64("_h"))
    bit = lambda c, k: F.shiftrightunsigned(c, k).bitwiseAND(1)
    # two lanes of 31 bits in a sum: no text has so many words that they meet
    pair = lambda k: F.when(F.col("_h").isNotNull(), bit("_h", k) + F.shiftleft(bit("_g", k), 31))
    total = rows.groupBy(*keys).agg(F.count("_h").alias("_n"), *[F.max(c).alias(c) for c in [*carried, *exact]], *[F.coalesce(F.sum(pair(k)), F.lit(0)).alias(f"_s{k}") for k in range(_HALF)])
    ones = [F.col(f"_s{k}").bitwiseAND((1 << 31) - 1) for k in range(_HALF)] + [F.shiftright(F.col(f"_s{k}"), 31) for k in range(_HALF)]
    lanes = F.transform(F.array(*ones), lambda x: F.pmod(2 * x - F.col("_n"), F.lit(1 << 16)))
    return total.select(*kept, F.array(*exact).alias("exact"), lanes.alias("lanes"))


def fingerprint(texts: DataFrame, key: str) -> DataFrame:
    """key and fingerprint of texts (columns key, text); rows with one key are taken as parts of one text, whose fingerprints add up."""
    # a row of its own for each part, so that what is carried is the part's
    part = F.xxhash64("text")
    parts = texts.select(F.col(key).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts.groupBy("_key", "text").agg(F.count("*").alias("_copies")).withColumn("_part", part)
    summed = _summed(parts, ["_key", "_part"], ["_copies"])
    times = lambda name, n, m: [(F.sum(F.get(name, F.lit(k)) * F.col("_copies")) % m).alias(f"{name}{k}") for k in range(n)]
    total = summed.groupBy("_key").agg(*times("exact", EXACT, 1 << 32), *times("lanes", LANES, 1 << 16))
    return total.select(F.col("_key").alias(key), _printed(F.array(*[f"exact{k}" for k in range(EXACT)]), F.array(*[f"lanes{k}" for k in range(LANES)])).alias("fingerprint"))


# --- documents beside their edited texts -------------------------------------------------------------------------


def _place() -> Column:
    """A document's place: doc_id, null last, then a hash of its text."""
    return F.struct(F.col("doc_id").isNull().cast("int").alias("z"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("d"), F.xxhash64("text").alias("h"))


def _bounds(documents: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """The first place of each of about so many ranges of documents, equal in number: at most ``ranges`` triples come to the driver."""
    places = documents.select(_place().alias("p")).repartitionByRange(ranges, "p")
    first = places.groupBy(F.spark_partition_id().alias("r")).agg(F.min("p").alias("p"))
    return sorted((r["p"]["z"], r["p"]["d"], r["p"]["h"]) for r in first.collect())


def compare(documents: DataFrame) -> DataFrame:
    """Of each row of documents (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's,
    by doc_id; after the last comes the first.
    """
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = documents.sparkSession
    bounds = _bounds(documents, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = max(1, len(bounds))
    known = F.from_json(F.lit(json.dumps([dict(zip("zdh", b, strict=True)) for b in bounds])), "array<struct<z:int,d:bigint,h:bigint>>")
    # the last range that begins at or before a place, by halving
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step) <= F.col("p"), at + step).otherwise(at))
    rows = documents.withColumn("p", _place()).withColumn("r", found)
    # a range's first document follows the range before it, too
    one = lambda r, extra: F.struct(r.cast("int").alias("r"), F.lit(extra).alias("extra"))
    dealt = F.when(F.get(known, F.col("r")) == F.col("p"), F.array(one(F.col("r"), 0), one((F.col("r") + (n - 1)) % n, 1))).otherwise(F.array(one(F.col("r"), 0)))
    rows = rows.select("doc_id", "text", "p", F.explode(dealt).alias("x")).select("x.r", "x.extra", "p", "doc_id", "text")

    order = Window.partitionBy("r").orderBy("extra", "p")
    rows = rows.select("r", F.row_number().over(order).alias("at"), "extra", "doc_id", "text", F.lead("text").over(order).alias("next"))
    half = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), half - F.floor(half / 2).cast("int")), F.substring("next", F.lit(1), F.floor(half / 2).cast("int")))
    rows = rows.withColumn("edited", edited)
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    words = [F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("bigint").alias(f"sha{k}") for k in range(4)]
    both = F.explode(F.when(F.col("extra") == 0, F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).otherwise(F.array(F.struct(F.lit(0).alias("kind"), "text"))))
    carried = ["extra", "doc_id", "n_chars", *[f"sha{k}" for k in range(4)]]
    texts = rows.select("r", "at", "extra", "doc_id", half.cast("bigint").alias("n_chars"), *words, both.alias("y")).select("r", "at", "y.kind", *carried, "y.text")

    sums = _summed(texts, ["r", "at", "kind"], carried)
    order = Window.partitionBy("r").orderBy("at", "kind")
    for name in ("exact", "lanes"):
        sums = sums.withColumns({f"e_{name}": F.lead(name, 1).over(order), f"n_{name}": F.lead(name, 2).over(order)})
    sums = sums.where("kind = 0 and extra = 0")
    same = lambda side: (F.col("exact") == F.col(f"{side}_exact")) & (F.col("lanes") == F.col(f"{side}_lanes"))
    return sums.select(
        "doc_id",
        "n_chars",
        F.lower(F.concat(*[F.lpad(F.hex(f"sha{k}"), 16, "0") for k in range(4)])).alias("edited_sha256"),
        _printed(F.col("exact"), F.col("lanes")).alias("fingerprint"),
        _printed(F.col("e_exact"), F.col("e_lanes")).alias("edited_fingerprint"),
        _alike(same("e"), F.col("lanes"), F.col("e_lanes")).alias("near_edited"),
        _alike(same("n"), F.col("lanes"), F.col("n_lanes")).alias("near_next"),
    )
