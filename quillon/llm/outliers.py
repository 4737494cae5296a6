"""Quality rules: fixed limits, then robust multivariate outliers by the minimum covariance determinant.

DataFrame and SQL functions only.  One pass over the texts makes a row of counts for each document; everything
after it works on those rows.

The statistics vector of a document is (log of words, log of the mean word length, log of the share of symbols, shares
of repeated lines and of words in repeated windows), in units of 1/``UNIT``, as integers: sums of integers don't depend on the order in
which tasks add them, so neither does a verdict.

For each language and source the estimate has three starts: the rows nearest to the coordinates' medians in units
of their absolute deviations; those nearest to the medians in units of the least spreads; and a share drawn by a hash.
Each takes ``FIRST_STEPS`` concentration steps: mean and covariance of the subset, Mahalanobis distances of all, and as the next
subset the ``SUPPORT`` share of rows with the least distances.  The start whose determinant is least then goes on alone, until no group's
determinant falls any more; a step that doesn't lower it isn't taken, so this ends.  Steps see each different vector once, with the
number of its rows: vectors are integers of a few thousand values at most, so their number grows more slowly than the input.  A subset's edge is read off a
histogram of distances with fixed bins, so no task holds a group, and rows in the edge's bin all belong.  Groups with
fewer than ``LEAST_ROWS`` rows share one estimate for their language, and if these are too few as well, nothing in
them is rejected.  The pivots of the covariance's Cholesky factor have ``LEAST_SPREAD`` as a floor.

Fits are a row a group.  They are sent to all tasks if there are at most ``FEW_GROUPS`` groups, and else joined with
both sides dealt over ``SALTS`` salts, so that no group's rows come to one task either way.

A document is rejected beyond the cutoff of the squared distance, scaled so that the median distance of its group
is the median of the chi-square distribution, which makes up for the truncation of the subset.

n_repeat_words compares windows of three words by 64-bit hashes: two different windows of one text pass for equal
about once in 2^64 pairs.

Defined results: null or empty text has no words and fails the fixed limits; a null language or source is a group
of its own; repeated rows are judged each; a null doc_id stays null; other columns take no part; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._spark import cut

UNIT = 256
SUPPORT = 0.75
FIRST_STEPS = 2
LEAST_ROWS = 50
FEW_GROUPS, SALTS = 20_000, 32
#: 1 - 1e-9 quantile and median of chi-square with five degrees of freedom.
CHI2_FAR, CHI2_MEDIAN = 52.05, 4.351
_NAMES = ("z0", "z1", "z2", "z3", "z4")
#: Least standard deviations of the coordinates (z0, z2: nats, z1: quarter nats, z3, z4: shares).  Most texts have no symbols or
#: repetitions at all, and a group in which a share is always 0 must not make an outlier of every text that has one.  Every
#: coordinate can reject by itself: z4 within the fixed limit of 0.5, as a group's
#: scale goes up to fourfold; z0 only at many orders of magnitude, for length is no fault.
LEAST_SPREAD = (1.5, 0.35, 0.25, 0.12, 0.1)
_BINS_A_NAT = 32
_SMALL = 64


def base_statistics(documents: DataFrame) -> DataFrame:
    """The counts of each document; words are runs without ASCII white space."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    rows = rows.withColumn("words", F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != '')"))
    rows = rows.withColumn("lines", F.expr(r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    rows = rows.withColumn("w3", F.expr("if(size(words) < 3, array(), transform(slice(words, 3, size(words)), (w, i) -> xxhash64(words[i], words[i + 1], w)))"))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "w3",
        F.expr("if(size(array_distinct(w3)) = size(w3), cast(array() as array<bigint>), sort_array(w3))").alias("in_order"),
    )
    # a few recurring windows are looked for one by one; many are found by sorting (hash, place) pairs
    rows = rows.withColumn("again", F.expr("array_distinct(filter(in_order, (x, k) -> k > 0 and x = in_order[k - 1]))")).drop("in_order")
    pairs = "if(size(again) <= {n}, array(), sort_array(transform(w3, (x, i) -> struct(x, i))))".format(n=_SMALL)
    rows = rows.withColumn("pairs", F.expr(pairs))
    few = "filter(transform(w3, (x, i) -> if(array_contains(again, x), i, -1)), i -> i >= 0)"
    many = (
        "sort_array(transform(filter(pairs, (p, k) -> (k > 0 and p.x = pairs[k - 1].x) or (k + 1 < size(pairs) and p.x = pairs[k + 1].x)), p -> p.i))"
    )
    rows = rows.withColumn("at", F.expr(f"case when size(again) = 0 then array() when size(again) <= {_SMALL} then {few} else {many} end"))
    covered = "aggregate(at, named_struct('n', 0L, 'last', -3), (s, i) -> named_struct('n', s.n + least(3, i - s.last), 'last', i), s -> s.n)"
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).alias("n_repeat_words"))


def _log_unit(x: Column) -> Column:
    return F.round(F.log(x) * UNIT).cast("long")


def _vectors(rows: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return rows.withColumns(
        {
            "z0": _log_unit(n),
            "z1": F.round(F.log1p(F.col("word_chars") / n) * (4 * UNIT)).cast("long"),
            "z2": _log_unit(0.02 + F.least(F.lit(1.0), F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)))),
            "z3": F.round(F.least(F.lit(1.0), F.col("n_dup_lines") * 8 / n) * UNIT).cast("long"),
            "z4": F.round(F.col("n_repeat_words") / n * UNIT).cast("long"),
        }
    )


def _meet(rows: DataFrame, table: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """rows joined with a table that has a row for each group: sent to all tasks if groups are few, else dealt over salts."""
    if few:
        return rows.join(F.broadcast(table), keys)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    wide = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(wide, [*keys, "_salt"]).drop("_salt")


def _medians(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Exact lower medians of integer columns by group, from counts of values; w: how often a row is there."""
    long = rows.select("g", "w", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("long").alias("v")) for k, v in columns.items()])).alias("x"))
    counts = long.groupBy("g", "x.k", "x.v").agg(F.sum("w").alias("n"))
    w = Window.partitionBy("g", "k")
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    found = run.where("2 * upto >= all").groupBy("g", "k").agg(F.min("v").alias("v"))
    return found.groupBy("g").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in columns])


def _cholesky(cov: list[list[Column]], names: str) -> list[tuple[str, Column]]:
    """Columns names00, names10, ... of the lower Cholesky factor, each in terms of those before it; pivots have a floor."""
    out = []
    for i in range(len(cov)):
        for j in range(i + 1):
            x = cov[i][j]
            for k in range(j):
                x = x - F.col(f"{names}{i}{k}") * F.col(f"{names}{j}{k}")
            out.append((f"{names}{i}{j}", F.sqrt(F.greatest(x, F.lit((UNIT * LEAST_SPREAD[i]) ** 2))) if i == j else x / F.col(f"{names}{j}{j}")))
    return out


_D = len(_NAMES)
_FIT = [*[f"m{i}" for i in range(_D)], *[f"l{i}{j}" for i in range(_D) for j in range(i + 1)]]


def _fit(subset: DataFrame, keys: list[str]) -> DataFrame:
    """By group: means m0.., the Cholesky factor l00, l10, ... of the covariance, and logdet; w: how often a row is there."""
    sums = [F.sum(F.col("w") * F.col(x)).alias(f"s{i}") for i, x in enumerate(_NAMES)]
    sums += [F.sum(F.col("w") * F.col(_NAMES[i]) * F.col(_NAMES[j])).alias(f"p{i}{j}") for i in range(_D) for j in range(i + 1)]
    out = subset.groupBy(*keys).agg(F.sum("w").cast("double").alias("n"), *sums)
    out = out.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(_D)})
    cov = [[F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") for j in range(i + 1)] for i in range(_D)]
    for name, x in _cholesky(cov, "l"):
        out = out.withColumn(name, x)
    return out.select(*keys, *_FIT, sum((F.log(f"l{i}{i}") for i in range(1, _D)), F.log("l00")).alias("logdet"))


def _distances(rows: DataFrame, fit: DataFrame, few: bool) -> DataFrame:
    """Rows with d2, their squared Mahalanobis distance under each of their group's fits, and what else the fits have."""
    out = _meet(rows, fit, ["g"], few)
    for i in range(_D):
        x = F.col(_NAMES[i]) - F.col(f"m{i}")
        for k in range(i):
            x = x - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", x / F.col(f"l{i}{i}"))
    total = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, _D)), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", total).drop(*_FIT, *[f"y{i}" for i in range(_D)])


def _bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1e-3) * _BINS_A_NAT).cast("int")


def _edges(rows: DataFrame, keys: list[str], share: float) -> DataFrame:
    """By group the first bin of d2 at which at least this share of the rows lies in it or below; w: how often a row is there."""
    counts = rows.groupBy(*keys, _bin(F.col("d2")).alias("bin")).agg(F.sum("w").alias("n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return run.where(F.col("upto") >= share * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("edge"))


def _nearest(rows: DataFrame, few: bool) -> DataFrame:
    """Fits of the subsets of rows (g, start, d2) with the least d2."""
    near = _meet(rows, _edges(rows, ["g", "start"], SUPPORT), ["g", "start"], few).where(_bin(F.col("d2")) <= F.col("edge"))
    return cut(_fit(near, ["g", "start"]))


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """rows, once for each start, with d2 as its measure of nearness."""
    centre = cut(_medians(rows, {x: F.col(x) for x in _NAMES}).select("g", *[F.col(x).alias(f"c{x}") for x in _NAMES]))
    off = _meet(rows, centre, ["g"], few)
    spread = cut(_medians(off, {x: F.abs(F.col(x) - F.col(f"c{x}")) for x in _NAMES}).select("g", *[F.col(x).alias(f"a{x}") for x in _NAMES]))
    off = _meet(off, spread, ["g"], few)

    def far(unit) -> Column:
        return sum((F.pow((F.col(x) - F.col(f"c{x}")) / unit(x, UNIT * least), F.lit(2.0)) for x, least in zip(_NAMES, LEAST_SPREAD, strict=True)), F.lit(0.0))

    kinds = [far(lambda x, least: F.greatest(1.4826 * F.col(f"a{x}"), F.lit(least))), far(lambda x, least: F.lit(least)), F.pmod(F.xxhash64(*_NAMES), F.lit(1 << 20)) + 1.0]
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), d2.alias("d2")) for i, d2 in enumerate(kinds)]))
    return off.select("g", "w", *_NAMES, every.alias("x")).select("g", "w", *_NAMES, "x.*")


def least_fits(rows: DataFrame, few: bool) -> DataFrame:
    """By group the minimum-covariance-determinant estimate of rows (g and z0..)."""
    vectors = cut(rows.groupBy("g", *_NAMES).agg(F.count("*").alias("w")))
    fits = _nearest(_starts(vectors, few), few)
    for _ in range(FIRST_STEPS - 1):
        fits = _nearest(_distances(vectors, fits.drop("logdet"), few), few)
    fits = cut(fits.groupBy("g").agg(F.min_by(F.struct("start", *_FIT, "logdet"), F.struct("logdet", "start")).alias("x")).select("g", "x.*"))
    going = fits
    while True:
        own = vectors if going is fits else _meet(vectors, going.select("g"), ["g"], few)
        new = _nearest(_distances(own, going.drop("logdet"), few), few)
        going = cut(new.join(going.select("g", F.col("logdet").alias("before")), "g").where("logdet < before - 1e-9").drop("before"))
        if going.isEmpty():
            return cut(fits.select("g", *_FIT))
        fits = cut(fits.join(going.select("g"), "g", "left_anti").unionByName(going))


def robust_distances(rows: DataFrame, few: bool = True) -> DataFrame:
    """rows (with g and z0..) and d2 under the estimate of their group, scaled to the chi-square median."""
    far = _distances(rows, least_fits(rows, few), few).withColumn("w", F.lit(1))
    middle = cut(_edges(far, ["g"], 0.5).select("g", F.exp((F.col("edge") + 1) / F.lit(float(_BINS_A_NAT))).alias("middle")))
    return _meet(far, middle, ["g"], few).withColumn("d2", F.col("d2") * CHI2_MEDIAN / F.greatest(F.col("middle"), F.lit(CHI2_MEDIAN / 4))).drop("middle", "w")


def quality(documents: DataFrame, cutoff: float = CHI2_FAR, few_groups: int = FEW_GROUPS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the distance d2 that decided."""
    rows = _vectors(base_statistics(documents)).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    rows = cut(rows)
    sound = rows.where("not base_failed")
    counts = sound.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    own = F.col("rows") >= LEAST_ROWS
    group = F.struct(F.col("lang"), F.when(own, F.col("source")).alias("source"), own.alias("own"))
    grouped = counts.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), group.alias("g"), "rows")
    large = grouped.groupBy("g").agg(F.sum("rows").alias("all")).where(F.col("all") >= LEAST_ROWS).select("g")
    known = F.struct(F.col("g.lang").isNull().alias("no_lang"), F.coalesce("g.lang", F.lit("")).alias("lang"), F.col("g.source").isNull().alias("no_source"), F.coalesce("g.source", F.lit("")).alias("source"), "g.own")
    plain = [F.col("gl").isNull().alias("no_lang"), F.coalesce("gl", F.lit("")).alias("lang"), F.col("gs").isNull().alias("no_source"), F.coalesce("gs", F.lit("")).alias("source")]
    grouped = cut(grouped.join(large, "g", "left_semi").select(*plain, known.alias("g")))
    # a number stands for the group's names from here on
    numbers = cut(grouped.select("g").distinct().withColumn("number", F.monotonically_increasing_id()))
    grouped = cut(grouped.join(numbers, "g").select("no_lang", "lang", "no_source", "source", F.col("number").alias("g")))
    few = grouped.count() <= few_groups
    keys = ["no_lang", "lang", "no_source", "source"]
    rows = rows.withColumns({"no_lang": F.col("lang").isNull(), "no_source": F.col("source").isNull(), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))})
    held = [c for c in rows.columns if c not in keys]
    sound = _meet(rows.where("not base_failed"), grouped, keys, few).select(*held, "g")
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = robust_distances(sound, few)
    near = judged.select(*out, (F.col("d2") <= cutoff).alias("kept"), "d2")
    alone = rows.where("not base_failed").join(F.broadcast(grouped) if few else grouped, keys, "left_anti")
    rest = rows.where("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2"))
    return near.union(alone.select(*out, F.lit(True).alias("kept"), F.lit(None).cast("double").alias("d2"))).union(rest)
