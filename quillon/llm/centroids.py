"""Centroid clustering: Lloyd's rounds on integers, carried on by differences.

Each vector's assignment and distance are kept from round to round as a written table, and so are the sums and counts of all
clusters, which are a few rows.  A round takes the centroids that it is to use and

* compares a vector whose own centroid stayed where it was only with the centroids that moved: the others were no nearer before;
* compares a vector whose own centroid moved with all of them;
* then adds up, of the vectors that changed hands alone, the vector to its new cluster and less it to its old one.

The sums of these transfers, in parts small enough for any integers, change the global sums, and these give the next centroids as exact
floors.  When no centroid moves, the rounds left would change nothing and aren't run.  A round's table is read once and written once, and the
table before it is deleted when its successor is there; a task that is lost is run again from the table of the round before.

Components are integers of any size: batches whose squares might leave 64 bits are compared with Python's integers.

Defined results: vectors that are null, of another length, or hold nulls, infinities or NaN take no part; repeated rows count each; a null vec_id is kept,
and comes last among the starting centroids; of vectors with one vec_id the smallest (component by component) starts first; fewer vectors than centroids
give as many centroids as there are vectors; a distance beyond 64 bits is null, and so is a sum that it is part of; no vectors give no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._spark import lean, new_path

#: Fixed values of the contract.
DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3

#: Sums travel in parts of so many bits, so that 2^38 of them add up in 64.
_PART = 24
#: With components below this, squared distances fit in 64 bits.
_SMALL = 1 << 27
_ROWS = 4096
_STATE = "vec_id long, v array<long>, wide string, cluster int, distance decimal(38,0), was int, moved boolean"


# --- vectors as integers -----------------------------------------------------------------------------------------


def _integers(batch: pa.RecordBatch, scale: int) -> list[list[int]]:
    return [[math.floor(scale * x) for x in row] for row in batch.column("embedding").to_pylist()]


def _kept(vectors: DataFrame, dimensions: int) -> DataFrame:
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where((F.size("embedding") == dimensions) & sound)


def _floored(scale: int):
    """vec_id and v, or wide where an integer doesn't fit in 64 bits (then as text, comma by comma)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                some = batch.slice(i, _ROWS)
                flat = np.floor(scale * np.asarray(some.column("embedding").flatten(), np.float64))
                if len(flat) and np.abs(flat).max() < 2.0**62:
                    whole = pa.FixedSizeListArray.from_arrays(pa.array(flat.astype(np.int64)), len(flat) // some.num_rows).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([some.column("vec_id"), whole, pa.nulls(some.num_rows, pa.string())], ["vec_id", "v", "wide"])
                else:
                    found = _integers(some, scale)
                    fits = [all(abs(x) < 1 << 62 for x in row) for row in found]
                    v = pa.array([row if ok else None for row, ok in zip(found, fits, strict=True)], pa.list_(pa.int64()))
                    wide = pa.array([None if ok else ",".join(map(str, row)) for row, ok in zip(found, fits, strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([some.column("vec_id"), v, wide], ["vec_id", "v", "wide"])

    return run


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors as a matrix of int64, or of Python's integers if they are large."""
    v, wide = batch.column("v"), batch.column("wide")
    if wide.null_count == len(wide):
        flat = np.asarray(v.flatten(), np.int64).reshape(len(v), -1)
        return flat if not flat.size or max(int(flat.max()), -int(flat.min())) < _SMALL else flat.astype(object)
    rows = [x if x is not None else [int(y) for y in w.split(",")] for x, w in zip(v.to_pylist(), wide.to_pylist(), strict=True)]
    return np.array(rows, object)


def _distances(rows: np.ndarray, centroid: list[int]) -> np.ndarray:
    kind = object if rows.dtype == object or max(map(abs, centroid), default=0) >= _SMALL else np.int64
    apart = rows.astype(kind, copy=False) - np.array(centroid, kind)
    return (apart * apart).sum(axis=1)


# --- a round -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Centroids:
    """What a round's tasks are sent: all centroids, and which of them moved since the round before."""

    at: list[list[int]]
    moved: list[bool]

    def assign(self, rows: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row and its squared distance, from those of the round before (cluster -1: none yet)."""
        moved = np.array(self.moved, bool)
        again = (cluster < 0) | moved[np.maximum(cluster, 0)]
        best, near = cluster.copy(), distance.astype(object) if rows.dtype == object else distance.copy()
        for some, among in ((np.flatnonzero(again), range(len(self.at))), (np.flatnonzero(~again), np.flatnonzero(moved).tolist())):
            if not len(some):
                continue
            own, at, to = rows[some], best[some], near[some]
            if again[some[0]]:
                at, to = np.zeros(len(some), np.int64), _distances(own, self.at[0])
            for k in among:
                d = _distances(own, self.at[k])
                nearer = ((d < to) | ((d == to) & (k < at))).astype(bool)
                at, to = np.where(nearer, k, at), np.where(nearer, d, to)
            near = near.astype(object) if to.dtype == object else near
            best[some], near[some] = at, to
        return best, near


def _decimals(values: np.ndarray) -> pa.Array:
    """Distances as decimals; those beyond 38 digits as null, which no 64-bit result can hold anyway."""
    if values.dtype != object:
        return pa.array(values, pa.int64()).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(x) if abs(x) < 10**38 else None for x in map(int, values.tolist())], pa.decimal128(38, 0))


def _round(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(i, _ROWS)
                rows = _matrix(batch)
                was = batch.column("cluster").to_numpy().astype(np.int64)
                held = batch.column("distance")
                if rows.dtype == object or held.null_count:
                    # a distance that no column holds is measured again
                    lost = ~held.is_valid().to_numpy(zero_copy_only=False)
                    before = np.array([0 if x is None else int(x) for x in held.to_pylist()], object)
                    cluster, near = sent.value.assign(rows, np.where(lost, -1, was), before)
                elif int(max(held.to_pylist(), default=0)) >= 1 << 63:  # small vectors, a large centroid
                    cluster, near = sent.value.assign(rows, was, np.array([int(x) for x in held.to_pylist()], object))
                else:
                    cluster, near = sent.value.assign(rows, was, np.asarray(held.cast(pa.int64())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), batch.column("wide"), pa.array(cluster, pa.int32()), _decimals(near), pa.array(was, pa.int32()), pa.array(cluster != was)],
                    ["vec_id", "v", "wide", "cluster", "distance", "was", "moved"],
                )

    return run


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signed sums of a task's vectors that changed hands, by cluster and part: the parts of a sum are digits of _PART bits with its sign."""
    sums: dict[int, list[int]] = {}
    counts: dict[int, int] = {}
    for whole in batches:
        for i in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(i, _ROWS)
            rows = _matrix(batch)
            for column, sign in (("cluster", 1), ("was", -1)):
                own = batch.column(column).to_numpy()
                for k in np.unique(own[own >= 0]).tolist():
                    some = rows[own == k]
                    total = [sign * int(x) for x in some.sum(axis=0)]
                    sums[k] = [a + b for a, b in zip(sums.get(k, [0] * len(total)), total, strict=True)]
                    counts[k] = counts.get(k, 0) + sign * len(some)
    out = []
    for k, total in sums.items():
        part, left = 0, [abs(x) for x in total]
        signs = [1 if x >= 0 else -1 for x in total]
        while part == 0 or any(left):
            out.append((k, part, counts[k] if part == 0 else 0, [s * (x & ((1 << _PART) - 1)) for s, x in zip(signs, left, strict=True)]))
            left, part = [x >> _PART for x in left], part + 1
    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["cluster", "part", "n", "v"])


def _drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of this module's own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Lloyd:
    """Clusters of integer vectors: a written table of assignments, and global sums and counts."""

    def __init__(self, vectors: DataFrame, start: list[list[int]]) -> None:
        """vectors: vec_id, v and wide; start: the first centroids."""
        self.spark, self.centroids = vectors.sparkSession, start
        self.changed = [True] * len(start)
        self.sums = [[0] * len(c) for c in start]
        self.counts = [0] * len(start)
        none = F.lit(-1)
        self.path = self._written(vectors.select("vec_id", "v", "wide", none.cast("int").alias("cluster"), F.lit(0).cast("decimal(38,0)").alias("distance"), none.cast("int").alias("was"), F.lit(False).alias("moved")))

    def _written(self, rows: DataFrame) -> str:
        path = new_path(self.spark, "clusters")
        rows.write.parquet(path)
        return path

    @property
    def state(self) -> DataFrame:
        return self.spark.read.schema(_STATE).parquet(self.path)

    def assign(self) -> None:
        """Assigns all vectors to the centroids as they are, and brings the sums up to date by what changed hands."""
        sent = self.spark.sparkContext.broadcast(Centroids(self.centroids, self.changed))  # a row for each centroid
        path = self._written(self.state.mapInArrow(lean(_round(sent)), _STATE))
        _drop(self.spark, self.path)
        self.path, self.changed = path, [False] * len(self.centroids)
        parts = self.state.where("moved").select("v", "wide", "cluster", "was").mapInArrow(lean(_transfers), "cluster int, part int, n long, v array<long>")
        width = len(self.centroids[0])
        total = parts.groupBy("cluster", "part").agg(F.sum("n").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)])
        for r in total.collect():  # centroids times the parts of a sum
            self.counts[r["cluster"]] += r["n"]
            own = self.sums[r["cluster"]]
            for i in range(width):
                own[i] += r[f"s{i}"] << (_PART * r["part"])

    def move(self) -> bool:
        """Puts the centroids at the floors of their clusters' means; whether any of them moved."""
        new = [[s // n for s in total] if n else old for total, n, old in zip(self.sums, self.counts, self.centroids, strict=True)]
        self.changed = [a != b for a, b in zip(new, self.centroids, strict=True)]
        self.centroids = new
        return any(self.changed)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and vec_id: k rows come to the driver."""
    ranked = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = ranked.orderBy(F.asc_nulls_last("h"), F.asc_nulls_last("v"), F.asc_nulls_last("wide")).limit(k).select("v", "wide").collect()
    return [list(r["v"]) if r["v"] is not None else [int(x) for x in r["wide"].split(",")] for r in rows]


def _oracle() -> str:
    """DuckDB SQL for the query: its rounds one after another."""
    apart = "list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v FROM (SELECT v, sha256('{SEED}:' || vec_id::VARCHAR) AS h FROM kept ORDER BY h NULLS LAST, v LIMIT {CENTROIDS})
)"""
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': {apart}, 'k': c.k}}) AS m FROM kept a, c{i} c GROUP BY r)")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT k, list(x ORDER BY d) AS v FROM (
      SELECT k, d, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
      FROM (SELECT m.k AS k, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i} JOIN kept USING (r)) GROUP BY k, d
    ) GROUP BY k
  ) n ON n.k = c.k
)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, m.k::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.k))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (r) JOIN c{ROUNDS} c ON c.k = m.k
"""


ORACLE = _oracle()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector (vec_id, embedding)."""
    spark = vectors.sparkSession
    whole = _kept(vectors, dimensions).mapInArrow(lean(_floored(scale)), "vec_id long, v array<long>, wide string")
    start = first_centroids(whole, k, seed)
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    run = Lloyd(whole, start)
    run.assign()
    for _ in range(rounds):
        if not run.move():
            break
        run.assign()
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    fits = lambda c: F.when(c <= most, c.cast("long"))
    # a sum with a part that no column holds isn't known
    whole_sum = F.when(F.count("*") == F.count("distance"), F.try_sum("distance")).alias("total")
    inertia = {r["cluster"]: r["total"] for r in run.state.groupBy("cluster").agg(whole_sum).collect()}  # a row for each centroid
    every = None if any(x is None for x in inertia.values()) else sum(map(int, inertia.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in run.centroids]
    bounded = lambda x: None if x is None or int(x) >= 1 << 63 else int(x)
    sides = spark.createDataFrame([(c, bounded(x), bounded(every), digest[c]) for c, x in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return run.state.select("vec_id", "cluster", fits(F.col("distance")).alias("distance")).join(F.broadcast(sides), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
