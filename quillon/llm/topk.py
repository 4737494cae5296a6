"""Exact top-k search by inner product with MaxScore.

Vectors are taken as floor(64 x) per component.  Rows are dealt once into at most ``MOST_SHARDS`` shards and kept in the
checkpoint folder; queries go to all shards in blocks of ``BLOCK_ROWS``, one block after another, each a bounded table
that is sent to every task.  So vectors are shuffled once, whatever the number of queries.

A task reads its shard in slices of ``SLICE_ROWS`` candidates.  In a slice each dimension is a term with a posting for
every candidate, since vectors are dense: traversing a term's postings is a product with a row of a matrix.  A query
bounds a term by the largest product that any posting of the slice can give, and orders its terms by that bound.  The
score that its k-th best so far has, in this slice and all before it in the shard, is the threshold; terms are non-essential
from where the bounds of all that follow add up to less than what a candidate still needs.  Essential postings are
traversed for every candidate, the others are probed only for those whose partial score and remaining bound still reach
the threshold, a few terms at a time.  A first part of the shard is scored in full for a threshold to begin with.  A
query's best of each shard are merged by score and number.

Scores are exact: sums of integer products, in doubles while these are exact for a query and a slice, in 64-bit integers
while they fit these, and in Python's integers beyond.

Defined results: a vector that is null or has a null, infinite or NaN component, and one without a number, takes no
part; rows that repeat a number are queries and candidates each, and each other's candidates; shorter vectors count as
filled up with zeros; scores beyond 64 bits stop at the largest, and tie there; other columns take no part; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._spark import cut

SLICE_ROWS, BLOCK_ROWS = 8192, 16_384
LEAST_SHARD, MOST_SHARDS = 8192, 2048
FIRST, STEP = 1024, 8
_FOUND = "query long, vec_id long, score long"
_MOST = (1 << 63) - 1


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the components as whole numbers (doubles, since they may be beyond 64 bits)."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
    return rows.where(finite).select("vec_id", F.transform("e", lambda x: _floor64(x)).alias("v"))


def _floor64(x: Column) -> Column:
    y = F.greatest(F.least(x * F.lit(64.0), F.lit(1.7e308)), F.lit(-1.7e308))
    # beyond 2^52 every double is whole
    return F.when(F.abs(y) < F.lit(float(1 << 52)), F.floor(y).cast("double")).otherwise(y)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


class Slice:
    """Candidates of a shard, terms as rows."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        self.rows, self.ids = rows, ids
        self.columns = np.ascontiguousarray(vectors.T)
        self.high, self.low = vectors.max(axis=0), vectors.min(axis=0)
        self.size = np.maximum(np.abs(self.high), np.abs(self.low))
        self.whole: np.ndarray | None = None

    def integers(self) -> np.ndarray:
        if self.whole is None:
            self.whole = self.columns.astype(np.int64)
        return self.whole

    def best(self, q: np.ndarray, own: int, k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of (ids, scores), found before, and this slice's candidates, by score and then id; ``own`` is the query's own row."""
        with np.errstate(over="ignore"):
            most = float(np.abs(q) @ self.size)
        if most >= 2.0**62 or float(self.size.max()) >= 2.0**62 or float(np.abs(q).max()) >= 2.0**62:
            return self._in_python(q, own, k, ids, scores)
        columns = self.columns if most < 2.0**53 else self.integers()
        if columns is self.columns:
            high, low = self.high, self.low
        else:
            q, high, low = q.astype(np.int64), self.high.astype(np.int64), self.low.astype(np.int64)
        bound = np.maximum(q * high, q * low)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # rest[t]: bound of all terms from the t-th on
        # without k scores so far a first part is scored in full
        head = 0 if len(scores) == k else min(FIRST, len(self.ids))
        if head:
            place = np.flatnonzero(self.rows[:head] != own)
            ids, scores = _top(np.concatenate([ids, self.ids[place]]), np.concatenate([scores, (q @ columns[:, :head])[place].astype(np.int64)]), k)
        if head == len(self.ids):
            return ids, scores
        threshold = int(scores[-1]) if len(scores) == k else -_MOST
        # essential terms: until what remains cannot by itself reach the threshold
        t = min(int(np.searchsorted(-rest, -threshold, "right")), len(order))
        partial = q[order[:t]] @ columns[order[:t], head:]
        alive = np.flatnonzero(partial + rest[t] >= threshold)
        partial = partial[alive]
        while t < len(order) and len(alive):
            terms = order[t : t + STEP]
            partial = partial + q[terms] @ columns[np.ix_(terms, head + alive)]
            t += len(terms)
            keep = partial + rest[t] >= threshold
            alive, partial = alive[keep], partial[keep]
        place = head + alive
        other = self.rows[place] != own
        return _top(np.concatenate([ids, self.ids[place][other]]), np.concatenate([scores, partial[other].astype(np.int64)]), k)

    def _in_python(self, q: np.ndarray, own: int, k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same in Python's integers, where 64 bits would overflow."""
        w = [int(x) for x in q]
        place = np.flatnonzero(self.rows != own)
        found = [max(-_MOST - 1, min(_MOST, sum(a * int(b) for a, b in zip(w, self.columns[:, i], strict=True)))) for i in place]
        return _top(np.concatenate([ids, self.ids[place]]), np.concatenate([scores, np.array(found, np.int64)]), k)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, np.invert(scores)))[:k]  # ~x orders as -x, and the least number has one too
    return ids[order], scores[order]


def _searched(asked, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = asked.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                vectors = _matrix(part.column("v"))
                width = max(vectors.shape[1], queries.shape[1], 1)
                wide = _widened(queries, width)
                candidates = Slice(_widened(vectors, width), part.column("row").to_numpy(), part.column("vec_id").to_numpy())
                for i, q in enumerate(wide):
                    best[i] = candidates.best(q, own[i], k, *best[i])
        if len(own):
            counts = [len(b[0]) for b in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, counts)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], ["query", "vec_id", "score"])

    return run


def search(embeddings: DataFrame, every: int = 20, k: int = 20, shard_rows: int = LEAST_SHARD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best of all other rows for each row whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    total = embeddings.count()
    shards = max(1, min(MOST_SHARDS, -(-total // shard_rows)))
    rows = quantised(embeddings).withColumn("row", F.monotonically_increasing_id())
    dealt = cut(rows.repartition(shards, F.xxhash64("vec_id", "row")))
    asked = dealt.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // block_rows))
    found = []
    for block in range(blocks):
        one = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "v").toArrow().combine_chunks()
        held = spark.sparkContext.broadcast((one.column("row").to_numpy(), _matrix(one.column("v").combine_chunks())))
        best = dealt.mapInArrow(_searched(held, k), _FOUND)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        found.append(cut(best.withColumn("rank", rank).where(F.col("rank") <= k)))
        held.unpersist()
    every_one = found[0]
    for more in found[1:]:
        every_one = every_one.union(more)
    names = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return every_one.join(names, "query").select("query_id", "rank", "vec_id", "score")


#: DuckDB's counterpart of search(embeddings).
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
), parts AS (
  SELECT r, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v
), scores AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM parts q JOIN parts c ON q.d = c.d AND q.r <> c.r WHERE q.vec_id % 20 = 0 GROUP BY q.r, q.vec_id, c.r, c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scores
) WHERE rank <= 20
"""
