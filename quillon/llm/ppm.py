"""Language-model scores by prediction by partial matching (PPM) on bytes, beside a word unigram base.

The model is a trie of byte contexts up to ``ORDER`` bytes, learned from the learning documents: every context's
count of each symbol that followed it.  Symbols are the 256 bytes and the end of a text; texts are lower-cased (A-Z)
and begin in a context of start marks.  A symbol that the longest context has seen costs its share there, by
escape method C: count / (total + distinct); else an escape, distinct / (total + distinct), and the next shorter
context without the symbols already excluded; after the empty context all that is left is equally likely.

With a fixed model, what a symbol costs is a function of the ORDER bytes before it and itself.  These
(context, symbol) pairs are counted once over all texts; each distinct pair is scored once from the trie's nodes,
which are sums over the pairs' suffixes; and a document's score is the sum of its pairs' scores.  The nested
contexts make exclusion a subtraction: what a context excludes from its suffix is exactly its own symbols.

Pairs and words go the same two ways.  The most frequent (``HOT`` at most, from the counts over all documents) are
sent to all tasks as a bounded table and joined there; all others travel as rows to the task that owns the pair or
the word.  Every pair and every word is counted and scored either way.

Base: words and one end a document, log10((c + 1) / (N + V + 1)) with counts over the learning documents.

Defined results: a null or empty text has its end only; repeated rows are counted and scored each; a null doc_id is
held out; other columns take no part; with nothing to learn from every symbol costs 1 / 257; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import _scan
from quillon.llm._spark import at_least, cut

ORDER = 4
HOT = 1 << 19
END, START, SYMBOLS = 256, 257, 257
_BITS = 9
_FLUSH = 1 << 18


def pair_codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) codes, 9 bits a symbol, of each lower-cased text and its end; and the n + 1 places at which texts begin."""
    n = len(off) - 1
    at = off + np.arange(n + 1) * (ORDER + 1)
    symbols = np.full(int(at[-1]), START, np.int64)
    symbols[np.arange(len(data)) + np.repeat(np.arange(n) * (ORDER + 1) + ORDER, np.diff(off))] = _scan.lower_ascii(data)
    symbols[at[1:] - 1] = END
    codes = np.zeros(len(symbols), np.int64)
    for k in range(ORDER + 1):
        codes[k:] |= symbols[: len(symbols) - k] << (_BITS * k)
    keep = np.ones(len(symbols), bool)
    keep[(at[:-1][:, None] + np.arange(ORDER)).ravel()] = False
    return codes[keep], off + np.arange(n + 1)


def _learning(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 != 2, F.lit(False))


class _Sums:
    """Counts by key that are handed on when there are many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, learned: np.ndarray) -> None:
        order = np.sort((keys << 1) | learned)
        new = np.flatnonzero(np.append(True, order[1:] != order[:-1])) if len(order) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(order)))
        keys, learned = order[new] >> 1, order[new] & 1
        self.parts.append((keys, count, count * learned))
        self.size += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.concatenate([p[0] for p in self.parts] or [np.zeros(0, np.int64)])
        distinct, which = np.unique(keys, return_inverse=True)
        sums = [np.bincount(which, np.concatenate([p[k] for p in self.parts]), len(distinct)).astype(np.int64) if len(keys) else np.zeros(0, np.int64) for k in (1, 2)]
        self.parts, self.size = [(distinct, *sums)], len(distinct)
        return self.parts[0]


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()

    def out() -> pa.RecordBatch:
        found = sums.merged()
        sums.__init__()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["code", "n", "c"])

    for batch in batches:
        learn = batch.column("learn").to_numpy(zero_copy_only=False)
        for i, j, data, off in _scan.chunks(batch.column("text")):
            codes, bound = pair_codes(data, off)
            sums.add(codes, np.repeat(learn[i:j], np.diff(bound)).astype(np.int64))
            if sums.size > 4 * _FLUSH:
                sums.merged()
                if sums.size > 2 * _FLUSH:
                    yield out()
    yield out()


def _word_counts(hot):
    """Learning counts of the hot words, by their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _scan.HashIndex(hot.value)
        total = np.zeros(len(index) + 1, np.int64)
        for batch in batches:
            for _, _, data, off in _scan.chunks(batch.column("text")):
                data = _scan.lower_ascii(data)
                starts, ends, _ = _scan.word_spans(data, off)
                total += np.bincount(index.find(_scan.hash_spans(data, starts, ends)) + 1, minlength=len(total))
        place = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(total[1:][place])], ["place", "c"])

    return run


def _sampled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, off in _scan.chunks(batch.column("text")):
            data = _scan.lower_ascii(data)
            starts, ends, _ = _scan.word_spans(data, off)
            keys, n = np.unique(_scan.hash_spans(data, starts, ends), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])


# --- the trie ----------------------------------------------------------------------------------------------------


def pair_scores(pairs: DataFrame) -> DataFrame:
    """code and logp of every pair (code, n, c), c being its count in the learning documents."""
    seen = pairs.where("c > 0").select("code", "c")
    top = _BITS * (ORDER + 1)
    # an edge is a context of k bytes and a symbol, a node a context; both carry k + 1 above the bits of the longest code
    edge_keys = F.array(*[F.col("code").bitwiseAND((1 << (_BITS * (k + 1))) - 1) + F.lit((k + 1) << top) for k in range(ORDER + 1)])
    tag = f"shiftleft(shiftright(edge, {top}), {top})"
    node = F.expr(f"shiftright(edge - {tag}, {_BITS}) + {tag}")
    edges = cut(seen.select(F.explode(edge_keys).alias("edge"), "c").groupBy("edge").agg(F.sum("c").alias("c")))
    # the edge of the same symbol in the context one byte shorter
    k = f"(shiftright(edge, {top}) - 1)"
    shorter = F.expr(f"if({k} > 0, (edge & (shiftleft(1L, int({_BITS} * {k})) - 1)) + shiftleft({k}, {top}), null)")
    below = edges.select(F.col("edge").alias("shorter"), F.col("c").alias("below"))
    nodes = cut(edges.select(node.alias("node"), "c", shorter.alias("shorter")).join(below, "shorter", "left").groupBy("node").agg(F.sum("c").alias("total"), F.count("*").alias("distinct"), F.sum("below").alias("excluded")))

    full = pairs.where("c > 0").select("code", "c", (F.shiftright("code", _BITS) + F.lit((ORDER + 1) << top)).alias("node"))
    known = full.join(nodes, "node").select("code", F.log10(F.col("c") / (F.col("total") + F.col("distinct"))).alias("logp"))

    steps = pairs.where("c = 0").select("code", F.posexplode(edge_keys).alias("k", "edge")).withColumn("node", node)
    steps = steps.join(edges, "edge", "left").join(nodes, "node", "left")
    columns = [F.max(F.when(F.col("k") == k, F.col(x))).alias(f"{x}{k}") for k in range(ORDER + 1) for x in ("c", "total", "distinct", "excluded")]
    wide = steps.groupBy("code").agg(*columns)
    # what is left of each context's total and distinct symbols without those that the next longer one excludes
    less = lambda x, k, y: F.col(f"{x}{k}") - (F.coalesce(F.col(f"{y}{k + 1}"), F.lit(0)) if k < ORDER else F.lit(0))
    wide = wide.withColumns({f"t{k}": less("total", k, "excluded") for k in range(ORDER + 1)} | {f"d{k}": less("distinct", k, "distinct") for k in range(ORDER + 1)})
    # each context's own cost and whether it has seen the symbol; the costs from the longest context to the first that has add up
    costs, hits = {}, {}
    for k in range(ORDER + 1):
        total, distinct, c = F.col(f"t{k}"), F.col(f"d{k}"), F.col(f"c{k}")
        here = total.isNotNull() & (distinct > 0)
        costs[f"cost{k}"] = F.when(here, F.log10(F.coalesce(c, distinct) / (total + distinct))).otherwise(0.0)
        hits[f"hit{k}"] = here & c.isNotNull()
    wide = wide.withColumns(costs | hits)
    wide = wide.withColumn("hit", F.coalesce(*[F.when(F.col(f"hit{k}"), F.lit(k)) for k in range(ORDER, -1, -1)], F.lit(-1)))
    logp = F.lit(0.0)
    for k in range(ORDER, -1, -1):
        logp = logp + F.when(F.col("hit") <= k, F.col(f"cost{k}")).otherwise(0.0)
    left = F.lit(SYMBOLS) - F.coalesce(F.col("distinct0"), F.lit(0))
    unknown = wide.select("code", (logp - F.when(F.col("hit") < 0, F.log10(left.cast("double"))).otherwise(0.0)).alias("logp"))
    return known.union(unknown)


# --- scoring -----------------------------------------------------------------------------------------------------

_ROWS = "uid long, pk int, doc_id long, word string, code long, freq long, learned long, held_out boolean, n_tokens long, n_known long, logs double, score double, logp double"


def _scored(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, code_logp, words, word_c = tables.value
        by_code, by_word = _scan.HashIndex(codes.view(np.uint64)), _scan.HashIndex(words)
        code_logp, word_log, word_known = np.append(code_logp, 0.0), np.append(np.log10(word_c + 1.0), 0.0), np.append(word_c > 0, False)

        def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = {"uid": pa.int64(), "pk": pa.int32(), "doc_id": pa.int64(), "word": pa.string(), "code": pa.int64(), "freq": pa.int64(), "learned": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "logs": pa.float64(), "score": pa.float64(), "logp": pa.float64()}
            return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(n, kind) for x, kind in kinds.items()], list(kinds))

        def distinct(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of (doc, key) pairs the order that sorts them, and where in it each distinct one begins."""
            order = np.lexsort((keys, doc))
            new = np.ones(len(order), bool)
            new[1:] = (doc[order][1:] != doc[order][:-1]) | (keys[order][1:] != keys[order][:-1])
            return order, np.flatnonzero(new)

        for batch in batches:
            uid, learn = batch.column("uid").to_numpy(), batch.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, data, off in _scan.chunks(batch.column("text")):
                ids, own = uid[i:j], learn[i:j]
                pairs, bound = pair_codes(data, off)
                place = by_code.find(pairs.view(np.uint64))
                score = _scan.sum_by(code_logp[place], bound)
                cold = np.flatnonzero(place < 0)
                if len(cold):
                    doc = np.searchsorted(bound, cold, "right") - 1
                    order, at = distinct(doc, pairs[cold])
                    doc, key = doc[order[at]], pairs[cold][order[at]]
                    yield rows(len(at), uid=pa.array(ids[doc]), pk=pa.array(_slot(key)), code=pa.array(key), freq=pa.array(np.diff(np.append(at, len(order)))))
                data = _scan.lower_ascii(data)
                starts, ends, first = _scan.word_spans(data, off)
                keys = _scan.hash_spans(data, starts, ends)
                place = by_word.find(keys)
                cold = np.flatnonzero(place < 0)
                if len(cold):
                    doc = np.searchsorted(first, cold, "right") - 1
                    order, at = distinct(doc, keys[cold])
                    doc, one = doc[order[at]], cold[order[at]]
                    freq = np.diff(np.append(at, len(order)))
                    yield rows(len(at), uid=pa.array(ids[doc]), pk=pa.array((keys[one] >> np.uint64(33)).astype(np.int32)), word=_scan.strings(data, starts[one], ends[one]), freq=pa.array(freq), learned=pa.array(freq * own[doc]))
                n = j - i
                yield rows(
                    n,
                    uid=pa.array(ids),
                    pk=pa.array(_slot(ids)),
                    doc_id=batch.column("doc_id").slice(i, n),
                    held_out=pa.array(own == 0),
                    n_tokens=pa.array(np.diff(first) + 1),
                    n_known=pa.array(_scan.sum_by(word_known[place].astype(np.int64), first)),
                    logs=pa.array(_scan.sum_by(word_log[place], first)),
                    score=pa.array(score),
                )

    return run


def _slot(keys: np.ndarray) -> np.ndarray:
    return (_scan.mix64(keys.astype(np.int64).view(np.uint64)) >> np.uint64(33)).astype(np.int32)


def _with_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_slot(batch.column("code").to_numpy())), batch.column("code"), batch.column("logp")], ["pk", "code", "logp"])


def score(documents: DataFrame, hot: int = HOT, sample_docs: int = 8192) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of documents."""
    spark = documents.sparkSession
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), _learning(F.col("doc_id")).alias("learn"), F.col("text").cast("string").alias("text"))

    pairs = cut(rows.select("learn", "text").mapInArrow(_pair_counts, "code long, n long, c long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("c").alias("c")))
    scores = cut(pair_scores(pairs))
    least = at_least(pairs, "n", hot)
    hot_pairs = pairs.where(F.col("n") >= least).join(scores, "code").select("code", "logp").toArrow()

    # which words are hot is read off a bounded sample; how often they occur is counted over all learning documents
    total = documents.count()
    sample = rows.sample(min(1.0, sample_docs / max(total, 1)), seed=7) if total > sample_docs else rows
    seen = sample.select("text").mapInArrow(_sampled_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).persist()
    hot_words = np.sort(seen.where(F.col("n") >= max(2, at_least(seen, "n", hot))).select("key").toArrow().column("key").to_numpy()).view(np.uint64)
    seen.unpersist()
    counts = rows.where("learn").select("text").mapInArrow(_word_counts(spark.sparkContext.broadcast(hot_words)), "place int, c long").groupBy("place").agg(F.sum("c").alias("c")).toArrow()
    word_c = np.zeros(len(hot_words), np.int64)
    word_c[counts.column("place").to_numpy()] = counts.column("c").to_numpy()

    tables = spark.sparkContext.broadcast((hot_pairs.column("code").to_numpy().astype(np.int64), hot_pairs.column("logp").to_numpy(), hot_words, word_c))
    stream = rows.mapInArrow(_scored(tables), _ROWS)
    cold = pairs.where(F.col("n") < least).select("code").join(scores, "code").mapInArrow(_with_slot, "pk int, code long, logp double")
    stream = stream.unionByName(cold, allowMissingColumns=True)
    own = Window.partitionBy("pk", "word", "code")
    first = F.row_number().over(own.orderBy(F.col("uid").asc_nulls_last())) == 1
    stream = stream.withColumns({"c": F.sum("learned").over(own), "pair": F.max("logp").over(own), "first": first}).where("uid is not null")
    word, code = F.col("word").isNotNull(), F.col("code").isNotNull()
    totals = stream.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(word, F.when(F.col("c") > 0, F.col("freq")).otherwise(0)).otherwise(F.coalesce("n_known", F.lit(0)))).alias("n_known"),
        F.sum(F.when(word, F.col("freq") * F.log10(F.col("c") + 1.0)).otherwise(F.coalesce("logs", F.lit(0.0)))).alias("logs"),
        F.sum(F.when(code, F.col("freq") * F.col("pair")).otherwise(F.coalesce("score", F.lit(0.0)))).alias("score"),
        F.sum(F.when(word & F.col("first") & (F.col("c") > 0), 1).otherwise(0)).alias("new_words"),
    )
    totals = cut(totals)
    found = totals.agg(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))).alias("n"), F.sum("new_words").alias("v"), F.count_if(~F.col("held_out")).alias("ends")).first()
    n, ends = int(found["n"] or 0), int(found["ends"] or 0)
    v = int(found["v"] or 0) + int((word_c > 0).sum()) + (ends > 0)
    base = F.col("logs") + math.log10(ends + 1.0) - F.col("n_tokens") * math.log10(n + v + 1.0)
    return totals.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
