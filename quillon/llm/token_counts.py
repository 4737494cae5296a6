"""Token counts of whole texts without token ids.

A text is cut into pre-tokens at places that no piece of the model spans, so that its count is the sum over
its pre-tokens.  Pieces are counted once per distinct pre-token and joined to the per-document frequencies:

* the pre-tokens that a bounded sample of texts shows to be frequent are counted first and go out as one
  bounded table (``hot`` entries at most), which each task joins to its documents in place;
* all others travel as (document, pre-token, frequency) rows to the task that owns the pre-token, sorted, and
  are counted there once for all their rows.

The sample only decides which way a pre-token goes; the counts are the same for any sample.

Defined results: a null or empty text has 0 tokens; rows that repeat are counted each on their own; a null
doc_id stays null; columns other than doc_id and text take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import _scan
from quillon.llm._spark import at_least

SAMPLE_DOCS = 8192
HOT = 1 << 19
_ROWS = "uid long, doc_id long, n_bytes long, pk int, token string, freq long, n long"
_MARK = "▁"


@lru_cache(maxsize=2)
def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if _MARK in piece.lstrip(_MARK) or "\n" in piece:
            raise ValueError(f"piece {piece!r} spans a place at which texts are cut")
    return model


def piece_counts(path: str, tokens: list[str]) -> np.ndarray:
    """Pieces of each pre-token; a leading space stands for the mark that the library puts before a text.

    A pre-token without that space is counted behind a line feed, which is a piece of its own after the mark's.
    """
    if not tokens:
        return np.zeros(0, np.int64)
    spaced = np.array([t[:1] == " " for t in tokens])
    found = _model(path).encode([t[1:] if s else "\n" + t for t, s in zip(tokens, spaced, strict=True)], num_threads=1)
    counts = np.fromiter(map(len, found), np.int64, len(found)) - 2 * ~spaced
    counts[np.array([t == " " for t in tokens])] = 1
    return counts


def _pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and each text's first index: cut before a run of spaces and around each line feed."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space, feed = data == 0x20, data == 0x0A
    first = feed.copy()
    first[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
    first[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, off)


def _prepared(text: pa.Array) -> pa.Array:
    """Marks as spaces, which they mean to the library, and one space before each text that isn't empty."""
    text = text.fill_null("")
    if pc.any(pc.match_substring(text, _MARK)).as_py():
        text = pc.replace_substring(text, _MARK, " ")
    lead = pc.if_else(pc.equal(pc.binary_length(text), 0), pa.scalar("", text.type), pa.scalar(" ", text.type))
    return pc.binary_join_element_wise(lead, text, pa.scalar("", text.type))


def _frequencies(hot_keys: np.ndarray | None, hot_counts: np.ndarray | None, by_doc: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _scan.HashIndex(hot_keys)
        for batch in batches:
            uid = batch.column("uid").to_numpy(zero_copy_only=False)
            for i, j, data, off in _scan.chunks(_prepared(batch.column("text"))):
                starts, ends, first = _pretokens(data, off)
                keys = _scan.hash_spans(data, starts, ends)
                place = index.find(keys)
                cold = np.flatnonzero(place < 0)
                doc = np.repeat(np.arange(j - i), np.diff(first))[cold] if by_doc else np.zeros(len(cold), np.int64)
                order = np.lexsort((keys[cold], doc))
                cold, doc = cold[order], doc[order]
                new = np.ones(len(cold), bool)
                new[1:] = (keys[cold][1:] != keys[cold][:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                rows = {
                    "uid": pa.array(uid[i:j][doc[at]] if by_doc else np.zeros(len(at), np.int64)),
                    "doc_id": pa.nulls(len(at), pa.int64()),
                    "n_bytes": pa.nulls(len(at), pa.int64()),
                    "pk": pa.array((keys[cold[at]] >> np.uint64(33)).astype(np.int32)),
                    "token": _scan.strings(data, starts[cold[at]], ends[cold[at]]),
                    "freq": pa.array(np.diff(np.append(at, len(cold)))),
                    "n": pa.array(np.zeros(len(at), np.int64)),
                }
                yield pa.RecordBatch.from_pydict(rows)
                if by_doc:
                    n = hot_counts[place] if len(index) else np.zeros(len(place), np.int64)
                    n = np.where(place < 0, 0, n).astype(np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "uid": pa.array(uid[i:j]),
                            "doc_id": batch.column("doc_id").slice(i, j - i),
                            "n_bytes": batch.column("n_bytes").slice(i, j - i),
                            "pk": pa.array((_scan.mix64(uid[i:j]) >> np.uint64(33)).astype(np.int32)),
                            "token": pa.nulls(j - i, pa.string()),
                            "freq": pa.array(np.ones(j - i, np.int64)),
                            "n": pa.array(_scan.sum_by(n, first)),
                        }
                    )

    return run


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, int] = (None, 0)
        for batch in batches:
            coded = batch.column("token").dictionary_encode()
            tokens = coded.dictionary.to_pylist()
            known = [last[0] == t for t in tokens]
            counts = np.zeros(len(tokens) + 1, np.int64)
            fresh = [i for i, k in enumerate(known) if not k]
            counts[fresh] = piece_counts(path, [tokens[i] for i in fresh])
            counts[[i for i, k in enumerate(known) if k]] = last[1]
            at = coded.indices.fill_null(len(tokens)).to_numpy(zero_copy_only=False)
            if len(tokens) and at[-1] < len(tokens):
                last = (tokens[at[-1]], int(counts[at[-1]]))
            n = batch.column("n").to_numpy() + counts[at] * batch.column("freq").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], ["uid", "doc_id", "n_bytes", "n"])

    return run


def _pieces_of(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(piece_counts(path, batch.column("token").to_pylist()))], ["token", "n"])

    return run


def count_tokens(documents: DataFrame, model_path: str, limit: int = 4096, hot: int = HOT, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of documents."""
    rows = documents.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text")
    )
    total = documents.count()
    sample = rows.sample(min(1.0, sample_docs / max(total, 1)), seed=7) if total > sample_docs else rows
    seen = sample.mapInArrow(_frequencies(None, None, False), _ROWS).groupBy("token").agg(F.sum("freq").alias("freq")).persist()
    frequent = seen.where(F.col("freq") >= max(2, at_least(seen, "freq", hot))).select("token")
    table = frequent.mapInArrow(_pieces_of(model_path), "token string, n long").toArrow()
    seen.unpersist()
    keys = _scan.hash_strings(table.column("token").combine_chunks()) if table.num_rows else np.zeros(0, np.uint64)
    counts = table.column("n").to_numpy().astype(np.int32) if table.num_rows else np.zeros(0, np.int32)
    return (
        rows.mapInArrow(_with_broadcast(documents, keys, counts), _ROWS)
        .repartition("pk")
        .sortWithinPartitions("token")
        .mapInArrow(_counted(model_path), "uid long, doc_id long, n_bytes long, n long")
        .groupBy("uid")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def _with_broadcast(documents: DataFrame, keys: np.ndarray, counts: np.ndarray):
    table = documents.sparkSession.sparkContext.broadcast((keys, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _frequencies(*table.value, True)(batches)

    return run
