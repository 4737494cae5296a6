"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs, drawn from its code point.  A trigram's vector binds its
letters' vectors, each permuted (rotated) by its place: multiplied element by element.  A language's prototype
bundles (adds) the vectors of all trigrams of its learning texts, and a document is compared with each prototype by
cosine.  Words are framed: what is no letter is one boundary symbol, and a trigram has a letter in its middle.

Bundling is linear.  A prototype is therefore the sum over distinct trigrams of count times vector, from counts
that Spark adds up over all learning texts; and a document's dot product with a prototype is the sum over its
trigrams of theirs, looked up by trigram.  Its own length is the same against all prototypes, so that comparing
these sums over the prototypes' lengths is comparing cosines.

The score is the best cosine's share of the best two (0.5: they are equal; 1: only one language is similar at all).

A text's likeness to the language that it is told as is its trigrams' mean similarity to the prototype, over that of the
language's own learning trigrams (which is the prototype's length over their number): about 1 for texts of the language and
about 0 for letters at random.  keep_identified rejects what is less alike than ``LEAST_LIKENESS``, with an allowance of
``NOISE`` over the root of the number of trigrams for chance, so that short texts are never rejected for it.

Defined results: ``und`` and score 0 for a null text, one without a letter (Unicode category L), or where nothing
could be learned; equal cosines go to the language that comes first; repeated rows are judged each; a row with a null
doc_id is held out; other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import _scan
from quillon.llm._spark import lean

DIMENSIONS = 4096
UNKNOWN = "und"
LEAST_LIKENESS, NOISE = 0.3, 2.0
#: Trigrams whose dot products a process keeps, the first that it meets.
KEPT = 1 << 17
MOST_LANGUAGES = 1000
#: Tasks that may share a language's trigrams.
PARTS = 8
_SEED = 20_011
_LETTER = np.full(0x110000, -1, np.int32)


def _letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters as code points, 0 for anything else and around each text; and the n + 1 places at which texts begin."""
    try:
        text = data.tobytes().decode("utf-8")
    except UnicodeDecodeError:  # bytes that aren't text count as one strange character each run
        texts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(off[:-1], off[1:], strict=True)]
        off = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        text = data.tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    new = np.unique(points[_LETTER[points] < 0])
    for c in new.tolist():
        low = chr(c).lower()
        _LETTER[c] = (ord(low) if len(low) == 1 else c) if chr(c).isalpha() else 0
    bound = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), off)
    out = np.zeros(len(points) + len(off), np.int64)
    out[np.arange(len(points)) + np.repeat(np.arange(1, len(off)), np.diff(bound))] = _LETTER[points]
    return out, bound + np.arange(len(bound))


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all trigrams (21 bits a letter) and the n + 1 places at which each text's begin."""
    letters, bound = _letters(data, off)
    middle = np.flatnonzero(letters)
    keys = (letters[middle - 1] << 42) | (letters[middle] << 21) | letters[middle + 1]
    return keys.view(np.uint64), np.searchsorted(middle, bound)


def _signs(points: np.ndarray) -> np.ndarray:
    """(points, DIMENSIONS) random signs."""
    words = DIMENSIONS // 64
    bits = _scan.mix64(points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + np.uint64(_SEED << 40))
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def bound_vectors(keys: np.ndarray) -> np.ndarray:
    """(keys, DIMENSIONS) vectors of trigrams."""
    mask = np.uint64((1 << 21) - 1)
    points, which = np.unique(np.stack([keys >> np.uint64(42), (keys >> np.uint64(21)) & mask, keys & mask]), return_inverse=True)
    signs = _signs(points)
    first, second, third = which.reshape(3, -1)
    return np.roll(signs, 2, axis=1)[first] * np.roll(signs, 1, axis=1)[second] * signs[third]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        for i, j, data, off in _scan.chunks(batch.column("text")):
            keys, bound = trigrams(data, off)
            lang = np.repeat(code[i:j], np.diff(bound))
            for k in np.unique(lang):
                found, n = np.unique(keys[lang == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[int(k)].as_py()] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "trigram", "n"])


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    count: dict[str, int] = {}
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        keys, n = batch.column("trigram").to_numpy().view(np.uint64), batch.column("n").to_numpy().astype(np.float64)
        for name in sorted(set(lang)):
            own = np.flatnonzero(lang == name)
            for i in range(0, len(own), 512):
                part = own[i : i + 512]
                total[name] = total.get(name, 0.0) + n[part] @ bound_vectors(keys[part])
                count[name] = count.get(name, 0) + int(n[part].sum())
    names = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x] for x in names], pa.list_(pa.float64())), pa.array([count[x] for x in names], pa.int64())], ["lang", "vector", "n"])


def prototypes(texts: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, their prototypes and numbers of trigrams, from columns lang and text; at most ``PARTS`` vectors a language come to the driver,
    and more than ``MOST_LANGUAGES`` languages are an error."""
    counts = texts.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_counted), "lang string, trigram long, n long")
    counts = counts.groupBy("lang", "trigram").agg(F.sum("n").alias("n"))
    if (several := texts.where("lang is not null").agg(F.approx_count_distinct("lang")).first()[0]) > MOST_LANGUAGES:
        raise ValueError(f"about {several} languages to learn; at most {MOST_LANGUAGES} are allowed")
    # sums of whole numbers, so a language's distinct trigrams may be bundled in parts
    parts = counts.repartition("lang", F.pmod(F.col("trigram"), F.lit(PARTS))).mapInArrow(lean(_bundled), "lang string, vector array<double>, n long")
    found: dict[str, np.ndarray] = {}
    total: dict[str, int] = {}
    for row in parts.collect():
        found[row["lang"]] = found.get(row["lang"], 0.0) + np.array(row["vector"])
        total[row["lang"]] = total.get(row["lang"], 0) + row["n"]
    names = sorted(found)
    return names, np.array([found[x] for x in names]).reshape(len(names), DIMENSIONS), np.array([total[x] for x in names])


class Comparer:
    """Dot products of trigram vectors with prototypes of length 1."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).T
        self.index = _scan.HashIndex()
        self.dots = np.zeros((0, vectors.shape[0]))

    def _new(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([bound_vectors(keys[i : i + 512]).astype(np.float64) @ self.vectors for i in range(0, len(keys), 512)])

    def similarities(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) dot products, and the number of trigrams of each text, which is 0 without a letter."""
        keys, bound = trigrams(data, off)
        place = self.index.find(keys)
        new = np.flatnonzero(place < 0)
        dots = self.dots
        if len(new):
            distinct, which = np.unique(keys[new], return_inverse=True)
            place[new] = len(dots) + which
            dots = np.concatenate([dots, self._new(distinct)])
            room = max(0, KEPT - len(self.index))
            self.index.add(distinct[:room])
            self.dots = dots[: len(self.index)]
        out = np.stack([_scan.sum_by(dots[place, k], bound) for k in range(self.vectors.shape[1])], axis=1)
        return out, np.diff(bound)


class Predictor:
    """Names and scores of texts, in a task."""

    def __init__(self, names: list[str], vectors: np.ndarray, counts: np.ndarray) -> None:
        self.names = np.array([*names, UNKNOWN], object)
        self.comparer = Comparer(vectors) if names else None
        self.own = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12) / np.maximum(counts, 1) if names else np.zeros(0)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, and likeness with the allowance for chance."""
        pred, score, likeness = np.full(len(column), UNKNOWN, object), np.zeros(len(column)), np.zeros(len(column))
        if self.comparer is not None:
            for i, j, data, off in _scan.chunks(column):
                found, n = self.comparer.similarities(data, off)
                found, has = np.maximum(found, 0.0), n > 0
                rows = np.arange(j - i)
                best = found.argmax(axis=1)
                top = found[rows, best]
                found[rows, best] = 0.0
                with np.errstate(invalid="ignore"):
                    score[i:j] = np.where(has, np.nan_to_num(top / (top + found.max(axis=1))), 0.0)
                pred[i:j] = self.names[np.where(has, best, -1)]
                n = np.maximum(n, 1)
                likeness[i:j] = top / n / self.own[best] + NOISE / np.sqrt(n)
        return pred, score, likeness


def predict(documents: DataFrame, names: list[str], vectors: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id and held_out of documents (which also have text), with lang_pred and score."""
    model = documents.sparkSession.sparkContext.broadcast((names, vectors, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(*model.value)
        for batch in batches:
            pred, score, _ = predictor(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return documents.select("doc_id", "held_out", "text").mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def _learning() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(False))


def keep_identified(documents: DataFrame, least_score: float, least_likeness: float = LEAST_LIKENESS) -> DataFrame:
    """The documents whose language is told with at least this score and likeness, with all their columns and lang as predicted.

    Null texts and texts without a letter go, repeated rows are judged each, rows with a null doc_id don't teach, with nothing to learn from all
    go, and an empty table gives no rows.
    """
    names, vectors, counts = prototypes(documents.where(_learning()).select("lang", "text"))
    model = documents.sparkSession.sparkContext.broadcast((names, vectors, counts))
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(*model.value)
        for batch in batches:
            pred, score, likeness = predictor(batch.column("text").cast(pa.string()))
            own = dict(zip(columns, batch.columns, strict=True)) | {"lang": pa.array(pred, pa.string())}
            yield pa.RecordBatch.from_arrays([own[c] for c in columns], columns).filter(pa.array((pred != UNKNOWN) & (score >= least_score) & (likeness >= least_likeness)))

    return documents.mapInArrow(lean(run), documents.schema)


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns where crc32(doc_id as text) mod 5 is not 0."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", ~_learning())
    return predict(rows, *prototypes(rows.where("not held_out")))
