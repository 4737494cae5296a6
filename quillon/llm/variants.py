"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by Aho-Corasick over word halves.

1. Runs of letters are counted text by text; a task adds up what it has seen in a table of bounded size before it hands it on.
2. A word that differs from another by one edit holds one of its halves unchanged: the first at its beginning or the second at its end.
   Each word's halves go to automaton shards, the first by the word's first three code points and the second by its last three; so a word
   needs to be scanned by the shards of its own beginning and end alone.  A shard has about ``HALVES`` halves; a beginning or an end
   with more has shards of its own, each of which scans all its words.
3. A shard builds one automaton of its halves, scans its words, keeps matches at the right offset to words whose length differs
   by one at most, and verifies the distance.  A pair is counted by its first half if that is unchanged, else by its second.
   A word's near words are counted and the best kept in the shard; pairs don't leave it.
4. A word's form is its most frequent near word, if that is ``RATIO`` times as frequent; roots are found by doubling, each round following twice as many forms.

Defined results: null and empty texts have no words; a null doc_id is written as nothing in a run's hash; rows that repeat a document count each;
runs of any length are words, long ones compared one by one; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._spark import cut, lean

#: Fixed values of the contract.
LEAST_LENGTH, LEAST_COUNT, RATIO, SPOILT = 6, 5, 5, 199
RUNS = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)

#: Halves of a shard's automaton, about.
HALVES = 50_000
#: Distinct words that a task adds up before it hands them on.
HELD = 200_000
#: Words up to this length are compared as rows of a matrix.
WIDE = 48
_PAIRS = 1 << 17


# --- words -------------------------------------------------------------------------------------------------------


def _spoil(run: str, seed: int) -> str:
    """The run as it counts: one of its code points goes if SPOILT divides its hash."""
    h = zlib.crc32(run.encode(), seed)
    if h % SPOILT:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return batch

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if not text.is_valid:
                continue
            # bytes lower A-Z alone
            text = text.as_buffer().to_pybytes().lower().decode("utf-8", "replace")
            seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(RUNS.findall(text)).items():
                word = _spoil(run, seed)
                if len(word) >= LEAST_LENGTH:
                    held[word] = held.get(word, 0) + n
            if len(held) >= HELD:
                yield out()
    yield out()


def words(documents: DataFrame) -> DataFrame:
    """word and n: the words of at least LEAST_LENGTH code points that occur LEAST_COUNT times or more."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    counts = rows.mapInArrow(lean(_counted), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- shards ------------------------------------------------------------------------------------------------------


class _Words:
    """Words as matrices of code points from the left and from the right, so that pairs are compared as rows."""

    def __init__(self, found: list[str]) -> None:
        self.words, self.size = found, np.array([len(w) for w in found], np.int32)
        wide = min(WIDE, int(self.size.max(initial=1)))
        self.left, self.right = np.zeros((len(found), wide), np.uint8), np.zeros((len(found), wide), np.uint8)
        for i, w in enumerate(found):
            if len(w) <= wide:
                codes = np.frombuffer(w.encode("latin-1"), np.uint8)
                self.left[i, : len(w)] = codes
                self.right[i, : len(w)] = codes[::-1]


def _run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places from the first on the rows agree."""
    k = min(a.shape[1], b.shape[1])
    differ = a[:, :k] != b[:, :k]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), k)


def _common(a: str, b: str) -> int:
    """How many code points two strings share at their beginnings, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _ends(a: _Words, x: np.ndarray, b: _Words, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common beginnings and ends of the words a[x] and b[y]."""
    least = np.minimum(a.size[x], b.size[y])
    first, last = np.minimum(_run(a.left[x], b.left[y]), least), np.minimum(_run(a.right[x], b.right[y]), least)
    for k in np.flatnonzero(np.maximum(a.size[x], b.size[y]) > min(a.left.shape[1], b.left.shape[1])):
        p, q = a.words[x[k]], b.words[y[k]]
        first[k], last[k] = _common(p, q), _common(p[::-1], q[::-1])
    return first, last


class Shard:
    """The halves of one shard's own words, and what their near words are as words are scanned."""

    def __init__(self, found: list[str], second: np.ndarray) -> None:
        """found: the words; second: whether it is a word's second half that the shard holds (else its first)."""
        self.own, self.second = _Words(found), second
        self.near = np.zeros(len(found), np.int64)
        self.best: list[tuple[int, str] | None] = [None] * len(found)
        held: dict[str, dict[tuple[bool, int], list[int]]] = {}
        for i, (w, end) in enumerate(zip(found, second.tolist(), strict=True)):
            half = w[len(w) // 2 :] if end else w[: len(w) // 2]
            held.setdefault(half, {}).setdefault((end, len(w)), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for half, owners in held.items():
            self.automaton.add_word(half, (len(half), {k: np.array(v, np.int64) for k, v in owners.items()}))
        if held:
            self.automaton.make_automaton()

    def scan(self, found: list[str], n: list[int], second: list[bool]) -> None:
        """Words of the shard with their counts; second: whether it is the word's end that brought it here."""
        if not len(self.automaton):
            return
        them, n = _Words(found), np.array(n, np.int64)
        xs: list[np.ndarray] = []
        ys: list[np.ndarray] = []
        many = 0
        for j, (w, end) in enumerate(zip(found, second, strict=True)):
            size = len(w)
            for at, (half, owners) in self.automaton.iter(w):
                if at + 1 != (size if end else half):  # the half must be at the word's end, or at its beginning
                    continue
                for other in (size - 1, size, size + 1):
                    own = owners.get((end, other))
                    if own is not None:
                        xs.append(own)
                        ys.append(np.full(len(own), j))
                        many += len(own)
            if many >= _PAIRS:
                self._verify(np.concatenate(xs), them, np.concatenate(ys), n)
                xs, ys, many = [], [], 0
        if many:
            self._verify(np.concatenate(xs), them, np.concatenate(ys), n)

    def _verify(self, x: np.ndarray, them: _Words, y: np.ndarray, n: np.ndarray) -> None:
        for i in range(0, len(x), _PAIRS):
            self._some(x[i : i + _PAIRS], them, y[i : i + _PAIRS], n)

    def _some(self, x: np.ndarray, them: _Words, y: np.ndarray, n: np.ndarray) -> None:
        first, last = _ends(self.own, x, them, y)
        a, b = self.own.size[x], them.size[y]
        near = np.where(a == b, first + last == a - 1, first + last >= np.minimum(a, b))
        near &= (~self.second[x]) | (first < a // 2)  # an unchanged first half counts elsewhere
        x, y = x[near], y[near]
        np.add.at(self.near, x, 1)
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            mine = (-int(n[j]), them.words[j])
            if self.best[i] is None or mine < self.best[i]:
                self.best[i] = mine

    def found(self) -> pa.RecordBatch:
        rows = np.flatnonzero(self.near).tolist()
        best = [self.best[i] for i in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.own.words[i] for i in rows], pa.string()), pa.array(self.near[rows], pa.int64()), pa.array([-b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string())],
            ["word", "near", "best_n", "best"],
        )


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come shard by shard, a shard's own words before the others; a task holds one shard and a batch."""
    key, own, shard = None, [], None

    def built() -> Shard:
        made = Shard([w for w, _, _ in own], np.array([s for _, _, s in own], bool))
        made.scan(*[list(x) for x in zip(*own, strict=True)])
        return made

    for batch in batches:
        keys = list(zip(batch.column("slot").to_pylist(), batch.column("sub").to_pylist(), strict=True))
        rows = list(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), batch.column("second").to_pylist(), strict=True))
        owns = batch.column("own").to_pylist()
        i = 0
        while i < len(rows):
            if keys[i] != key:
                if key is not None:
                    yield (shard or built()).found()
                key, own, shard = keys[i], [], None
            j = i
            while j < len(rows) and keys[j] == key and owns[j] == owns[i]:
                j += 1
            if owns[i]:
                own += rows[i:j]
            else:
                if shard is None:
                    shard = built() if own else Shard([], np.zeros(0, bool))
                shard.scan(*[list(x) for x in zip(*rows[i:j], strict=True)])
            i = j
    if key is not None:
        yield (shard or built()).found()


def near_words(found: DataFrame, halves: int = HALVES) -> DataFrame:
    """word, near, best_n and best of the words (word, n) that have near words: their number, and the most frequent (ties: the smallest)."""
    total = found.count()
    ends = found.select("word", "n", F.explode(F.array(F.struct(F.lit(False).alias("second"), F.substring("word", 1, 3).alias("tri")), F.struct(F.lit(True).alias("second"), F.substring("word", -3, 3).alias("tri")))).alias("e")).select("word", "n", "e.*")
    sizes = ends.groupBy("second", "tri").agg(F.count("*").alias("m")).where(F.col("m") > halves)
    # at most 2 * total / halves of them
    large = cut(sizes.select("second", "tri", F.ceil(F.col("m") / halves).cast("int").alias("subs")))
    side = F.broadcast(large) if large.count() <= 10_000 else large
    ends = ends.join(side, ["second", "tri"], "left")
    shards = max(1, -(-2 * total // halves))
    slot = F.when(F.col("subs").isNotNull(), F.concat(F.when(F.col("second"), "s").otherwise("p"), "tri")).otherwise(F.pmod(F.xxhash64("second", "tri"), F.lit(shards)).cast("string"))
    home = F.when(F.col("subs").isNotNull(), F.pmod(F.xxhash64("word"), F.col("subs"))).otherwise(0).cast("int")
    rows = ends.select(slot.alias("slot"), home.alias("home"), F.explode(F.sequence(F.lit(0), F.coalesce("subs", F.lit(1)) - 1)).alias("sub"), "second", "word", "n")
    rows = rows.select("slot", "sub", (F.col("home") != F.col("sub")).alias("other"), "second", "word", "n")
    rows = rows.repartition("slot", "sub").sortWithinPartitions("slot", "sub", "other").withColumn("own", ~F.col("other"))
    part = rows.select("slot", "sub", "own", "second", "word", "n").mapInArrow(lean(_scanned), "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best"))).alias("x")
    return part.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", (-F.col("x.minus")).alias("best_n"), F.col("x.best").alias("best"))


# --- forms and roots ---------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """word and root of links (word, form) that lead nowhere twice: the last of the words that following forms reaches."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = state.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        state = cut(joined)
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def group_variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of documents (doc_id, text)."""
    found = cut(words(documents))
    near = near_words(found)
    best = F.col("best_n") >= RATIO * F.col("n")
    rows = cut(found.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(best, F.col("best")).alias("form"), F.when(best, F.col("best_n")).alias("form_n")))
    ends = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
