import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import _scan, packing
from quillon.llm._bpe import SegmentEncoder
from quillon.llm.packing import pack_documents, slot_table, solve

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "  a  b", "a \n\n b\n", "foo\t bar", "x<|endoftext|>  y", "naïve café  日本 語。 नमस्ते दुनिया", "a  b  c", "\x1c \x1d !", "it's  'll\n  don't 12 345", "\n\n\n", "tail  "]


def test_segment_ids_are_the_library_s():
    import pyarrow as pa

    model, library = SegmentEncoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        data, off = _scan.text_buffers(pa.array(TEXTS))
        ids, bound = model.encode(data, off)
        for i, text in enumerate(TEXTS):
            assert ids[bound[i] : bound[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 1\n\t.é 　'日", max_size=40))
def test_segment_ids_on_mixed_white_space(text):
    data = np.frombuffer(text.encode(), np.uint8)
    ids, _ = _MODEL.encode(data, np.array([0, len(data)]))
    assert ids.tolist() == _LIBRARY.encode(text, add_special_tokens=False).ids


_MODEL, _LIBRARY = SegmentEncoder(PATH), Tokenizer.from_file(PATH)


def test_encoder_beyond_its_table(monkeypatch):
    import quillon.llm._bpe as bpe

    monkeypatch.setattr(bpe, "KEPT", 4)
    model = SegmentEncoder(PATH)
    for text in ["a b c", "a d e f", "a b c d e f g h", "x a"]:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = model.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == _LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_solution_holds_every_piece_and_is_near_the_bound(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    runs = solve(counts, 20)
    assert all(sum(bin_) <= 20 and n > 0 for bin_, n in runs)
    held: dict[int, int] = {}
    for bin_, n in runs:
        for x in bin_:
            held[x] = held.get(x, 0) + n
    assert held == counts
    assert sum(n for _, n in runs) <= 11 / 9 * _optimum_bound(lengths) + 1


def _optimum_bound(lengths):
    return max(-(-sum(lengths) // 20), sum(x > 10 for x in lengths))


def _brute(lengths, size):
    best = len(lengths)
    for order in itertools.permutations(lengths):
        bins = [0]
        for x in order:
            if bins[-1] + x > size:
                bins.append(0)
            bins[-1] += x
        best = min(best, len(bins))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=6))
def test_small_instances_against_brute_force(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    assert sum(n for _, n in solve(counts, 12)) <= _brute(lengths, 12) + (len(lengths) > 5)


def test_slots_are_distinct():
    runs = [((5, 5, 2), 3), ((5, 7), 2), ((7,), 1)]
    table = slot_table(runs, 12)
    seen = set()
    for x, n in {5: 8, 2: 3, 7: 3}.items():
        first, base, step, places, at = table[x]
        for rank in range(n):
            k = np.searchsorted(first, rank, "right") - 1
            r = rank - first[k]
            seen.add((base[k] + r // step[k], places[at[k] + r % step[k]]))
    assert len(seen) == 14


def _check(rows, documents, size):
    library = Tokenizer.from_file(PATH)
    want = sorted(([-1 if d is None else d, library.encode(t or "", add_special_tokens=False).ids + [2]]) for d, t in documents)
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r)
    for d, ids in want:
        own = sorted(pieces[d], key=lambda r: r.piece)
        if sum(1 for e, _ in want if e == d) > 1:
            continue
        assert [r.piece for r in own] == list(range(-(-len(ids) // size)))
        at = 0
        for r in own:
            assert r.start == at and (r.length == size or r.piece == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size


def test_whole_texts(spark):
    documents = [(1, None), (2, ""), (3, "a b c " * 500), (4, "x"), (5, "word " * 31 + "z"), (None, "null id"), (6, "tie"), (7, "tie"), (8, "twice"), (8, "twice"), (9, "longest " * 5000)]
    frame = spark.createDataFrame([(d, t, 0, "n") for d, t in documents], "doc_id long, text string, length int, pid string").repartition(3)
    rows = pack_documents(frame, PATH, size=32).collect()
    _check(rows, documents, 32)
    assert sum(r.doc_id == 8 for r in rows) == 2
    assert pack_documents(frame.where("false"), PATH).collect() == []


@pytest.mark.parametrize("size", [1024])
def test_real_documents(spark, sf_dir, size):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pack_documents(frame, PATH).collect()
    _check(rows, [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()], size)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.002 * -(-total // size) + 1


def _fewest(lengths, size):
    """The fewest bins, by trying every bin for each piece, the longest first."""
    order, best = sorted(lengths, reverse=True), len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best and i < len(order) or len(bins) > best:
            return
        if i == len(order):
            best = min(best, len(bins))
            return
        for k, room in enumerate(bins):
            if order[i] <= room and room not in bins[:k]:
                place(i + 1, [*bins[:k], room - order[i], *bins[k + 1 :]])
        place(i + 1, [*bins, size - order[i]])

    place(0, [])
    return best


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=10))
def test_what_dominance_fixes_costs_no_bin(lengths):
    left = packing._Left(Counter(lengths))
    fixed = packing.reduce_by_dominance(left, 12)
    assert all(sum(b) <= 12 and len(b) <= 3 for b, _ in fixed)
    rest = [x for x, n in left.count.items() for _ in range(n)]
    assert sorted(rest + [x for b, n in fixed for x in b for _ in range(n)]) == sorted(lengths)
    assert sum(n for _, n in fixed) + _fewest(rest, 12) == _fewest(lengths, 12)
