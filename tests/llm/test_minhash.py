import random

import numpy as np
import pytest

from quillon.llm import _scan, minhash
from quillon.llm.minhash import components, least_estimate, minima, near_duplicates, one_of_each, one_of_each_text, pack, shingles, similarity


def _set(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """(n_shingles, component_id) of distinct doc_ids, all pairs."""
    sets = {d: _set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def _frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, sig string, n long").repartition(3)


def _near(base, rng, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**9)}"
    return " ".join(words)


def test_real_documents(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame).collect()}
    assert got == brute([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])


@pytest.mark.parametrize(("block", "split", "size", "members"), [(512, 51_200, 16 << 20, 1000), (8, 51_200, 16 << 20, 1000), (8, 8, 16 << 20, 7), (512, 51_200, 12_000, 7), (512, 8, 12_000, 7)])
def test_a_large_group_of_near_copies_with_pairs_on_both_sides_of_the_threshold(spark, monkeypatch, block, split, size, members):
    for name, value in (("BLOCK", block), ("SPLIT", split), ("BLOCK_BYTES", size), ("MEMBERS", members)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(3)
    base = " ".join(f"b{rng.randrange(10**6)}" for _ in range(150))
    other = " ".join(f"c{rng.randrange(10**6)}" for _ in range(150))
    rows = [(i, _near(base, rng, rng.randrange(0, 8))) for i in range(150)] + [(500 + i, _near(other, rng, rng.randrange(1, 6))) for i in range(100)]
    rows += [(1000 + i, base) for i in range(50)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(_frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_pairs_at_the_threshold_meet_in_a_finer_band():
    rng = np.random.default_rng(11)
    for _ in range(300):
        both, own = rng.integers(0, 2**63, 150, dtype=np.uint64), rng.integers(0, 2**63, 50, dtype=np.uint64)
        values = np.concatenate([both, own[:25], both, own[25:]])  # 150 of 200 in common
        keys = minhash.band_keys(minhash.minima(values, np.array([0, 175])), minhash.FINE, minhash.FINE_ROWS)
        assert (keys[0] == keys[1]).any()


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one  TWO"), (6, "one two three four five"), (7, "ONE two three four five"), (8, "É x"), (9, "é x"), (10, "w " * 50_000), (11, "w " * 5)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(_frame(spark, rows)).collect()}
    want = brute(rows)
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}
    assert got[5][1] == 4 and got[11][1] == 10 and got[9][1] == 9


def test_repeated_rows_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (3, a), (5, a), (5, b), (7, b), (None, a), (None, "lonely text here"), (None, None)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(_frame(spark, rows)).collect())
    assert got == sorted([("3", 36, "3", True)] * 2 + [("5", 36, "3", False)] * 2 + [("7", 36, "3", False), ("None", 36, "3", False), ("None", 1, "None", True), ("None", 0, "None", True)])
    kept = sorted((str(r.doc_id), str(r.text)) for r in one_of_each(_frame(spark, rows)).collect())
    assert [k[0] for k in kept] == ["3", "None", "None", "None"]


def test_empty_table(spark):
    assert near_duplicates(_frame(spark, [(1, "a")]).where("false")).collect() == []


def test_one_of_each_keeps_columns(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "x")]
    kept = one_of_each(_frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "sig", "n"] and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 180)] + [(0, i) for i in range(1, 50)] + [(300, 200), (200, 300), (7, 7)]
    rng.shuffle(links)
    got = {r.u: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 181)}, **{i: 0 for i in range(1, 50)}, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("share", [0.3, 0.6, 0.75, 0.9])
def test_estimates_are_near_the_similarity(share):
    rng = np.random.default_rng(2)
    found = []
    for _ in range(40):
        x = rng.integers(0, 2**63, 400, dtype=np.uint64)
        k = int(round(2 * share / (1 + share) * 200))
        sets = [x[:200], np.concatenate([x[:k], x[200 : 400 - k]])]
        sig = pack(minima(np.concatenate(sets), np.array([0, 200])))
        found.append(similarity(sig[:1], sig[1:])[0])
    assert abs(np.mean(found) - share) < 0.02 and np.std(found) < 0.06
    assert least_estimate(0.75) < 0.65


def test_shingles_lower_ascii_only():
    data, off = _scan.text_buffers(__import__("pyarrow").array(["A B C D E", "a b c d e", "a b c d É", "a b c d é", None]))
    values, bound = shingles(data, off)
    assert np.diff(bound).tolist() == [1, 1, 1, 1, 0] and values[0] == values[1] and values[2] != values[3]


def test_columns_with_the_names_used_inside_survive(spark):
    rows = [(1, "a b c d e f", 7, "p", 1), (2, "A b c d e f", 8, "q", 2), (None, "a b c d e f", 9, "r", 3), (None, "lonely words", 1, "s", 4), (None, "lonely words", 1, "s", 4), (3, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __key int, __pointed string, __k int").repartition(3)
    kept = one_of_each_text(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[5]], key=str)
    assert sorted(map(tuple, one_of_each(frame).collect()), key=str)[:1] == [rows[0]]
    assert one_of_each_text(frame.where("false")).collect() == []
