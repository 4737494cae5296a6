import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quillon.llm import variants
from quillon.llm.queries import QUERIES


def _words(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _neighbours(words):
    """By deletions: words one edit apart share a deletion, or one is a deletion of the other."""
    by = {}
    for w in words:
        for k in [w, *[w[:i] + w[i + 1 :] for i in range(len(w))]]:
            by.setdefault(k, set()).add(w)
    near = {w: set() for w in words}
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if b != a and b not in near[a] and _one_edit(a, b)}
    return near


def brute(rows):
    words = _words(rows)
    near, out, forms = _neighbours(words), {}, {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, n, len(near[w]), None if forms[w] is None else words[forms[w]])
    return out


def _got(frame):
    rows = frame.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_documents_against_python(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(rows)
    assert _got(QUERIES["op12_spelling_variants"](spark, sf_dir)) == want
    assert sum(w[0] is not None for w in want.values()) > 20


def _variants(seed=3, n=400):
    rng = random.Random(seed)
    words = {}
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randrange(6, 14))) for _ in range(60)] + ["x" * 100, "ÿ" * 70 + "a" * 30, "prefix" * 20]
    for _ in range(n):
        w = rng.choice([*stems, *words] if words else stems)
        k, kind = rng.randrange(len(w) + 1), rng.randrange(3)
        w = w[:k] + rng.choice("abcé÷") + w[k + (kind > 0) :] if kind < 2 else w[:k] + w[k + 1 :]
        if len(w) >= 6:
            words[w] = rng.choice([5, 6, 30, 200, 5000])
    return words


def test_near_words_whatever_the_shards(spark):
    words = _variants()
    near = _neighbours(words)
    want = {w: (len(x), *max((words[y], [-ord(c) for c in y], y) for y in x)[::2]) for w, x in near.items() if x}
    want = {w: (m, min((-words[y], y) for y in near[w])) for w, (m, *_) in want.items()}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    for halves in (50_000, 40, 7):  # one shard, several, beginnings and ends with shards of their own
        got = {r.word: (r.near, (-r.best_n, r.best)) for r in variants.near_words(frame, halves).collect()}
        assert got == want


def test_forms_lead_to_roots(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)] + [("v", "w20"), ("u", "v")], "word string, form string")
    assert {r.root for r in variants.roots(chain).collect()} == {"w21"}
    assert variants.roots(chain.where("false")).collect() == []


def test_odd_rows(spark):
    long = "a" * 3000
    rows = [(1, None), (2, ""), (None, "Straße STRASSE strasse " * 5), (3, ("Straße ×÷×÷×÷ " + "kitten sitten " * 3) * 4), (3, "kitten " * 9), (3, "kitten " * 9), (4, f"{long} {long[1:]} " * 5), (5, "x1y2 abc_def 漢字漢字漢字漢")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("own"), "n": F.lit(1)}).repartition(4)
    assert _got(variants.group_variants(frame)) == brute(rows)
    assert variants.group_variants(frame.where("false")).collect() == []
