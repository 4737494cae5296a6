import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import _scan, ppm
from quillon.llm.ppm import ORDER, pair_codes, score

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _learned(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def brute(rows):
    trie = defaultdict(Counter)
    words, n = Counter(), 0
    for d, t in rows:
        if _learned(d):
            s = [257] * ORDER + list((t or "").encode().translate(LOWER)) + [256]
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    trie[tuple(s[i - k : i])][s[i]] += 1
            own = [*(t or "").encode().translate(LOWER).split(), None]
            words.update(own)
            n += len(own)
    cache = {}

    def cost(context, symbol):
        if (context, symbol) not in cache:
            logp, gone = 0.0, set()
            for k in range(ORDER, -1, -1):
                c = trie.get(context[ORDER - k :])
                if c is None:
                    continue
                left = {x: m for x, m in c.items() if x not in gone}
                if not left:
                    continue
                total = sum(left.values()) + len(left)
                if symbol in left:
                    logp += math.log10(left[symbol] / total)
                    break
                logp += math.log10(len(left) / total)
                gone |= set(left)
            else:
                logp -= math.log10(257 - len(gone))
            cache[context, symbol] = logp
        return cache[context, symbol]

    out = []
    for d, t in rows:
        s = [257] * ORDER + list((t or "").encode().translate(LOWER)) + [256]
        own = [*(t or "").encode().translate(LOWER).split(), None]
        base = sum(math.log10((words[w] + 1) / (n + len(words) + 1)) for w in own)
        out.append((str(d), not _learned(d), len(own), sum(words[w] > 0 for w in own), n, base, sum(cost(tuple(s[i - ORDER : i]), s[i]) for i in range(ORDER, len(s)))))
    return sorted(out, key=str)


def _same(frame, rows, **options):
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score(frame, **options).collect()), key=str)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("hot,sample", [(1 << 19, 8192), (40, 5), (0, 1)])
def test_documents(spark, sf_dir, hot, sample):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _same(frame, [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()], hot=hot, sample_docs=sample)


def test_edges(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "a", "Abc abc", "é\n\tx y", "zz" * 5000, "q", "rare ŵords", "abc", "abd abe"])] + [(3, "Abc abc"), (None, "null id"), (50, "a b c d"), (51, "abca abcb")]
    frame = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, score int, word string").repartition(3)
    _same(frame, rows)
    _same(frame, rows, hot=3, sample_docs=4)
    assert score(frame.where("false")).collect() == []


def test_nothing_learned(spark):
    ids = [i for i in range(60) if not _learned(i)][:3]
    _same(spark.createDataFrame([(i, "ab") for i in ids], "doc_id long, text string"), [(i, "ab") for i in ids])


def test_codes():
    codes, bound = pair_codes(*_scan.text_buffers(pa.array(["aB", None, "c"])))
    assert bound.tolist() == [0, 3, 4, 6] and (codes & 511).tolist() == [97, 98, 256, 256, 99, 256]
    assert ((codes >> 9) & 511).tolist() == [257, 97, 98, 257, 257, 99] and ppm.START == 257
