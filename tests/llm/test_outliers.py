import random
import re
from collections import Counter

import numpy as np

from quillon.llm import outliers
from quillon.llm.outliers import base_statistics, quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def _stats(frame):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in base_statistics(frame).collect()}


def test_base_statistics_of_odd_texts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n \n", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\x0by\x0cz\x1fq", "é| ü<>\n\né| ü<>\n é| ü<>", "   x", "# $ %\n# $ %\n"]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in (10, 60, 3000)] + [" ".join(str(rng.randrange(60)) for _ in range(20_000))]
    frame = spark.createDataFrame([(i, t, "en", "s", 3, "w") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, g int, words string")
    assert _stats(frame) == {i: brute(t) for i, t in enumerate(texts)}


def test_base_statistics_of_documents(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert _stats(frame) == {r.doc_id: brute(r.text) for r in frame.select("doc_id", "text").collect()}


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_outliers_go_and_others_stay(spark):
    rng = random.Random(7)
    rows = [(i, _prose(rng, int(rng.lognormvariate(5.5, 0.6)) + 60), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, re.sub(" ", "### ", _prose(rng, 200)), "en", "s0") for i in range(12)]
    rows += [(2000, None, None, None), (2001, _prose(rng, 100), "xx", None), (2002, "a b c " * 100, "en", "s1"), (2003, _prose(rng, 20), "en", "s1"), (None, _prose(rng, 200), "en", "s1"), (5, rows[5][1], "en", "s1")]
    got = quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(12))
    assert kept[2001] and not kept[2000] and not kept[2002] and not kept[2003] and kept[None]
    assert {r.doc_id: r.base_failed for r in got}[2002]


def test_verdicts_do_not_depend_on_partitions(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = {r.doc_id: (r.kept, r.d2) for r in quality(frame.coalesce(1)).collect()}
    assert one == {r.doc_id: (r.kept, r.d2) for r in quality(frame.repartition(7)).collect()}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality(frame).collect() == []


def test_distances_are_mahalanobis(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) * 3000).round().astype(int)
    rows = spark.createDataFrame([(1, *map(int, r)) for r in x], "g long, z0 long, z1 long, z2 long, z3 long, z4 long")
    fit = outliers._fit(rows.selectExpr("*", "1 as w"), ["g"])
    cov = np.cov(x.T, bias=True)
    assert abs(2 * fit.first().logdet - np.linalg.slogdet(cov)[1]) < 1e-6
    d = (x - x.mean(axis=0))[np.lexsort(x.T[::-1])]
    want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)
    for few in (True, False):
        got = np.array([r.d2 for r in outliers._distances(rows, fit.drop("logdet"), few).orderBy("z0", "z1", "z2", "z3", "z4").collect()])
        assert np.allclose(got, want)


def _mcd(x, support):
    """Concentration steps from many random subsets: the least determinant that a plain search finds."""
    rng = np.random.default_rng(0)
    h, best = int(np.ceil(len(x) * support)), np.inf
    for _ in range(40):
        own = rng.permutation(len(x))[: max(h // 4, 8)]
        for _ in range(30):
            d = x - x[own].mean(axis=0)
            d2 = np.einsum("ij,jk,ik->i", d, np.linalg.inv(np.cov(x[own].T, bias=True)), d)
            own = np.argsort(d2)[:h]
        best = min(best, np.linalg.slogdet(np.cov(x[own].T, bias=True))[1] / 2)
    return best


def test_the_estimate_is_near_the_least_determinant_and_withstands_outliers(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(400, 5)) @ np.diag([2000, 900, 700, 300, 300]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    bad = rng.normal(size=(90, 5)) * 100 + np.array([9000, 9000, -9000, 5000, 5000])
    x = np.concatenate([good, bad]).round().astype(int)
    rows = spark.createDataFrame([(1, i, *map(int, r)) for i, r in enumerate(x)], "g long, doc_id long, z0 long, z1 long, z2 long, z3 long, z4 long")
    fit = outliers.least_fits(rows, True)
    found = sum(np.log(fit.first()[f"l{i}{i}"]) for i in range(5))
    assert found <= _mcd(x.astype(float), outliers.SUPPORT) + 0.15
    far = {r.doc_id: r.d2 for r in outliers.robust_distances(rows).select("doc_id", "d2").collect()}
    assert min(far[i] for i in range(400, 490)) > outliers.CHI2_FAR and sum(far[i] > outliers.CHI2_FAR for i in range(400)) <= 2


def test_each_statistic_rejects_by_itself(spark):
    rng = random.Random(3)
    rows = [(i, _prose(rng, rng.randrange(150, 400)), "en", "s") for i in range(200)]
    long_words = " ".join("".join(rng.choice("abcdefghij") for _ in range(60)) for _ in range(200))
    symbols = re.sub(" ", "# ", _prose(rng, 200))
    lines = "\n".join(["ab cd"] * 15) + "\n" + _prose(rng, 120)
    windows = _prose(rng, 110) + " " + "q w e r t y u i o p l k j h g f d s a z x c v b n m m n b v c x z q " * 2
    odd = {900: long_words, 901: symbols, 902: lines, 903: windows}
    rows += [(i, t, "en", "s") for i, t in odd.items()]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i].base_failed for i in odd) and not any(got[i].kept for i in odd)
    assert all(got[i].kept for i in range(200))


def test_many_groups_take_the_salted_way_with_the_same_verdicts(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = {(r.doc_id, r.kept) for r in quality(frame).collect()}
    assert few == {(r.doc_id, r.kept) for r in quality(frame, few_groups=0).collect()}
