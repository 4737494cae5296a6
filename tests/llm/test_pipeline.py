import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm.pii import masked, rule_spans
from tests.llm.test_minhash import brute


def _documents(spark):
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(60):
        letters, lang = ("abcdefg", "en") if i % 2 else ("pqrstuv", "de")
        rows.append([i, " ".join(word(letters) for _ in range(rng.randrange(10, 80))), lang, f"s{i % 3}"])
    rows[7][1] += " mail a.b@c.org or 10.1.2.3"
    rows += [[100, rows[3][1], "en", "s0"], [101, rows[4][1] + " qqq", "de", "s1"], [102, "12 34 !", "en", "s2"], [103, None, None, None], [104, "", "en", "s1"]]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_take_effect(spark, tmp_path):
    docs = _documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, str(tmp_path))
        if name != "packing":
            assert want.columns == docs.columns
        seen[name] = want.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    told = {r.doc_id for r in seen["language_id"]}
    assert told == set(texts) - {102, 103, 104}
    kept = {d for d, (_, c) in brute([(d, texts[d]) for d in told]).items() if c == d}
    assert {r.doc_id for r in seen["near_duplicates"]} == kept and 100 in told - kept
    assert {r.doc_id: r.text for r in seen["personal_data"]} == {d: masked(texts[d], rule_spans(texts[d])) for d in kept}
    assert any("[EMAIL]" in r.text for r in seen["personal_data"])
    mixed = [r.doc_id for r in seen["mixture"]]
    assert set(mixed) <= kept and len(mixed) > len(set(mixed))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in seen["packing"]) == sum(len(library.encode(r.text).ids) + 1 for r in seen["mixture"])


def test_run_is_the_stages_one_after_another(spark, tmp_path):
    _documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    want = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, str(tmp_path))
    rows = lambda frame: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in frame.collect())
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == rows(want)


def test_one_row_of_each_text_whatever_the_ids(spark, tmp_path):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abc"}
    a, b, c = texts.values()
    # (5, a) and (5, b) are unrelated texts under one id; copies of a and c have no id
    rows = [(3, a), (3, a), (5, a), (5, b), (7, b), (None, a), (None, c), (None, c), (None, c + " more"), (None, "lonely text here"), (None, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s0", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in got.collect())
    assert [g for g in got if g[0] != "None"] == [("3", a), ("5", b)]
    others = [g[1] for g in got if g[0] == "None"]
    assert len(others) == 5 and sorted(x for x in others if not x.startswith("c0")) == ["", "", "None", "lonely text here"]


def test_empty_input(spark, tmp_path):
    _documents(spark).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def _odd(spark):
    """Null and repeated ids, null and empty texts, equal rows, a very long text, and columns with the names that operators use inside."""
    long = " ".join(f"wort{i * 7919 % 5003}" for i in range(40_000))
    prose = "the quick brown fox jumps over a lazy dog while it rains in spain and nobody says a word "
    rows = [(1, prose * 3, "en", "s0"), (1, prose * 3, "en", "s0"), (1, prose * 4 + "x", "en", None), (None, prose * 2, None, "s1"), (None, prose * 2, None, "s1"), (None, None, "en", "s0"), (4, "", "en", "s1"), (5, long, "de", "s1"), (6, None, None, None), (7, "123 ... !", "en", "s0")]
    frame = spark.createDataFrame([(*r, None, 10 * i, "k", 3) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, copy long, key string, n int")
    return frame.repartition(3)


def test_every_stage_takes_odd_rows(spark, tmp_path):
    docs = _odd(spark)
    told = lambda frame, *names: sorted((str(tuple(r[n] for n in names)) for r in frame.collect()))
    all_rows = told(docs, "doc_id", "text", "copy")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name == "packing":
            pieces = got.collect()
            assert sum(r.piece == 0 for r in pieces) == docs.count()
            assert sum(r.doc_id is None for r in pieces) >= 3 and max(r.length for r in pieces) <= 1024
            continue
        assert got.columns == docs.columns
        rows = told(got, "doc_id", "text", "copy")
        if name == "language_id":
            assert set(rows) <= set(all_rows) and not any(r.startswith(("(4,", "(6,", "(7,")) for r in rows)
        if name == "near_duplicates":
            assert set(rows) <= set(all_rows) and sum(r.startswith("(1,") or "brown" in r for r in rows) < 5
        if name == "personal_data":
            assert len(rows) == len(all_rows) and told(got, "doc_id", "copy") == told(docs, "doc_id", "copy")
            assert max(len(r.text or "") for r in got.collect()) == max(len(r.text or "") for r in docs.collect())
        if name == "mixture":
            assert set(rows) <= set(all_rows)
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
