import public_tokenizers
import pytest
import sentencepiece

from quillon.llm.token_counts import count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _want(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return sorted(((d is not None, d or 0, len((t or "").encode()), len(library.encode(t or ""))) for d, t in rows), key=str)


def _got(frame):
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in frame.collect()), key=str)


@pytest.mark.parametrize("sample,hot", [(8192, 1 << 19), (3, 4), (1, 0)])
def test_whole_texts(spark, sample, hot):
    rows = [(1, None), (2, ""), (3, " "), (4, "  a  b \n\n c"), (5, "x▁ y ▁▁z"), (6, "a" * 3000), (7, "\n"), (8, "日本語 テスト\t\x00x <s> </s> <unk>"), (9, "a \n b"), (9, "a \n b"), (None, "no id"), (10, "the cat " * 30_000)]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, token string, n long").repartition(3)
    assert _got(count_tokens(frame, PATH, sample_docs=sample, hot=hot)) == _want(rows)


def test_limit_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b c"), (2, "a")], "doc_id long, text string")
    assert {r.doc_id: r.over_limit for r in count_tokens(frame, PATH, limit=2).collect()} == {1: True, 2: False}
    assert count_tokens(frame.where("false"), PATH).collect() == []


def test_real_documents(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert _got(count_tokens(frame, PATH, sample_docs=50, hot=2000)) == _want([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])
