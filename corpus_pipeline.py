"""A training-data pipeline over documents: language ID, near duplicates, personal data, mixture, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the next stage's docs.  run()
applies them one after another to the table documents, each written as Parquet in the shared folder and read again,
so that a lost executor costs at most a stage's tasks and nothing is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import langid, mixing, pii
from quillon.llm._spark import new_path
from quillon.llm.minhash import one_of_each_text
from quillon.llm.packing import pack_documents
from quillon.session import ship

#: A document's share of its best two languages' cosines; 0.5 is a draw, and only texts without letters have less.
LEAST_SCORE = 0.5
#: Its likeness to the language told, about 1 for texts of the language and 0 for letters at random; short texts have an allowance.
LEAST_LIKENESS = 0.3

#: Packing works on token ids, and near duplicates on graph components: SQL expresses neither.
ORACLE_SQL = None


def _sent(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ship(spark)
    return docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language could be told, with lang as predicted.

    Null and empty texts, texts without letters, and long ones that are like no language that could be learned go; repeated rows are judged
    each; a null doc_id doesn't teach; an empty table stays empty.
    """
    return langid.keep_identified(_sent(spark, docs), LEAST_SCORE, LEAST_LIKENESS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id, null last; null and repeated ids take part.

    Texts without a word are copies of none; of rows equal in all columns one stays, unless they have neither a word nor a doc_id; an empty table stays empty.
    """
    return one_of_each_text(_sent(spark, docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; null and empty texts stay, repeated rows are redacted each, an empty table stays empty."""
    return pii.redact(_sent(spark, docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportion of the square roots of their bytes, by Poisson repetition; a document may come several times or not at all.

    A null source is a source of its own, one without bytes gets no copies; a null doc_id counts as one id, and rows that repeat an id come
    equally often; an empty table stays empty.
    """
    return mixing.replicate(_sent(spark, docs), keep_keys=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens; a null text is an empty one, repeated rows are packed each, no documents
    give no pieces."""
    return pack_documents(_sent(spark, docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
