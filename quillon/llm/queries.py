"""One query for each operator of this subpackage, over whole tables with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import centroids, fingerprints, langid, mixing, outliers, pii, ppm, topk, variants
from quillon.llm._spark import new_path
from quillon.llm.minhash import near_duplicates
from quillon.llm.packing import pack_documents
from quillon.llm.sstable import read_shards, write_shards
from quillon.llm.token_counts import count_tokens
from quillon.session import ship


def _shipped(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, run with this package sent to the executors."""

    @wraps(run)
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(ship(spark), sf_dir)

    return call


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op3_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-shards")
    manifest = write_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_shards(manifest, folder)


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(_table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(_table(spark, sf_dir, "documents"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


_RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_maxscore_top_k": op2_maxscore_top_k,
    "op3_minhash_near_duplicates": op3_minhash_near_duplicates,
    "op4_ppm_scores": op4_ppm_scores,
    "op5_token_shards": op5_token_shards,
    "op6_poisson_mixing": op6_poisson_mixing,
    "op7_personal_data": op7_personal_data,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_multiset_fingerprints": op11_multiset_fingerprints,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_delta_lloyd": op13_delta_lloyd,
}

QUERIES = {name: _shipped(run) for name, run in _RUNS.items()}

ORACLES: dict[str, str] = {
    "op2_maxscore_top_k": topk.ORACLE,
    "op6_poisson_mixing": mixing.ORACLE,
    "op13_delta_lloyd": centroids.ORACLE,
}
