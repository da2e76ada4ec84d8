"""The queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import decontamination, mixing, oracles, quality
from fathom.llm.common import table
from fathom.llm.embedding_dedup import link_vectors
from fathom.llm.language_id import language_id
from fathom.llm.line_dedup import dedup_lines
from fathom.llm.minhash_dedup import near_duplicates
from fathom.llm.secrets import scan_secrets
from fathom.llm.substring_dedup import dedup_substrings
from fathom.llm.suffix_dedup import dedup_suffixes


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), run=2).drop("text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(table(spark, sf_dir, "documents"), length=50)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"), at_least=0.98)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), spans=True)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), window=35)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_decontamination, op3_suffix_dedup, op4_embedding_dedup, op5_secret_scan, op6_language_id, op7_substring_dedup, op8_source_mixing, op9_minhash_dedup, op10_quality_classifier)
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": oracles.LINES,
    "op2_decontamination": decontamination.ORACLE,
    "op3_suffix_dedup": oracles.SUFFIXES,
    "op4_embedding_dedup": oracles.VECTORS,
    "op7_substring_dedup": oracles.SUBSTRINGS,
    "op8_source_mixing": mixing.ORACLE,
    "op9_minhash_dedup": oracles.NEAR_DUPLICATES,
}
