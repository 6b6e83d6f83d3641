"""The registered queries of this subpackage: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, oracles, secrets
from tidemark.llm.common import read_table
from tidemark.llm.contamination import contamination
from tidemark.llm.language import language_id
from tidemark.llm.lattice import document_likelihood
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.quality import quality_scores
from tidemark.llm.substrings import removal_report
from tidemark.llm.tokens import token_counts
from tidemark.llm.vectors import vector_duplicates


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(read_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read_table(spark, sf_dir, "documents"))


def op9_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_likelihood(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_substrings, op3_mixing, op4_vectors, op5_tokens, op6_contamination, op7_language, op8_secrets, op9_likelihood, op10_minhash)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator's whole result; language, tokens, likelihood and the learned score are tested otherwise."""
    return {
        "op2_substrings": oracles.SUBSTRINGS,
        "op3_mixing": mixing.oracle_sql(),
        "op4_vectors": oracles.VECTORS,
        "op6_contamination": oracles.CONTAMINATION,
        "op8_secrets": secrets.oracle_sql(),
        "op10_minhash": oracles.NEAR_DUPLICATES,
    }
