"""A corpus pipeline: language, near-duplicates, decontamination, secrets, mixing.

Every stage takes all that its predecessor kept and returns the columns of ``documents``; the
last adds n_tokens, weight and n_copies. ``run`` writes each stage as Parquet into a folder of
its own below ``spark.checkpoint.dir`` and reads it again, so a lost executor costs at most a
stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read_table, shared_folder
from tidemark.llm.contamination import decontaminated
from tidemark.llm.language import accepted
from tidemark.llm.minhash import first_of_each
from tidemark.llm.mixing import mixed
from tidemark.llm.secrets import redacted


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those unlike every language learned."""
    return accepted(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group."""
    return first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; no document goes."""
    return redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Says how often each document stands in the mix; no document goes."""
    return mixed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Language profiles, MinHash components and SimHash windows have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
