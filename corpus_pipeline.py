"""A corpus pipeline: documents pass five stages, each one of the operators.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet to the shared folder and read back as the next stage's documents, so a
lost executor never costs more than the stage it interrupts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from svcops.llm import decontaminate, exact_dedup, language_id, mixing, simhash
from svcops.llm.common import read
from svcops.session import remove_path, scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: without a letter, with no language
    that holds half of the posterior, or too unlike all texts of their language."""
    return language_id.accepted(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets ``mix_rate``, how often the mixture takes it;
    documents of rate 0 go."""
    return mixing.mix(docs, read(spark, sf_dir, "labels"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: SQL has no classifier, SimHash or alignment; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that remain of ``documents`` after all stages."""
    docs, former = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if former:  # the next stage reads the new files only
            remove_path(spark, former)
        former = path
    return docs
