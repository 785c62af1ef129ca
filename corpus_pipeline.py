"""A training corpus from ``documents``: quality, exact copies, near copies, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents``; the last returns
the mixture's words per document. ``run`` writes each stage as Parquet in the shared folder and reads it again, so a
stage starts from files and not from the lineage of those before it; what a stage wrote on its way is then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from colloquy.llm.common import folders_named, only_written, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs, keep="most")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken_words(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the classifier, so no stage after it either; the tests hold each stage against plain loops over its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = read_table(spark, sf_dir, "documents"), folders_named()
    for number, (_, stage) in enumerate(STAGES):
        docs = only_written(stage(spark, docs, sf_dir), f"stage-{number}", since)
    return docs
