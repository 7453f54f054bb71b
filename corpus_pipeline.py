"""Corpus preparation: five stages from raw documents to packed sequences.

Every stage takes what the one before kept, written as Parquet and read again. The first four return the
columns of `documents`; `n_chars` follows the text wherever a stage changes it.
"""

from __future__ import annotations

import posixpath

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm import decontam, line_dedup, near_dup, packing, quality
from lexivec.llm.shared import saved


def _counted(docs: DataFrame) -> DataFrame:
    """The documents with the number of code points of their text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length("text").cast(kind))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without lines that are frequent in their host."""
    return _counted(quality.clean_documents(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that resemble earlier ones; those left without a word go."""
    return _counted(line_dedup.clean_documents(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of the benchmark, each judged by its own text."""
    benchmark = spark.read.parquet(posixpath.join(sf_dir, "benchmark.parquet"))
    return decontam.clean_documents(docs, benchmark, by_row=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokenizing is not an SQL operation; the result is tested against a plain version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of `sf_dir`."""
    docs = spark.read.parquet(posixpath.join(sf_dir, "documents.parquet"))
    for number, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
