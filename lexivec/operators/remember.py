"""Scores of (query, text) pairs that are kept, so that a costly scorer sees no pair twice."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.scale import is_small, materialise, partition_count

SCORES = "pair binary, logit double"


@dataclass(frozen=True)
class ScoreMemory:
    """A folder of scored pairs. `model` names the scorer and its version: other models have scores of their own."""

    path: str
    model: str

    @property
    def folder(self) -> str:
        return posixpath.join(self.path, hashlib.sha256(self.model.encode()).hexdigest())


def pair_key(query: str = "query", text: str = "text"):
    """The SHA-256 of both texts. Their JSON form keeps a null apart from an empty text, and the two texts apart."""
    both = F.to_json(F.struct(F.col(query).alias("q"), F.col(text).alias("t")), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(both, 256))


def remembered(spark: SparkSession, memory: ScoreMemory) -> DataFrame:
    """The kept scores, `(pair, logit)`; no rows where nothing has been kept.

    Two jobs that ran at once may both have kept a pair.
    """
    try:
        return spark.read.schema(SCORES).option("recursiveFileLookup", True).parquet(memory.folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCORES)


def score_remembered(pairs: DataFrame, score: Callable[[DataFrame], DataFrame], memory: ScoreMemory) -> DataFrame:
    """Add the `logit` of each pair `(query, text, ...)`; only pairs that were never scored go to `score`.

    `score` adds `logit` to a table `(query, text)`. Each different pair is scored
    once, however often it stands in `pairs`, and is kept before the result is
    given. New scores are a folder of their own, written whole: a job that stops
    half-way keeps none or all of them, and its repetition is right in both cases. A
    changed text is another pair. `pairs` and the pairs to score are written, as
    both are read twice.
    """
    spark = pairs.sparkSession
    given = materialise(pairs.withColumn("_pair", pair_key()), "pairs")
    different = given.select(F.col("_pair").alias("pair"), "query", "text").dropDuplicates(["pair"])
    # The store may be far larger than the pairs, so small sets of pairs go to the store.
    keys = given.select(F.col("_pair").alias("pair")).distinct()
    small = is_small(keys)

    def known() -> DataFrame:
        found = remembered(spark, memory).join(F.broadcast(keys) if small else keys, "pair", "left_semi")
        return found.groupBy("pair").agg(F.min("logit").alias("logit"))

    seen = known().select("pair")
    unseen = different.join(F.broadcast(seen) if small else seen, "pair", "left_anti")
    # Spread by count, not by bytes: short pairs cost the scorer as much as long ones.
    unseen = materialise(unseen.repartition(partition_count(given), "pair"), "unseen")
    if not unseen.isEmpty():
        scored = score(unseen).select("pair", F.col("logit").cast("double"))
        scored.write.parquet(posixpath.join(memory.folder, uuid.uuid4().hex))
    kept = known().withColumnRenamed("pair", "_pair")
    return given.join(F.broadcast(kept) if small else kept, "_pair").drop("_pair")


def compacted(spark: SparkSession, memory: ScoreMemory, into: str) -> ScoreMemory:
    """The scores of a model in a new store at `into`, each pair once and in few files; the old store stays as it is."""
    fresh = ScoreMemory(into, memory.model)
    scores = remembered(spark, memory)
    scores = scores.groupBy("pair").agg(F.min("logit").alias("logit")).repartition(partition_count(scores), "pair")
    scores.write.parquet(posixpath.join(fresh.folder, uuid.uuid4().hex))
    return fresh
