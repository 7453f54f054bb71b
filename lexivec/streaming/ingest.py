"""Documents that arrive as a stream are added to a stored keyword index."""

from __future__ import annotations

import json
import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexivec.operators.bm25 import (
    BM25Config,
    Index,
    corpus_totals,
    doc_lengths,
    precision_of,
    term_freq,
    term_stats,
)
from lexivec.operators.checks import require_columns
from lexivec.scale import BROADCAST_ROWS, is_small, materialise, partition_count

# Why a document was refused.
NO_ID, REPEATED, PRESENT = "no id", "repeated in the batch", "already present"


def _read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the index, or nothing where its folder does not exist yet."""
    try:
        return spark.read.parquet(posixpath.join(path, name))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _settings(config: BM25Config) -> str:
    """What counted frequencies and retained fields depend on."""
    return json.dumps([list(config.field_weights.items()), list(config.retained)])


def _check_settings(spark: SparkSession, config: BM25Config, path: str, write: bool) -> None:
    """An error if the index at `path` was counted with other field weights or retained fields."""
    found = _read(spark, path, "settings")
    if found is not None:
        if [r["settings"] for r in found.limit(2).collect()] != [_settings(config)]:
            raise ValueError(f"the index at {path} was built with other field weights or retained fields")
    elif write:
        row = spark.range(1).select(F.lit(_settings(config)).alias("settings"))
        row.coalesce(1).write.parquet(posixpath.join(path, "settings"))


def _add_batch(batch: DataFrame, batch_id: int, config: BM25Config, path: str, id_col: str, refuse: str = "record") -> None:
    spark = batch.sparkSession
    columns = list(dict.fromkeys([id_col, *config.field_weights, *config.retained]))
    batch = materialise(batch.select(*columns), "batch")
    # The smallest row of an id is taken, so a retried batch takes the same one.
    order = Window.partitionBy(id_col).orderBy(*(F.col(c) for c in columns))
    numbered = batch.filter(F.col(id_col).isNotNull()).withColumn("_nth", F.row_number().over(order))
    judged = numbered.withColumn("reason", F.when(F.col("_nth") > 1, F.lit(REPEATED))).drop("_nth")
    present = _read(spark, path, "documents")
    if present is not None:
        # A retried batch must not meet its own first attempt.
        present = present.filter(F.col("batch") != batch_id).select(F.col("doc_id").alias(id_col))
        ids = batch.select(id_col).distinct()
        if is_small(ids, BROADCAST_ROWS):
            present = F.broadcast(present.join(F.broadcast(ids), id_col, "left_semi"))
        known = present.distinct().withColumn("_known", F.lit(True))
        judged = judged.join(known, id_col, "left")
        judged = judged.withColumn("reason", F.when(F.col("_known"), F.lit(PRESENT)).otherwise(F.col("reason"))).drop("_known")
    nameless = batch.filter(F.col(id_col).isNull()).withColumn("reason", F.lit(NO_ID))
    judged = materialise(judged.unionByName(nameless), "judged")
    refused = judged.filter(F.col("reason").isNotNull())
    if refuse == "fail":
        first = refused.first()
        if first is not None:
            raise ValueError(f"document {first[id_col]!r} of batch {batch_id} is refused: {first['reason']}")
    refused.write.mode("overwrite").parquet(posixpath.join(path, "rejected", f"batch={batch_id}"))
    arrived = judged.filter(F.col("reason").isNull()).drop("reason")
    arrived = arrived.repartition(partition_count(arrived), id_col)
    for name, table in (("postings", term_freq(arrived, config, id_col)), ("documents", doc_lengths(arrived, config, id_col))):
        # Documents come last: an id counts as present only once its postings are written.
        target = posixpath.join(path, name, f"batch={batch_id}")
        table.write.mode("overwrite").parquet(target)


def ingest(
    documents: DataFrame, config: BM25Config, path: str, checkpoint: str, id_col: str = "doc_id",
    refuse: str = "record", first_batch: int = 0,
) -> DataStreamWriter:
    """A stream writer that adds each batch of documents to the index at `path`; start it with `.start()`.

    Documents without an id, with one that is already present or with one that the
    batch repeats are refused: written to `rejected` with the reason (see
    `rejected`), or, with `refuse="fail"`, an error before anything of the batch is
    added. Each batch has its own folder and replaces it when retried, so
    documents are added exactly once. An index keeps the field weights and retained
    fields that it was begun with; others are an error. Batches are numbered from
    `first_batch`: a stream with a checkpoint of its own must not reuse numbers of the index.
    """
    if refuse not in ("record", "fail"):
        raise ValueError("refuse must be record or fail")
    _check_settings(documents.sparkSession, config, path, write=True)
    require_columns(documents, [id_col, *config.field_weights, *config.retained])
    return (
        documents.writeStream.foreachBatch(lambda batch, n: _add_batch(batch, first_batch + n, config, path, id_col, refuse))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """The refused documents with `reason` and `batch`."""
    found = _read(spark, path, "rejected")
    if found is None:
        raise ValueError(f"no documents have been added at {path}")
    return found


def ingested_index(spark: SparkSession, config: BM25Config, path: str, precision: object = 4) -> Index:
    """The index over everything added so far; statistics are recomputed from the added tables."""
    _check_settings(spark, config, path, write=False)
    postings, documents = _read(spark, path, "postings"), _read(spark, path, "documents")
    if postings is None or documents is None:
        raise ValueError(f"no documents have been added at {path}")
    finished = documents.select("batch").distinct()
    if is_small(finished):
        finished = F.broadcast(finished)
    postings = postings.join(finished, "batch", "left_semi").drop("batch")
    documents = documents.drop("batch")
    totals = corpus_totals(documents)
    terms = term_stats(postings.select("term"), totals.select("documents").scalar(), config.k)
    return Index(config, precision_of(precision), postings, documents, terms, totals, occurrences=postings.select("term"))
