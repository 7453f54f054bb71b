"""Queries that arrive as a stream are answered against a fixed corpus or index."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexivec.operators.bm25 import DEFAULT_LIMIT, Index, search
from lexivec.operators.nearest import DEMO_RESULTS, vector_topk_batch


def answer(
    queries: DataFrame, respond: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> DataStreamWriter:
    """A stream writer that answers each batch of queries with a batch search and stores the hits at `path`.

    Each batch has its own folder and replaces it when retried.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        respond(batch).write.mode("overwrite").parquet(posixpath.join(path, f"batch={batch_id}"))

    return (
        queries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )


def answer_vectors(
    queries: DataFrame,
    corpus: DataFrame,
    path: str,
    checkpoint: str,
    k: int = DEMO_RESULTS,
    above: float | None = None,
    **layout: int,
) -> DataStreamWriter:
    """Answer `(query_id, vector)` with the nearest corpus rows."""
    return answer(queries, lambda batch: vector_topk_batch(corpus, batch, k, above, **layout), path, checkpoint)


def answer_keywords(
    queries: DataFrame, index: Index, path: str, checkpoint: str, limit: int | None = DEFAULT_LIMIT
) -> DataStreamWriter:
    """Answer `(query_id, text)` with the best documents of a keyword index."""
    return answer(queries, lambda batch: search(index, batch, limit), path, checkpoint)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """All stored hits."""
    return spark.read.parquet(path).drop(F.col("batch"))
