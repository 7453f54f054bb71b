"""Standing queries: documents arrive as a stream, and each query keeps its best hits so far."""

from __future__ import annotations

import math
import posixpath
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from lexivec.operators.nearest import DEMO_RESULTS, PLACES, similarities
from lexivec.scale import BROADCAST_BYTES, BROADCAST_ROWS, is_small, measure

# The state store that keeps state outside the memory of the JVM, and that lists of state need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _BestHits(StatefulProcessor):
    """Holds the best `k` hits of one query; gives them anew whenever one of them changes."""

    def __init__(self, k: int, held: T.StructType):
        self.k, self.schema = k, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", self.schema)

    def _cut(self, hits: pd.DataFrame) -> pd.DataFrame:
        return hits.sort_values(["sim", "id"], ascending=[False, True], kind="stable").head(self.k)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = pd.DataFrame(list(self.held.get()), columns=["id", "sim"])
        best = before
        for arrived in rows:
            # One batch of arrivals at a time, so a query never holds more than that and its best.
            arrived = arrived[["id", "sim"]]
            best = self._cut(arrived if best.empty else pd.concat([best, arrived]))
        best = best.reset_index(drop=True)
        if len(best) == len(before) and (best["id"].tolist(), best["sim"].tolist()) == (before["id"].tolist(), before["sim"].tolist()):
            return
        self.held.put([(hit.id, float(hit.sim)) for hit in best.itertuples(index=False)])
        best.insert(0, "query_id", key[0])
        yield best.assign(rank=np.arange(1, len(best) + 1, dtype=np.int32))

    def close(self) -> None:
        pass


def _most_queries(k: int) -> int:
    # The limit under which `similarities` ships queries: larger ones would need a grid, which a stream cannot have.
    return min(BROADCAST_ROWS, BROADCAST_BYTES // (32 * k))


def query_sets(queries: DataFrame, k: int = DEMO_RESULTS) -> list[DataFrame]:
    """`queries(query_id, vector)` in as few sets as may each be registered in a stream of its own; an id is in one set."""
    rows, size = measure(queries.filter(F.col("vector").isNotNull()))
    share = max(rows / _most_queries(k), size / BROADCAST_BYTES)
    if share <= 1:
        return [queries]
    sets = math.ceil(share * 1.25)  # as hashes do not deal evenly
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == n) for n in range(sets)]


def best_so_far(
    documents: DataFrame, queries: DataFrame, k: int = DEMO_RESULTS, above: float | None = None, places: int = PLACES
) -> DataFrame:
    """A stream of `(query_id, id, sim, rank)`: the whole list of a query whenever one of its best `k` changes.

    `documents(id, vector)` is a stream and `queries(query_id, vector)` a table that
    is shipped to the tasks, so its size is checked: a larger one is an error, to be
    registered in several streams. A task passes on its best `k` arrivals of a
    query, and the state of a query is `k` rows, however many documents arrive.
    Ties go by id, and rows without a vector are never hits, as in `vector_topk_batch`;
    a row that arrives twice counts twice.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if not documents.isStreaming:
        raise ValueError("documents must be a stream; use vector_topk_batch for a table")
    queries = queries.filter(F.col("vector").isNotNull())
    if not is_small(queries, _most_queries(k)):
        raise ValueError("too many standing queries for one stream: register them in several")
    found = similarities(documents, queries, k, above, places)
    held = T.StructType([found.schema["id"], found.schema["sim"]])
    given = T.StructType([*found.schema.fields, T.StructField("rank", T.IntegerType())])
    return found.groupBy("query_id").transformWithStateInPandas(
        _BestHits(k, held), outputStructType=given, outputMode="Update", timeMode="None"
    )


def standing_queries(
    documents: DataFrame,
    queries: DataFrame,
    path: str,
    checkpoint: str,
    k: int = DEMO_RESULTS,
    above: float | None = None,
    places: int = PLACES,
) -> DataStreamWriter:
    """A stream writer that stores the changed lists of each batch at `path`; start it with `.start()`.

    The lists so far are the stream's state, kept at `checkpoint`: after a restart
    no earlier document is read again. Each batch has its own folder and replaces
    it when retried. A list that no arrival changed is not written again.
    The session must keep state in RocksDB (`use_state_store`).
    """
    if documents.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_STORE:
        raise ValueError("standing queries need the RocksDB state store: call use_state_store first")

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(posixpath.join(path, f"batch={batch_id}"))

    return (
        best_so_far(documents, queries, k, above, places)
        .writeStream.foreachBatch(add)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def use_state_store(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB; an earlier stream keeps the store it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def standing_answers(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """The present list of each query, `(query_id, id, sim, rank)`: the one of the last batch that changed it.

    With `until`, the lists as they were after that batch.
    """
    lists = spark.read.parquet(path)
    if until is not None:
        lists = lists.filter(F.col("batch") <= until)
    # Lists are short, so the newest one is found by an aggregate that combines before its shuffle.
    hit = F.struct("rank", "id", "sim")
    each = lists.groupBy("query_id", "batch").agg(F.collect_list(hit).alias("hits"))
    newest = each.groupBy("query_id").agg(F.max_by("hits", "batch").alias("hits"))
    return newest.select("query_id", F.explode("hits").alias("hit")).select("query_id", "hit.id", "hit.sim", "hit.rank")
