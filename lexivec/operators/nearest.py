"""Exact nearest vectors by dot product.

Many queries are ranked against a corpus by blocked matrix products inside Arrow
batches: a task keeps only its best `k` rows per query (or the rows above the
floor) and never builds query-document pairs as rows. A small set of queries
is shipped to every task; a large one is laid out in blocks that meet the
blocks of the corpus in a grid, so that neither side has to fit anywhere whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.functions.vectors import dot_literal
from lexivec.scale import BROADCAST_BYTES, BROADCAST_ROWS, MAX_PARTITIONS, is_small, measure, top_per_group

# The similarity floor and result count of the search pages.
MIN_SIM = 0.5
DEMO_RESULTS = 5

# Decimal places kept of a similarity. Rows rank on the kept value and then by
# id, so the order in which a product is summed cannot change a ranking.
PLACES = 9

CELLS = 1 << 21
# Rows and queries of one cell of the grid where a floor alone bounds its hits.
CELL_SIDE = 4096
BLOCK_BYTES = 32 * 1024 * 1024
# Blocks of a side up to which they have the size asked for. Each block of a side is a copy of the other one, so
# beyond these the blocks grow, up to `BLOCK_BYTES`, before there are more of them.
SMALL_BLOCKS = 8


def _matrix(vectors: pa.Array, width: int | None) -> np.ndarray:
    """A column of lists as a matrix; an error for null, unequal or non-finite vectors."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths()
    if vectors.null_count or (len(vectors) and lengths.null_count):
        raise ValueError("a vector is null")
    sizes = np.unique(lengths.to_numpy(zero_copy_only=False)) if len(vectors) else np.array([], dtype=np.int32)
    if len(sizes) > 1 or (width is not None and len(sizes) == 1 and sizes[0] != width):
        raise ValueError("vectors must have equal length")
    width = int(sizes[0]) if len(sizes) else width or 0
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if not np.isfinite(flat).all():
        raise ValueError("a vector has a component that is not a finite number")
    return flat.reshape(len(vectors), width)


class _Best:
    """The best rows per query seen so far by one task."""

    def __init__(self, queries: int, k: int | None):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.limit = max(4 * queries * (k or 0), CELLS // 4)

    def add(self, query: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        self.parts.append((query, ids, sims))
        self.held += len(query)
        if self.k is not None and self.held > self.limit:
            self.cut()

    def cut(self) -> None:
        query, ids, sims = self.take()
        # Ranks of ids order text ids as well as numbers.
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -sims, query))
        query, ids, sims = query[order], ids[order], sims[order]
        start = np.searchsorted(query, query, side="left")
        keep = np.arange(len(query)) - start < self.k
        self.parts = [(query[keep], ids[keep], sims[keep])]
        self.held = int(keep.sum())
        last = np.flatnonzero(np.arange(len(query)) - start == self.k - 1)
        self.floor[query[last]] = sims[last]

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, self.parts, self.held = self.parts, [], 0
        if not parts:
            return np.array([], dtype=np.int64), np.array([], dtype=object), np.array([])
        return tuple(np.concatenate(columns) for columns in zip(*parts, strict=True))


def _score_block(
    best: _Best, ids: np.ndarray, corpus: np.ndarray, queries: np.ndarray, places: int, above: float | None
) -> Iterator[None]:
    """Adds the hits of a block; stops after each step, for what was found to be taken."""
    step = max(1, CELLS // max(1, len(queries)))
    for start in range(0, len(corpus), step):
        # Adding 0.0 turns -0.0 into 0.0.
        sims = np.round(corpus[start : start + step] @ queries.T, places) + 0.0
        keep = sims >= best.floor
        if above is not None:
            keep &= sims > above
        if best.k is not None and len(sims) > best.k:
            # Everything equal to the k-th value stays, so that ids can decide.
            keep &= sims >= np.partition(sims, len(sims) - best.k, axis=0)[len(sims) - best.k]
        row, query = np.nonzero(keep)
        best.add(query, ids[start : start + step][row], sims[row, query])
        yield


def _as_batch(best: _Best, query_ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    query, ids, sims = best.take()
    arrays = [query_ids[query], ids, sims]
    return pa.RecordBatch.from_arrays([pa.array(a, type=f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _result_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", corpus.schema["id"].dataType),
            T.StructField("sim", T.DoubleType()),
        ]
    )


def _with_shipped_queries(
    corpus: DataFrame, queries: DataFrame, k: int | None, above: float | None, places: int
) -> DataFrame:
    """Every task holds all queries; only for queries whose size has been checked."""
    from pyspark.sql.pandas.types import to_arrow_schema

    table = queries.toArrow()
    shipped = queries.sparkSession.sparkContext.broadcast(
        (_ids(table["query_id"]), _matrix(table["vector"], None))
    )
    schema = _result_schema(queries, corpus)
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shipped.value
        if not len(query_ids):
            return
        best = _Best(len(query_ids), k)
        for batch in batches:
            rows = _matrix(batch.column(1), matrix.shape[1])
            for _ in _score_block(best, _ids(batch.column(0)), rows, matrix, places, above):
                if k is None and best.held:
                    yield _as_batch(best, query_ids, arrow)
        if k is not None and best.held:
            best.cut()
            yield _as_batch(best, query_ids, arrow)

    return corpus.select("id", "vector").mapInArrow(score, schema)


def grid_blocks(size: int, block_bytes: int) -> int:
    """Into how many blocks a side of the grid of this size is cut."""
    return max(1, min(math.ceil(size / block_bytes), max(SMALL_BLOCKS, math.ceil(size / BLOCK_BYTES))))


def _with_grid(
    corpus: DataFrame, queries: DataFrame, k: int | None, above: float | None, places: int, block_bytes: int
) -> DataFrame:
    """Blocks of queries meet blocks of the corpus; each cell of the grid is one bounded group."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows, columns = (grid_blocks(measure(side)[1], block_bytes) for side in (corpus, queries))
    if k:
        # A cell also holds k hits per query.
        columns = max(columns, grid_blocks(queries.count() * k * 32 // 2, block_bytes))
    else:
        # A floor may let every pair of a cell pass.
        rows, columns = max(rows, math.ceil(corpus.count() / CELL_SIDE)), max(columns, math.ceil(queries.count() / CELL_SIDE))
    left = corpus.select(
        F.pmod(F.xxhash64("id"), F.lit(rows)).alias("row"),
        F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"),
        "id",
        "vector",
    )
    right = queries.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("row"),
        F.pmod(F.xxhash64("query_id"), F.lit(columns)).cast("int").alias("column"),
        "query_id",
        F.col("vector").alias("asked"),  # another name, as both sides may come from one table
    )
    schema = _result_schema(queries, corpus)
    arrow = to_arrow_schema(schema)

    def cell(_: tuple, documents: pa.Table, asked: pa.Table) -> pa.Table:
        query_ids = _ids(asked["query_id"])
        best = _Best(len(query_ids), k)
        if len(query_ids) and documents.num_rows:
            matrix = _matrix(asked["asked"], None)
            found = _matrix(documents["vector"], matrix.shape[1])
            for _ in _score_block(best, _ids(documents["id"]), found, matrix, places, above):
                pass
            if k is not None and best.held:
                best.cut()
        return pa.Table.from_batches([_as_batch(best, query_ids, arrow)], schema=arrow)

    # A task per cell, as far as the number of shuffle blocks allows.
    tasks = min(max(rows * columns, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MAX_PARTITIONS)
    left, right = (side.repartition(tasks, "row", "column") for side in (left, right))
    return left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(cell, schema)


def similarities(
    corpus: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    above: float | None = None,
    places: int = PLACES,
    broadcast_rows: int = BROADCAST_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Candidate hits `(query_id, id, sim)`, before the final ranking.

    `corpus(id, vector)` and `queries(query_id, vector)`. With `k`, at least the
    best `k` rows of each query; with `above`, only rows whose similarity exceeds it.
    Rows and queries without a vector have no hits (`without_vector` counts them); a
    component that is not a finite number is an error.
    """
    if k is None and above is None:
        raise ValueError("give k or a similarity floor: all pairs of two tables are not built")
    corpus = corpus.select("id", "vector").filter(F.col("vector").isNotNull())
    queries = queries.select("query_id", "vector").filter(F.col("vector").isNotNull())
    # A task holds at most k rows per query, so large k needs smaller blocks of queries.
    held = BROADCAST_BYTES // (32 * k) if k else broadcast_rows
    if is_small(queries, min(broadcast_rows, held)):
        return _with_shipped_queries(corpus, queries, k, above, places)
    return _with_grid(corpus, queries, k, above, places, block_bytes)


def vector_topk_batch(
    corpus: DataFrame,
    queries: DataFrame,
    k: int | None = DEMO_RESULTS,
    above: float | None = None,
    places: int = PLACES,
    **layout: int,
) -> DataFrame:
    """The best `k` corpus rows of each query: `(query_id, id, sim, rank)`; equal similarities by id.

    Without `k`, every row above the floor.
    """
    found = similarities(corpus, queries, k, above, places, **layout)
    return top_per_group(found, ["query_id"], [F.col("sim").desc(), F.col("id").asc()], k)


def each_once(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(query_id, vector)` with each vector once, under its least id, and `(query_id, asked_id)`: under which id each query is asked."""
    once = queries.groupBy("vector").agg(F.min("query_id").alias("query_id"))
    of = queries.join(once.withColumnRenamed("query_id", "asked_id"), "vector").select("query_id", "asked_id")
    return once.select("query_id", "vector"), of


def vector_topk(
    corpus: DataFrame,
    query: Sequence[float],
    k: int = DEMO_RESULTS,
    vector: str = "embedding",
    id_col: str = "code",
    places: int = PLACES,
) -> DataFrame:
    """The best `k` records for one query vector, with `sim` and without the vector.

    Records without a vector are no hits; a component that is not a finite number is an error.
    """
    sim = dot_literal(F.col(vector), query)
    error = F.raise_error(F.lit("a vector has a component that is not a finite number")).cast("double")
    checked = F.when(sim.isNull() | F.isnan(sim) | (F.abs(sim) == float("inf")), error).otherwise(F.round(sim, places))
    scored = corpus.filter(F.col(vector).isNotNull()).withColumn("sim", checked).drop(vector)
    return scored.orderBy(F.col("sim").desc(), F.col(id_col).asc()).limit(k)


def without_vector(corpus: DataFrame, vector: str = "vector") -> DataFrame:
    """Number of rows that have no vector and so are never hits."""
    return corpus.agg(F.count_if(F.col(vector).isNull()).alias("without_vector"))


def above_floor(hits: DataFrame, min_sim: float = MIN_SIM) -> DataFrame:
    """Hits whose similarity exceeds the floor."""
    return hits.filter(F.col("sim") > F.lit(min_sim))
