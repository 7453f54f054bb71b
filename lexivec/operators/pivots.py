"""Exact nearest vectors over a corpus that is laid out around pivots: cells that cannot hold a hit are never read.

Every vector belongs to the pivot it is nearest to, and in its cell to a ring of similar distances from the pivot. For
a query q, a pivot p and a vector x of a ring, q.x = q.p + q.(x - p), and the second product lies between -|q| r and
|q| r, where r is the greatest distance of the ring: so q.p + |q| r bounds every product of the ring. The rings of the
highest bounds are searched first; the k-th best product found is the threshold of the query, and of the other rings
only those whose bound reaches it are searched. The result is that of searching everything, also where nothing can
be ruled out, as with vectors that all lie equally far apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexivec.operators.nearest import BLOCK_BYTES, DEMO_RESULTS, PLACES, _as_batch, _Best, _ids, _matrix, _result_schema, _score_block
from lexivec.scale import is_small, materialise, top_per_group

#: Pivots at most, and rows for each of them at least; a cell is cut into so many rings.
PIVOTS, ROWS_OF_PIVOT, RINGS = 1024, 64, 8
#: A ring is searched in parts of at most so many rows.
PART_ROWS = 4096
#: Rings of the highest bounds that are searched first, however many rows they hold.
FIRST = 3
#: Added to bounds for the rounding of sums, in parts of the product of the lengths.
SLACK = 1e-6


@dataclass(frozen=True)
class PivotCorpus:
    """`rows(id, vector, ring, part)`, `rings(ring, pivot vector, radius, n, parts)`; rings are numbered."""

    rows: DataFrame
    rings: DataFrame


def lay_out(corpus: DataFrame, pivots: int | None = None, rings: int = RINGS) -> PivotCorpus:
    """A corpus `(id, vector)` around pivots, written to the work folder. Rows without a vector are left out.

    Pivots are the vectors of the smallest id hashes, a bounded sample: a sixty-fourth of the rows and 1024 at most.
    They shape the cells, and every row gets a cell. A cell of many equal vectors is one ring in several parts.
    """
    corpus = materialise(corpus.select("id", "vector").filter(F.col("vector").isNotNull()), "corpus")
    total = corpus.count()
    wanted = max(1, min(PIVOTS, total // ROWS_OF_PIVOT)) if pivots is None else pivots
    chosen = corpus.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").toArrow()
    points = _matrix(chosen["vector"], None)
    sent = corpus.sparkSession.sparkContext.broadcast((points, (points**2).sum(axis=1)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, squares = sent.value
        for batch in batches:
            rows = _matrix(batch.column(1), centres.shape[1] if len(centres) else None)
            nearest = np.empty(len(rows), np.int64)
            for start in range(0, len(rows), 1024):
                nearest[start : start + 1024] = (squares - 2 * (rows[start : start + 1024] @ centres.T)).argmin(axis=1)
            away = np.sqrt(((rows - centres[nearest]) ** 2).sum(axis=1)) if len(rows) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest), pa.array(away)], names=["id", "vector", "cell", "away"])

    kinds = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    placed = materialise(corpus.mapInArrow(place, f"id {kinds['id']}, vector {kinds['vector']}, cell long, away double"), "placed")
    edges = placed.groupBy("cell").agg(F.percentile_approx("away", [k / rings for k in range(1, rings)], 1000).alias("edges"))
    ringed = placed.join(F.broadcast(edges), "cell")  # a row a pivot
    ring = F.col("cell") * rings + F.size(F.filter("edges", lambda e: e < F.col("away")))
    ringed = materialise(ringed.select("id", "vector", "cell", "away", ring.alias("ring")), "ringed")
    stats = ringed.groupBy("cell", "ring").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    vectors = corpus.sparkSession.createDataFrame(list(enumerate(points.tolist())), "cell long, pivot array<double>")
    numbered = stats.join(F.broadcast(vectors), "cell").withColumn("parts", F.ceil(F.col("n") / PART_ROWS))
    table = materialise(numbered.select("ring", "pivot", "radius", "n", "parts"), "rings")
    parts = ringed.join(F.broadcast(table.select("ring", "parts")), "ring")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")
    return PivotCorpus(materialise(parts.select("id", "vector", "ring", part).repartition("ring", "part").sortWithinPartitions("ring"), "rows"), table)


def rings_of(laid: PivotCorpus, queries: DataFrame, k: int, places: int = PLACES) -> DataFrame:
    """`(query_id, ring, parts)`: the rings that `queries(query_id, vector)` begin with, those of the highest bounds; or
    of `queries(query_id, vector, least)` the others that may hold a product of `least`, all where it is null.

    Rings are at most 8 times 1024. Queries meet them in blocked products, and a task emits only what is to be searched.
    """
    table = laid.rings.orderBy("ring").toArrow()
    points, radius = _matrix(table["pivot"], None), table["radius"].to_numpy()
    far = radius + np.sqrt((points**2).sum(axis=1))
    sent = queries.sparkSession.sparkContext.broadcast((points, radius, far, *(table[c].to_numpy() for c in ("ring", "n", "parts"))))
    later = "least" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, reach, furthest, ring, n, parts = sent.value
        for batch in batches:
            step = max(1, BLOCK_BYTES // (64 * max(1, len(ring))))
            for start in range(0, batch.num_rows if len(ring) else 0, step):
                part = batch.slice(start, step)
                asked = _matrix(part.column(1), centres.shape[1])
                length = np.sqrt((asked**2).sum(axis=1))[:, None]
                bound = asked @ centres.T + length * reach + SLACK * (1e-6 + length * furthest)
                order = np.argsort(-bound, axis=1, kind="stable")
                held = n[order]
                # The best rings that together hold k rows, and a few at least.
                ahead = (held.cumsum(axis=1) - held < k) | (np.arange(len(ring)) < FIRST)
                wanted = np.empty_like(ahead)
                np.put_along_axis(wanted, order, ahead, axis=1)
                if later:
                    least = part.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)[:, None]
                    # Similarities are rounded, so a bound may lie half a place below one of them.
                    wanted = ~wanted & (bound + 10.0**-places >= least)
                row, which = np.nonzero(wanted)
                columns = [part.column(0).take(pa.array(row)), pa.array(ring[which]), pa.array(parts[which])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "ring", "parts"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "vector", *(["least"] if later else [])).mapInArrow(run, f"query_id {kind}, ring long, parts long")


def _searched(laid: PivotCorpus, queries: DataFrame, pairs: DataFrame, k: int, places: int) -> DataFrame:
    """The best `k` of each part of a ring for the queries that `pairs(query_id, ring, parts)` name, as `(query_id, id, sim)`.

    A query meets up to thousands of rings. Where the queries may be shipped, their vectors are held once by each
    task and only ids are dealt to the rings; the vectors of a larger set go with every pair. Queries that have a
    `least` get only hits that reach it.
    """
    schema = _result_schema(queries, laid.rows)
    arrow = to_arrow_schema(schema)
    least = F.coalesce("least", F.lit(float("-inf"))) if "least" in queries.columns else F.lit(float("-inf"))
    queries = queries.filter(F.col("query_id").isNotNull()).select("query_id", F.col("vector").alias("asked"), least.alias("least"))
    pairs = pairs.filter(F.col("query_id").isNotNull())
    asked, shipped = pairs, None
    if is_small(queries):
        held = queries.orderBy("query_id").toArrow()
        shipped = queries.sparkSession.sparkContext.broadcast((_ids(held["query_id"]), _matrix(held["asked"], None), held["least"].to_numpy()))
    else:
        asked = asked.join(queries, "query_id")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    asked = asked.select("query_id", "ring", part, *([] if shipped else ["asked", "least"]))

    def of(met: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if shipped is None:
            return _ids(met["query_id"]), _matrix(met["asked"], None), met["least"].to_numpy()
        known, matrix, floor = shipped.value
        wanted = np.unique(_ids(met["query_id"]))
        first, last = np.searchsorted(known, wanted, "left"), np.searchsorted(known, wanted, "right")
        # An id may be given twice.
        at = first if (last - first == 1).all() else np.concatenate([np.arange(a, b) for a, b in zip(first, last, strict=True)])
        return known[at], matrix[at], floor[at]

    def search(_: tuple, rows: pa.Table, met: pa.Table) -> pa.Table:
        query_ids = np.empty(0, np.int64)
        if met.num_rows and rows.num_rows:
            query_ids, matrix, floor = of(met)
        best = _Best(len(query_ids), k)
        if len(query_ids):
            best.floor = floor.copy()
            for _ in _score_block(best, _ids(rows["id"]), _matrix(rows["vector"], matrix.shape[1]), matrix, places, None):
                pass
            if best.held:
                best.cut()
        return pa.Table.from_batches([_as_batch(best, query_ids, arrow)], schema=arrow)

    wanted = pairs.select("ring").distinct()
    # Rings that no query asks for are left out before anything is moved.
    rows = laid.rows.join(F.broadcast(wanted) if is_small(wanted) else wanted, "ring", "left_semi")
    return rows.groupBy("ring", "part").cogroup(asked.groupBy("ring", "part")).applyInArrow(search, schema)


def pruned_steps(laid: PivotCorpus, queries: DataFrame, k: int = DEMO_RESULTS, places: int = PLACES) -> tuple[DataFrame, DataFrame]:
    """The hits of `vector_topk_pruned`, and the rings that were searched for each query: (query_id, ring, parts)."""
    if k < 1:
        raise ValueError("k is at least 1")
    queries = queries.select("query_id", "vector").filter(F.col("vector").isNotNull())
    ordered = [F.col("sim").desc(), F.col("id").asc()]
    first = materialise(rings_of(laid, queries, k, places), "first")
    found = materialise(top_per_group(_searched(laid, queries, first, k, places), ["query_id"], ordered, k).drop("rank"), "found")
    reached = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_hits"), F.min("sim").alias("least")).filter(F.col("_hits") == k).drop("_hits")
    asked = materialise(queries.join(F.broadcast(reached) if is_small(reached) else reached, "query_id", "left"), "asked")
    later = materialise(rings_of(laid, asked, k, places), "later")
    more = _searched(laid, asked, later, k, places)
    return top_per_group(found.unionByName(more), ["query_id"], ordered, k), first.union(later)


def vector_topk_pruned(laid: PivotCorpus, queries: DataFrame, k: int = DEMO_RESULTS, places: int = PLACES) -> DataFrame:
    """The best `k` corpus rows of each query: `(query_id, id, sim, rank)`, equal to those of `vector_topk_batch`."""
    return pruned_steps(laid, queries, k, places)[0]
