"""The corpus around pivots against the search of everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import pivots
from lexivec.operators.nearest import vector_topk_batch


def table(spark, vectors, name):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, vector array<double>").repartition(3)


def clustered(seed, n, width=8, centres=12):
    random = np.random.default_rng(seed)
    middle = random.normal(size=(centres, width)) * 5
    return middle[random.integers(0, centres, n)] + random.normal(size=(n, width)) * 0.1


def rows(hits):
    return sorted((r.query_id, r["rank"], r.id, r.sim) for r in hits.select("query_id", "rank", "id", "sim").collect())


@pytest.mark.parametrize("k", [1, 5, 40])
def test_clustered_vectors(spark, k):
    corpus, queries = table(spark, clustered(1, 1500), "id"), table(spark, clustered(1, 30), "query_id")
    laid = pivots.lay_out(corpus, pivots=24)
    hits, searched = pivots.pruned_steps(laid, queries, k)
    assert rows(hits) == rows(vector_topk_batch(corpus, queries, k))
    # Most rings are never read.
    met = searched.join(laid.rings, "ring").agg(F.sum("n")).first()[0]
    assert met < 0.35 * 1500 * 30
    assert searched.count() == searched.distinct().count()


def test_vectors_that_cannot_be_ruled_out(spark):
    """Random directions in many dimensions, equal vectors, ties, zero vectors and rows without a vector."""
    random = np.random.default_rng(2)
    vectors = [*random.normal(size=(400, 48)), *[np.ones(48)] * 200, *[np.zeros(48)] * 5, None]
    corpus, queries = table(spark, vectors, "id"), table(spark, [*random.normal(size=(10, 48)), np.ones(48), np.zeros(48), None], "query_id")
    laid = pivots.lay_out(corpus)
    assert laid.rows.count() == 605
    assert rows(pivots.vector_topk_pruned(laid, queries, 7, places=6)) == rows(vector_topk_batch(corpus, queries, 7, places=6))


def test_rings_of_many_equal_vectors_are_cut(spark, monkeypatch):
    monkeypatch.setattr(pivots, "PART_ROWS", 50)
    corpus, queries = table(spark, [[1.0, 2.0]] * 400, "id"), table(spark, [[1.0, 0.0], [-1.0, 0.0]], "query_id")
    laid = pivots.lay_out(corpus, pivots=3)
    assert laid.rows.groupBy("ring", "part").count().agg(F.max("count")).first()[0] < 100
    assert rows(pivots.vector_topk_pruned(laid, queries, 3)) == rows(vector_topk_batch(corpus, queries, 3))


def test_small_tables(spark):
    none, queries = table(spark, [], "id"), table(spark, [[1.0, 0.0]], "query_id")
    assert pivots.vector_topk_pruned(pivots.lay_out(none), queries).collect() == []
    few = table(spark, [[1.0, 0.5], [0.5, 1.0]], "id")
    assert rows(pivots.vector_topk_pruned(pivots.lay_out(few), queries)) == rows(vector_topk_batch(few, queries))
    with pytest.raises(ValueError, match="at least 1"):
        pivots.vector_topk_pruned(pivots.lay_out(few), queries, 0)
    with pytest.raises(Exception, match="finite"):
        pivots.lay_out(table(spark, [[float("nan"), 0.0]], "id"))


def test_a_query_given_twice(spark):
    corpus = table(spark, clustered(4, 300), "id")
    queries = table(spark, clustered(4, 6), "query_id")
    queries = queries.union(queries.filter("query_id < 2"))
    laid = pivots.lay_out(corpus, pivots=4)
    assert rows(pivots.vector_topk_pruned(laid, queries, 5)) == rows(vector_topk_batch(corpus, queries, 5))


@pytest.mark.parametrize("small", [True, False])
def test_vectors_of_queries_are_not_dealt_to_rings(spark, monkeypatch, small):
    corpus, queries = table(spark, clustered(5, 300), "id"), table(spark, clustered(6, 9), "query_id")
    laid = pivots.lay_out(corpus, pivots=4)
    wanted = rows(vector_topk_batch(corpus, queries, 5))
    if not small:
        monkeypatch.setattr(pivots, "is_small", lambda *_: False)
    found = pivots._searched(laid, queries, pivots.rings_of(laid, queries, 5), 5, 9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("asked" in plan) is not small
    assert rows(pivots.vector_topk_pruned(laid, queries, 5)) == wanted
