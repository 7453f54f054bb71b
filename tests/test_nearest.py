import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import nearest

GRID = {"broadcast_rows": 0, "block_bytes": 4096}


def vectors(n, seed, copies=0):
    made = np.random.default_rng(seed).normal(size=(n, 8)).round(3)
    if copies:
        # A group of equal vectors, as a hot group of copies would be.
        made[:: n // copies] = made[0]
    return made


def table(spark, matrix, key, as_text=False):
    rows = [(f"k{i:04d}" if as_text else i, [float(v) for v in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} {'string' if as_text else 'long'}, vector array<double>")


def brute_force(corpus, queries, k, above=None):
    result = []
    for q, row in enumerate(queries):
        sims = [round(float(sum(a * b for a, b in zip(c, row, strict=True))), 9) + 0.0 for c in corpus]
        ranked = sorted((-s, i) for i, s in enumerate(sims) if above is None or s > above)
        result += [(q, i, -s, r + 1) for r, (s, i) in enumerate(ranked[:k])]
    return result


def rows(hits):
    return sorted((r["query_id"], r["id"], r["sim"], r["rank"]) for r in hits.collect())


@pytest.mark.parametrize("layout", [{}, GRID], ids=["shipped", "grid"])
@pytest.mark.parametrize(("k", "above"), [(5, None), (7, 1.0), (None, 2.0), (500, None)])
def test_equals_brute_force(spark, layout, k, above):
    corpus, queries = vectors(300, 1, copies=100), vectors(17, 2)
    hits = nearest.vector_topk_batch(
        table(spark, corpus, "id").repartition(5), table(spark, queries, "query_id"), k, above, **layout
    )
    assert rows(hits) == sorted(brute_force(corpus, queries, k, above))


def test_small_blocks_and_cuts(spark, monkeypatch):
    corpus, queries = vectors(300, 3, copies=150), vectors(9, 4)
    monkeypatch.setattr(nearest, "CELLS", 32)
    block = nearest._Best(9, 3)
    list(nearest._score_block(block, np.arange(300), corpus, queries, 9, None))
    block.cut()
    query, ids, sims = block.take()
    wanted = sorted((q, i, s) for q, i, s, _ in brute_force(corpus, queries, 3))
    assert sorted(zip(query.tolist(), ids.tolist(), sims.tolist(), strict=True)) == wanted


@pytest.mark.parametrize("layout", [{}, GRID], ids=["shipped", "grid"])
def test_text_ids(spark, layout):
    corpus, queries = vectors(60, 5, copies=20), vectors(4, 6)
    hits = nearest.vector_topk_batch(table(spark, corpus, "id", True), table(spark, queries, "query_id", True), 4, **layout)
    wanted = [(f"k{q:04d}", f"k{i:04d}", s, r) for q, i, s, r in brute_force(corpus, queries, 4)]
    assert rows(hits) == sorted(wanted)


def test_batch_equals_single(spark):
    corpus, queries = vectors(80, 7, copies=10), vectors(3, 8)
    batch = rows(nearest.vector_topk_batch(table(spark, corpus, "id"), table(spark, queries, "query_id"), 6))
    for q, query in enumerate(queries):
        single = nearest.vector_topk(table(spark, corpus, "id"), query, 6, "vector", "id")
        assert "vector" not in single.columns
        assert [(r["id"], r["sim"]) for r in single.collect()] == [
            (i, s) for p, i, s, _ in sorted(batch, key=lambda b: b[3]) if p == q
        ]


@pytest.mark.parametrize("layout", [{}, GRID], ids=["shipped", "grid"])
def test_empty_sides(spark, layout):
    some, none = vectors(5, 9), vectors(0, 9)
    assert rows(nearest.vector_topk_batch(table(spark, none, "id"), table(spark, some, "query_id"), 2, **layout)) == []
    assert rows(nearest.vector_topk_batch(table(spark, some, "id"), table(spark, none, "query_id"), 2, **layout)) == []


@pytest.mark.parametrize(
    ("vector", "message"),
    [([1.0], "equal length"), ([float("nan")] * 8, "finite")],
)
def test_bad_vectors_are_errors(spark, vector, message):
    corpus = table(spark, vectors(5, 1), "id").unionByName(
        spark.createDataFrame([(9, vector)], "id long, vector array<double>")
    )
    with pytest.raises(Exception, match=message):
        nearest.vector_topk_batch(corpus, table(spark, vectors(2, 2), "query_id"), 2).collect()


def test_all_pairs_are_refused(spark):
    with pytest.raises(ValueError, match="floor"):
        nearest.similarities(table(spark, vectors(2, 1), "id"), table(spark, vectors(2, 1), "query_id"))


def test_floor_is_strict(spark):
    hits = spark.createDataFrame([(1, 0.5), (2, 0.500001)], "id int, sim double")
    assert [r["id"] for r in nearest.above_floor(hits).collect()] == [2]
    corpus = spark.createDataFrame([(1, [0.5]), (2, [0.6])], "id long, vector array<float>")
    query = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")
    found = nearest.similarities(corpus, query, above=0.5).collect()
    assert [(r["id"], r["sim"]) for r in found] == [(2, round(float(np.float32(0.6)), 9))]


def test_rows_without_a_vector_are_no_hits(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "query_id long, vector array<double>")
    for layout in ({}, {"broadcast_rows": 0}):
        hits = nearest.vector_topk_batch(corpus, asked, 5, **layout).collect()
        assert sorted((r["query_id"], r["id"]) for r in hits) == [(1, 1), (1, 3)]
    single = nearest.vector_topk(corpus, [1.0, 1.0], 5, "vector", "id").collect()
    assert sorted(r["id"] for r in single) == [1, 3]
    assert nearest.without_vector(corpus).first()[0] == 1


def test_a_component_that_is_no_number_is_an_error_on_both_routes(spark):
    corpus = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [1.0, 2.0])], "id long, vector array<double>")
    with pytest.raises(Exception, match="finite number"):
        nearest.vector_topk(corpus, [1.0, 1.0], 5, "vector", "id").collect()
    with pytest.raises(Exception, match="finite number"):
        nearest.vector_topk_batch(corpus, corpus.filter("id = 2").withColumnRenamed("id", "query_id"), 5).collect()


def test_a_floor_that_everything_passes(spark):
    corpus = spark.range(300).select("id", F.array(F.lit(1.0), F.lit(0.5)).alias("vector"))
    asked = corpus.filter("id < 50").withColumnRenamed("id", "query_id")
    for layout in ({}, {"broadcast_rows": 0, "block_bytes": 1 << 11}):
        assert nearest.similarities(corpus, asked, above=0.0, **layout).count() == 300 * 50


def test_blocks_of_the_grid_grow_before_there_are_many(spark):
    assert [nearest.grid_blocks(s, 1 << 17) for s in (0, 1, 1 << 18, 1 << 30)] == [1, 1, 2, 32]
    assert nearest.grid_blocks(1 << 24, 1 << 17) == nearest.SMALL_BLOCKS
    assert nearest.grid_blocks(1 << 30, 1 << 28) == 4


def test_equal_vectors_are_asked_once(spark):
    asked = spark.createDataFrame([(3, [1.0]), (1, [1.0]), (2, [2.0])], "query_id long, vector array<double>")
    once, of = nearest.each_once(asked)
    assert sorted(map(tuple, once.collect())) == [(1, [1.0]), (2, [2.0])]
    assert sorted(map(tuple, of.collect())) == [(1, 1), (2, 2), (3, 1)]
