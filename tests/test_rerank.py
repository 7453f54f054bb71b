import math
import uuid

import pytest
from pyspark.sql import functions as F

from lexivec.operators import encode, rerank
from lexivec.plans.search import build_corpus, retrieve_then_rerank

PAIRS = [(1, 0, "q", "a"), (1, 1, "q", "bbb"), (1, 2, "q", "cc"), (1, 3, "q", "dd"), (2, 9, "r", "e")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "query_id long, corpus_id long, query string, text string")


def by_length():
    return lambda queries, texts: [len(t) - 2.0 for t in texts]


def ranks(df):
    return sorted((r["query_id"], r["rank"], r["corpus_id"]) for r in df.collect())


ALL = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 0), (2, 1, 9)]


@pytest.mark.parametrize(("top_k", "most"), [(None, 4), (0, 4), (2, 2), (10, 4)])
def test_top_k_and_ties(pairs, top_k, most):
    assert ranks(rerank.rerank(pairs, by_length, top_k=top_k)) == [r for r in ALL if r[1] <= most]


def test_expression_equals_model_and_scores_are_sigmoids(pairs):
    logit = lambda q, t: F.length(t) - F.lit(2.0)
    a = rerank.rerank(pairs, expression=logit, return_documents=True).orderBy("query_id", "rank").collect()
    b = rerank.rerank(pairs, by_length, return_documents=True).orderBy("query_id", "rank").collect()
    assert a == b
    assert a[0]["score"] == pytest.approx(1 / (1 + math.exp(-1)))
    assert a[0]["text"] == "bbb"


def test_a_failing_scorer_fails_the_job(pairs):
    def broken():
        raise RuntimeError("no model here")

    with pytest.raises(Exception, match="no model here"):
        rerank.rerank(pairs, broken).collect()
    with pytest.raises(ValueError, match="either"):
        rerank.rerank(pairs)


@pytest.fixture(scope="module")
def ranked(spark):
    rows = [(q, i, 1.0 - i / 10, i + 1) for q in (1, 2, 3) for i in range(5)]
    return spark.createDataFrame(rows, "query_id long, id long, sim double, rank int")


def test_head_blank_and_missing_texts(spark, ranked):
    queries = spark.createDataFrame([(1, "x"), (2, " \t\n\u00a0"), (3, "y")], "query_id long, text string")
    texts = spark.createDataFrame([(0, "a"), (1, "aaaa"), (2, "aa"), (3, "aaaaaaa")], "id long, text string")
    done = rerank.rerank_head(ranked, queries, texts, by_length, head=3).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in done] == [1, 2, 0, 3, 4, 0, 1, 2, 3, 4, 1, 2, 0, 3, 4]
    assert [r["rank"] for r in done] == [1, 2, 3, 4, 5] * 3
    scored = [(r["query_id"], r["first_rank"]) for r in done if r["rerank_score"] is not None]
    assert sorted(scored) == [(q, r) for q in (1, 3) for r in (1, 2, 3)]
    # Fewer candidates than the head, and one text missing.
    short = rerank.rerank_head(ranked, queries, texts, by_length, head=20).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in short][:5] == [3, 1, 2, 0, 4]


@pytest.mark.parametrize("limit", [None, 3])
def test_two_stages(spark, limit):
    corpus = spark.createDataFrame([(i, [1.0 - i / 10]) for i in range(9)], "id long, vector array<double>")
    queries = spark.createDataFrame([(1, "x", [1.0])], "query_id long, text string, vector array<double>")
    texts = spark.createDataFrame([(i, "a" * i) for i in range(9)], "id long, text string")
    rows = retrieve_then_rerank(corpus, queries, texts, by_length, head=2, limit=limit).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 0, 2, 3, 4][: limit or 5]
    assert [r["rerank_score"] is not None for r in rows] == [True, True, False, False, False][: limit or 5]


def counting_encoder():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def test_embed(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, t string")
    rows = {r["id"]: r["embedding"] for r in encode.embed(df, "t", counting_encoder).collect()}
    assert rows == {1: [2.0, 1.0], 2: None, 3: [0.0, 1.0]}


def test_embed_wrong_count_is_an_error(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "id int, t string").coalesce(1)
    with pytest.raises(Exception, match="zip"):
        encode.embed(df, "t", lambda: lambda texts: [[1.0]]).collect()


def test_embed_hashed(spark):
    df = spark.createDataFrame([(1, "poverty rate"), (2, "rate Poverty"), (3, None)], "id int, t string")
    rows = {r["id"]: r["embedding"] for r in encode.embed_hashed(df, "t", 16).collect()}
    assert rows[1] == rows[2]
    assert sum(v * v for v in rows[1]) == pytest.approx(1.0)
    assert rows[3] == [0.0] * 16


def test_parity(spark):
    first = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, vector array<double>")
    second = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id int, vector array<double>")
    assert tuple(encode.embedding_parity(first, first).first()) == (2, 1.0, 0)
    assert tuple(encode.embedding_parity(first, second).first()) == (2, 0.0, 1)


def test_build_corpus(spark):
    rows = [("A", "n", "long", "short"), ("B", "n", None, "short"), ("C", "n", None, None)]
    series = spark.createDataFrame(
        rows, "`Series Code` string, `Indicator Name` string, `Long definition` string, `Short definition` string"
    )
    built = build_corpus(series, counting_encoder).orderBy("code").collect()
    assert [tuple(r) for r in built] == [
        ("A", "n", "long", [7.0, 1.0]),
        ("B", "n", "short", [8.0, 1.0]),
        ("C", "n", None, None),
    ]


def test_each_pair_is_scored_once(spark, tmp_path):
    """Without `top_k` too, although the ranking reads its input more than once."""
    calls = str(tmp_path)

    def counting():
        def score(queries, texts):
            with open(f"{calls}/{uuid.uuid4()}", "w") as file:
                file.write(str(len(queries)))
            return [float(len(t)) for t in texts]

        return score

    pairs = spark.createDataFrame([(i % 5, i, "q", "x" * i) for i in range(40)], "query_id long, corpus_id long, query string, text string")
    assert len(rerank.rerank(pairs, counting).collect()) == 40
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 40


def test_pages_and_low_confidence(spark):
    corpus = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(12)], "id long, vector array<double>")
    queries = spark.createDataFrame([(1, "a", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    texts = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(12)], "id long, text string")
    whole = retrieve_then_rerank(corpus, queries, texts, expression=rerank.overlap_logit, min_sim=0.5, head=4)
    rows = {r["rank"]: r for r in whole.collect()}
    second = retrieve_then_rerank(corpus, queries, texts, expression=rerank.overlap_logit, min_sim=0.5, head=4, limit=3, shown=3)
    assert {r["rank"]: (r["id"], r["low"]) for r in second.collect()} == {n: (rows[n]["id"], rows[n]["low"]) for n in (4, 5, 6)}
    assert all(r["low"] == (r["rerank_score"] < 0.15 if r["rerank_score"] is not None else r["sim"] < 0.78) for r in rows.values())
