import uuid

import pytest
from pyspark.sql import functions as F

from lexivec.operators import remember, rerank
from lexivec.plans.search import retrieve_then_rerank

SCHEMA = "query_id long, corpus_id long, query string, text string"
PAIRS = [(1, 0, "q", "a"), (1, 1, "q", "bbb"), (1, 2, "q", "a"), (2, 3, "q", "a"), (2, 4, "", "q"), (2, 5, "q", "")]
LOGIT = lambda q, t: F.length(q) * 10.0 + F.length(t)


class Counting:
    """A scorer that notes each batch of pairs in a file of its own."""

    def __init__(self, folder):
        self.folder = folder
        folder.mkdir(exist_ok=True)

    def __call__(self):
        folder = self.folder

        def score(queries, texts):
            (folder / uuid.uuid4().hex).write_text("\n".join(f"{q}|{t}" for q, t in zip(queries, texts, strict=True)))
            return [len(q or "") * 10.0 + len(t or "") for q, t in zip(queries, texts, strict=True)]

        return score

    def seen(self):
        return sorted(line for file in self.folder.iterdir() for line in file.read_text().split("\n"))


@pytest.fixture
def memory(tmp_path):
    return remember.ScoreMemory(str(tmp_path / "scores"), "length 1")


@pytest.fixture
def scorer(tmp_path):
    return Counting(tmp_path / "calls")


def test_no_pair_is_scored_twice(spark, memory, scorer):
    pairs = spark.createDataFrame(PAIRS, SCHEMA).repartition(3)
    want = sorted(rerank.rerank(pairs, expression=LOGIT).collect())
    assert sorted(rerank.rerank(pairs, scorer, memory=memory).collect()) == want
    # Three rows hold one pair; the texts of a pair are not mixed up.
    assert scorer.seen() == ["q|", "q|a", "q|bbb", "|q"]
    assert sorted(rerank.rerank(pairs, scorer, memory=memory).collect()) == want
    assert len(scorer.seen()) == 4


def test_changed_texts_and_other_models_are_scored_anew(spark, memory, scorer):
    rerank.rerank(spark.createDataFrame(PAIRS, SCHEMA), scorer, memory=memory).collect()
    changed = [*PAIRS[:-1], (2, 5, "q", "new")]
    got = rerank.rerank(spark.createDataFrame(changed, SCHEMA), scorer, memory=memory)
    assert sorted(got.collect()) == sorted(rerank.rerank(spark.createDataFrame(changed, SCHEMA), expression=LOGIT).collect())
    assert scorer.seen() == ["q|", "q|a", "q|bbb", "q|new", "|q"]
    rerank.rerank(spark.createDataFrame(PAIRS[:1], SCHEMA), scorer, memory=remember.ScoreMemory(memory.path, "length 2")).collect()
    assert scorer.seen().count("q|a") == 2


def test_nulls_empty_tables_and_large_sets(spark, memory, scorer, monkeypatch):
    empty = spark.createDataFrame([], SCHEMA)
    assert rerank.rerank(empty, scorer, memory=memory).collect() == []
    assert scorer.seen() == []
    holed = [(1, 0, "q", None), (1, 1, "q", ""), (1, 2, None, "q")]
    monkeypatch.setattr(remember, "is_small", lambda df: False)  # the way of sets too large to broadcast
    scored = rerank.scored_pairs(spark.createDataFrame(holed, SCHEMA), scorer, memory=memory)
    assert sorted((r.corpus_id, r.logit) for r in scored.collect()) == [(0, 10.0), (1, 10.0), (2, 1.0)]
    assert remember.remembered(spark, memory).count() == 3


def test_compacted_store(spark, memory, scorer, tmp_path):
    for n in (2, 4, 6):
        rerank.rerank(spark.createDataFrame(PAIRS[:n], SCHEMA), scorer, memory=memory).collect()
    # What two jobs at once leave behind: one pair twice.
    remember.remembered(spark, memory).limit(1).write.parquet(f"{memory.folder}/twice")
    fresh = remember.compacted(spark, memory, str(tmp_path / "compacted"))
    assert remember.remembered(spark, fresh).count() == 4
    calls = len(scorer.seen())
    rerank.rerank(spark.createDataFrame(PAIRS, SCHEMA), scorer, memory=fresh).collect()
    assert rerank.rerank(spark.createDataFrame(PAIRS, SCHEMA), scorer, memory=memory).count() == len(PAIRS)
    assert len(scorer.seen()) == calls


def test_search_scores_heads_once(spark, memory, scorer):
    corpus = spark.createDataFrame([(i, [1.0 + i % 7]) for i in range(30)], "id long, vector array<double>")
    texts = spark.createDataFrame([(i, "x" * (i % 11)) for i in range(30)], "id long, text string")
    asked = spark.createDataFrame([(1, "ab", [1.0]), (2, "c", [2.0])], "query_id long, text string, vector array<double>")
    want = sorted(retrieve_then_rerank(corpus, asked, texts, expression=LOGIT, head=5).collect())
    for _ in range(2):
        got = retrieve_then_rerank(corpus, asked, texts, scorer, head=5, memory=memory)
        assert sorted(got.collect()) == want
    assert len(scorer.seen()) == len(set(scorer.seen())) <= 10
