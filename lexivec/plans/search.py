"""Whole searches, from corpus and queries to shown results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.scores import SIDE_BY_SIDE_SIM_LIMIT, SIM_LIMIT, low_confidence
from lexivec.operators.bm25 import DEFAULT_LIMIT, Index, match_scores, result_limit, search
from lexivec.operators.encode import EncoderFactory, embed
from lexivec.operators.nearest import MIN_SIM, PLACES, vector_topk_batch
from lexivec.operators.prepare import compose_text, rename_select, with_definition
from lexivec.operators.ranking import HEAD, PAGE, after_cursor, attach_records, page, side_by_side, with_both_records
from lexivec.operators.remember import ScoreMemory
from lexivec.operators.rerank import ScorerExpression, ScorerFactory, rerank_head
from lexivec.scale import top_per_group


def build_corpus(series: DataFrame, factory: EncoderFactory) -> DataFrame:
    """Corpus records of a series table: fallback definition, composed text, encoding, final names."""
    defined = with_definition(series)
    composed = defined.withColumn("_text", compose_text(F.col("Indicator Name"), F.col("definition")))
    encoded = embed(composed, "_text", factory)
    return rename_select(encoded, columns=["code", "name", "definition", "embedding"])


def semantic_search(
    corpus: DataFrame,
    queries: DataFrame,
    min_sim: float | None = MIN_SIM,
    shown: int = 0,
    size: int = PAGE,
    sim_limit: float = SIM_LIMIT,
    places: int = PLACES,
) -> DataFrame:
    """One page of the hits above the floor, with the low-confidence flag: `(query_id, id, sim, rank, low)`."""
    ranked = vector_topk_batch(corpus, queries, shown + size, min_sim, places)
    return page(ranked, shown, size).withColumn("low", low_confidence(F.col("sim"), sim_limit=sim_limit))


def keyword_search(
    index: Index,
    queries: DataFrame,
    records: DataFrame,
    limit: int | None = DEFAULT_LIMIT,
    where: Column | None = None,
    shown: int = 0,
) -> DataFrame:
    """Keyword hits with their records: the next `limit` after the first `shown`."""
    cut = result_limit(limit)
    most = None if cut is None else queries.count() * cut
    hits = search(index, queries, None if cut is None else shown + cut, where)
    if shown:
        hits = hits.filter(F.col("rank") > shown)
    return attach_records(hits, records, "doc_id", most=most)


def keyword_page_after(
    index: Index, queries: DataFrame, cursor: DataFrame | None = None, size: int = PAGE, where: Column | None = None
) -> DataFrame:
    """The next `size` keyword hits after the cursor of each query: `(query_id, doc_id, score, rank)`, ranked from 1.

    `cursor(query_id, score, doc_id)` is what `next_cursor` made of the page before; without one a query begins. Any page
    costs what the first one does: a task keeps its best `size` hits after the cursor, not all that were shown.
    """
    hits = match_scores(index, queries, where).withColumn("score", F.col("units") / F.lit(10.0**index.precision))
    hits = after_cursor(hits.select("query_id", "doc_id", "score"), cursor, "score", "doc_id")
    return top_per_group(hits, ["query_id"], [F.col("score").desc(), F.col("doc_id").asc()], size)


def compare_rankings(
    index: Index,
    text_queries: DataFrame,
    corpus: DataFrame,
    vector_queries: DataFrame,
    size: int = PAGE,
    places: int = PLACES,
    shown: int = 0,
    records: DataFrame | None = None,
    sim_limit: float = SIDE_BY_SIDE_SIM_LIMIT,
) -> DataFrame:
    """A page of both rankings, row by row, for each `query_id`, with the low-confidence flag.

    The page is the next `size` rows after the first `shown`. `records(id, ...)` adds the records of both sides.
    """
    semantic = page(vector_topk_batch(corpus, vector_queries, shown + size, places=places), shown, size)
    lexical = page(search(index, text_queries, shown + size), shown, size)
    compared = side_by_side(
        semantic.select("query_id", "rank", "id", F.col("sim").alias("score")),
        lexical.select("query_id", "rank", F.col("doc_id").alias("id"), "score"),
        sim_limit,
    )
    return compared if records is None else with_both_records(compared, records)


def retrieve_then_rerank(
    corpus: DataFrame,
    queries: DataFrame,
    texts: DataFrame,
    factory: ScorerFactory | None = None,
    expression: ScorerExpression | None = None,
    min_sim: float = MIN_SIM,
    head: int = HEAD,
    limit: int | None = None,
    places: int = PLACES,
    shown: int = 0,
    sim_limit: float = SIM_LIMIT,
    memory: ScoreMemory | None = None,
) -> DataFrame:
    """Hits above the floor with the first `head` reranked: `(query_id, id, sim, first_rank, rerank_score, rank, low)`.

    `queries(query_id, text, vector)`, `corpus(id, vector)`, `texts(id, text)`. With
    `limit`, the next `limit` hits after the first `shown`; without it, every hit above
    the floor. `low` marks hits of low confidence. With `memory`, only pairs that no
    earlier search scored reach the scorer.
    """
    wanted = None if limit is None else max(shown + limit, head)
    ranked = vector_topk_batch(corpus, queries, wanted, min_sim, places)
    ordered = rerank_head(ranked, queries, texts, factory, expression, head, memory)
    low = low_confidence(F.col("sim"), F.col("rerank_score"), sim_limit)
    flagged = ordered.withColumn("low", low)
    return flagged if limit is None else page(flagged, shown, limit)
