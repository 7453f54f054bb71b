"""Second-stage ranking of (query, text) pairs with a scorer that the user supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.functions.scores import sigmoid
from lexivec.functions.text import tokenize
from lexivec.operators.ranking import HEAD, splice
from lexivec.operators.remember import ScoreMemory, score_remembered
from lexivec.scale import BROADCAST_BYTES, BROADCAST_ROWS, is_small, materialise, top_per_group

# Called once per task; returns a function from (queries, texts) to one logit per pair.
ScorerFactory = Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[float]]]
# A scorer that Spark can run by itself.
ScorerExpression = Callable[[Column, Column], Column]


def score_pairs(pairs: DataFrame, factory: ScorerFactory) -> DataFrame:
    """Add the `logit` of each pair `(query, text)`; a failing scorer fails the task."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("logit", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for batch in batches:
            logits = scorer(batch["query"].tolist(), batch["text"].tolist())
            yield batch.assign(logit=[float(x) for x in logits])

    return pairs.mapInPandas(score, schema)


def score_pairs_with(pairs: DataFrame, expression: ScorerExpression) -> DataFrame:
    """Add the `logit` of each pair from a column expression."""
    return pairs.withColumn("logit", expression(F.col("query"), F.col("text")))


def scored_pairs(
    pairs: DataFrame,
    factory: ScorerFactory | None = None,
    expression: ScorerExpression | None = None,
    memory: ScoreMemory | None = None,
) -> DataFrame:
    """Add the `logit` of each pair by the one scorer that is given; with `memory`, of unseen pairs only."""
    if (factory is None) == (expression is None):
        raise ValueError("give either a scorer factory or a scorer expression")

    def score(given: DataFrame) -> DataFrame:
        return score_pairs(given, factory) if factory else score_pairs_with(given, expression)

    return score(pairs) if memory is None else score_remembered(pairs, score, memory)


def overlap_logit(query: Column, text: Column) -> Column:
    """A plain stand-in for a model: 8 times the share of distinct query words found in the text, less 4."""
    words = F.array_distinct(tokenize(query))
    found = F.size(F.array_intersect(words, tokenize(text))).cast("double")
    return F.when(F.size(words) == 0, F.lit(-4.0)).otherwise(
        F.lit(8.0) * found / F.greatest(F.size(words), F.lit(1)) - F.lit(4.0)
    )


def pair_texts(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Each query's text beside its candidates: `(query_id, corpus_id, query, text, ...)`."""
    asked = queries.select("query_id", F.col("text").alias("query"))
    return candidates.join(asked, "query_id")


def is_asked(query: Column) -> Column:
    """False for a blank query, which is not reranked."""
    return F.coalesce(query.rlike(r"(?U)\S"), F.lit(False))


def rerank(
    pairs: DataFrame,
    factory: ScorerFactory | None = None,
    expression: ScorerExpression | None = None,
    top_k: int | None = None,
    return_documents: bool = False,
    memory: ScoreMemory | None = None,
) -> DataFrame:
    """Rank the pairs of each query by model score: `(query_id, corpus_id, score, rank[, text])`.

    The score is the sigmoid of the scorer's logit. Without `top_k`, or with 0, all
    pairs are kept. With `memory`, pairs that an earlier run scored are not scored again.
    """
    scored = scored_pairs(pairs.select("query_id", "corpus_id", "query", "text"), factory, expression, memory)
    columns = ["query_id", "corpus_id", "score"] + (["text"] if return_documents else [])
    scored = scored.withColumn("score", sigmoid(F.col("logit"))).select(*columns)
    return top_per_group(scored, ["query_id"], [F.col("score").desc(), F.col("corpus_id").asc()], top_k or None)


def rerank_head(
    ranked: DataFrame,
    queries: DataFrame,
    texts: DataFrame,
    factory: ScorerFactory | None = None,
    expression: ScorerExpression | None = None,
    head: int = HEAD,
    memory: ScoreMemory | None = None,
) -> DataFrame:
    """Rerank the first `head` hits of each query and put them in front of the others.

    `ranked(query_id, id, sim, rank)`, `queries(query_id, text)`, `texts(id, text)`.
    Adds `rerank_score`, null after the head and for blank queries, whose hits keep
    their order. The costly scorer sees only the heads. `ranked` is computed once
    and written, as heads and tails are both read from it.
    """
    if (factory is None) == (expression is None):
        raise ValueError("give either a scorer factory or a scorer expression")
    ranked = materialise(ranked, "ranked")
    asked = queries.filter(is_asked(F.col("text"))).select("query_id", F.col("text").alias("query"))
    first = ranked.filter(F.col("rank") <= head)
    pairs = first.join(asked, "query_id")
    if is_small(asked, BROADCAST_ROWS // head, BROADCAST_BYTES // head):
        # At most `head` pairs per query, so the pairs go to the texts, which need no shuffle.
        pairs = F.broadcast(pairs)
    pairs = pairs.join(texts.select("id", "text"), "id")
    scored = scored_pairs(pairs, factory, expression, memory)
    scores = scored.select("query_id", "id", sigmoid(F.col("logit")).alias("rerank_score"))
    # Hits without a score (blank query, no text) come after the scored ones, in their old order.
    reordered = top_per_group(
        first.join(scores, ["query_id", "id"], "left").withColumnRenamed("rank", "first_rank"),
        ["query_id"],
        [F.col("rerank_score").desc_nulls_last(), F.col("first_rank").asc()],
        head,
    )
    tail = ranked.filter(F.col("rank") > head).withColumn("first_rank", F.col("rank"))
    return splice(reordered, tail)
