"""Hybrid text search as Spark jobs: keyword ranking, vector ranking and reranking over DataFrames."""

import sys

from pyspark import cloudpickle

from lexivec.operators.bm25 import BM25Config, Index, build_index, search
from lexivec.operators.nearest import vector_topk, vector_topk_batch
from lexivec.operators.rerank import rerank, score_pairs
from lexivec.plans.search import (
    build_corpus,
    compare_rankings,
    keyword_search,
    retrieve_then_rerank,
    semantic_search,
)
from lexivec.sources.index_store import load_index, save_index

__all__ = [
    "BM25Config",
    "Index",
    "build_corpus",
    "build_index",
    "compare_rankings",
    "keyword_search",
    "load_index",
    "rerank",
    "retrieve_then_rerank",
    "save_index",
    "score_pairs",
    "search",
    "semantic_search",
    "vector_topk",
    "vector_topk_batch",
]

# Python functions of this package travel with the jobs that use them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
