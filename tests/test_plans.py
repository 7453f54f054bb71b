"""What the plans of the core operators may and may not do."""

import re

import pytest
from pyspark.sql import functions as F

from lexivec.functions.prep import WORDS
from lexivec.operators import bm25, nearest
from lexivec.operators.checks import duplicate_ids
from lexivec.sources.index_store import load_index, save_index
from lexivec.sources.tables import read_table

CONFIG = bm25.BM25Config({"name": 2, "definition": 1}, retained=["lang"], prep=WORDS)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("plans") / "docs")
    rows = [(i, f"name {i % 7}", f"text {i} of word{i % 50}", "en", "unused") for i in range(200)]
    made = spark.createDataFrame(rows, "doc_id long, name string, definition string, lang string, other string")
    made.write.parquet(folder)
    return read_table(spark, folder)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "name 3 word7"), (2, "text 9")], "query_id long, text string")


def plan(df):
    """The plan without its subqueries, which have an `AdaptiveSparkPlan` of their own."""
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)


def test_documents_are_shuffled_once(docs, queries):
    built = bm25.build_index(docs, CONFIG)
    assert exchanges(plan(built.postings)) == [next(iter(exchanges(plan(built.documents))))]
    hits = bm25.match_scores(built, queries)
    keys = [re.sub(r"#\d+L?", "", k) for k in exchanges(plan(hits))]
    # Matches are summed per query and document without a shuffle of their own.
    assert "query_id, doc_id" not in keys


def test_a_table_bucketed_by_id_is_not_shuffled(spark, docs, queries, tmp_path):
    docs.write.bucketBy(4, "doc_id").option("path", str(tmp_path / "bucketed")).saveAsTable("bucketed_docs")
    built = bm25.build_index(spark.table("bucketed_docs"), CONFIG, spread=False)
    assert exchanges(plan(built.postings)) == []
    keys = [re.sub(r"#\d+L?", "", k) for k in exchanges(plan(bm25.match_scores(built, queries)))]
    assert not [k for k in keys if "doc_id" in k]
    spark.sql("DROP TABLE bucketed_docs")


def test_only_used_columns_are_read(docs, queries):
    built = bm25.build_index(docs, CONFIG)
    for table in (built.postings, built.terms, bm25.search(built, queries)):
        for schema in re.findall("ReadSchema: struct<(.*?)>", plan(table)):
            assert "other" not in schema
    for schema in re.findall("ReadSchema: struct<(.*?)>", plan(duplicate_ids(docs, "doc_id"))):
        assert schema == "doc_id:bigint"


def test_filters_reach_the_files(docs, queries):
    built = bm25.build_index(docs, CONFIG)
    text = plan(bm25.search(built, queries, where=F.col("lang") == "es"))
    assert "EqualTo(lang,es)" in text


def test_stored_search_reads_only_its_buckets(spark, docs, queries, tmp_path):
    save_index(bm25.build_index(docs, CONFIG), str(tmp_path / "index"), buckets=64)
    loaded = load_index(spark, str(tmp_path / "index"), WORDS)
    found = bm25.search(loaded, queries)
    filters = re.findall(r"PartitionFilters: \[.*?bucket#\d+ IN \((.*?)\)", plan(found))
    assert filters
    assert all(len(f.split(",")) <= 5 for f in filters)
    # The terms themselves reach the files, and stored weights need no term statistics.
    assert re.search(r"PushedFilters: \[.*In\(term", plan(found))
    assert "/terms" not in plan(found)
    assert found.count() > 0


def test_vector_search_keeps_pairs_out_of_rows(spark):
    corpus = spark.range(50).select("id", F.array(F.rand(1), F.rand(2)).alias("vector"))
    asked = corpus.withColumnRenamed("id", "query_id")
    text = plan(nearest.vector_topk_batch(corpus, asked, 3))
    assert "MapInArrow" in text
    assert "WindowGroupLimit" in text
    assert "Join" not in text
    single = plan(nearest.vector_topk(corpus, [0.1, 0.2], 3, "vector", "id"))
    assert "TakeOrderedAndProject" in single
    assert "Python" not in single
