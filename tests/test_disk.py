"""What steps leave on disk: shuffle files go with the write they were made for, and intermediate tables with the step."""

import time
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from lexivec.functions.prep import WORDS
from lexivec.operators import blockmax, bm25
from lexivec.scale import borrowed, materialise
from lexivec.session import work_folder
from lexivec.sources import block_store, index_store
from lexivec.streaming import segments

CONFIG = bm25.BM25Config({"name": 2, "definition": 1}, retained=["lang"], prep=WORDS)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"name {i % 3}", f"text {i % 7} of word{chr(97 + i % 20)} a{chr(97 + i % 26)}", "en") for i in range(60)]
    rows += [(100, "", "", "es"), (101, "alone", None, None)]
    return spark.createDataFrame(rows, "doc_id long, name string, definition string, lang string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "name text worda"), (2, "alone aa wordb of"), (3, "none")], "query_id long, text string")


def rows(table):
    return sorted(map(str, table.collect()))


def kept(spark):
    """The folders of intermediate tables."""
    return {p.name for p in Path(urlparse(work_folder(spark)).path).glob("*-*")}


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before = shuffled(spark)
    table = materialise(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "table")
    for _ in range(50):
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - before
    assert table.count() == 10


def test_borrowed_tables_are_returned(spark):
    before = kept(spark)
    with borrowed(spark.range(3), "lent") as table:
        assert table.count() == 3 and kept(spark) - before
    assert kept(spark) == before


def test_an_index_is_saved_in_steps(spark, docs, queries, tmp_path, monkeypatch):
    built = bm25.build_index(docs, CONFIG)
    before = kept(spark)
    index_store.save_index(built, str(tmp_path / "whole"), buckets=5)
    monkeypatch.setattr(bm25, "SLICE_BYTES", 1)
    monkeypatch.setattr(bm25, "SLICES", 3)
    index_store.save_index(built, str(tmp_path / "steps"), buckets=5)
    assert kept(spark) == before
    whole, steps = (index_store.load_index(spark, str(tmp_path / n), WORDS) for n in ("whole", "steps"))
    assert rows(steps.postings) == rows(whole.postings)
    found = bm25.search(steps, queries)
    assert rows(found) == rows(bm25.search(built, queries))


def test_blocks_are_saved_in_steps(spark, docs, queries, tmp_path, monkeypatch):
    built = bm25.build_index(docs, CONFIG)
    block_store.save_blocks(built, str(tmp_path / "whole"), buckets=5, size=8)
    before = kept(spark)
    monkeypatch.setattr(bm25, "SLICE_BYTES", 1)
    monkeypatch.setattr(bm25, "SLICES", 3)
    # Most documents look up other terms.
    monkeypatch.setattr(blockmax, "FIRST_TERMS", 1)
    block_store.save_blocks(built, str(tmp_path / "steps"), buckets=5, size=8)
    left = {name.split("-")[0] for name in kept(spark) - before}
    assert not left & {"counts", "lengths", "statistics", "ordered", "weighted"}
    whole, steps = (block_store.load_blocks(spark, str(tmp_path / n), WORDS) for n in ("whole", "steps"))
    for name in ("places", "blocks", "bitmaps"):
        assert rows(getattr(steps, name)) == rows(getattr(whole, name))
    for limit in ({}, {"broadcast_rows": 0}):
        assert rows(blockmax.search_blocks(steps, queries, **limit)) == rows(bm25.search(built, queries))


def test_batches_leave_no_tables(spark, docs, tmp_path):
    before, path = kept(spark), str(tmp_path / "segments")
    segments.add_batch(docs, 0, CONFIG, path)
    segments.add_batch(docs.filter("doc_id < 3"), 1, CONFIG, path)
    assert {name.split("-")[0] for name in kept(spark) - before} <= {"possible"}
    assert rows(bm25.weights(segments.segmented_index(spark, CONFIG, path))) == rows(bm25.weights(bm25.build_index(docs, CONFIG)))
