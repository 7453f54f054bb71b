"""Segments against an index built at once, their number against the batches, filters against exact ids."""

import pytest
from pyspark.sql import functions as F

from lexivec.functions.prep import WORDS
from lexivec.operators import bm25
from lexivec.streaming import ingest, segments

CONFIG = bm25.BM25Config({"name": 2, "definition": 1}, retained=["lang"], prep=WORDS)
SCHEMA = "doc_id long, name string, definition string, lang string, gone boolean"


def doc(i, word="text", gone=False):
    return (i, f"name {i % 3}", f"{word} of {i % 5} words", "en", gone)


def add(spark, path, rows, batch, **options):
    segments.add_batch(spark.createDataFrame(rows, SCHEMA), batch, CONFIG, path, withdraw_col="gone", **options)


def weights(index):
    return sorted(tuple(r) for r in bm25.weights(index).collect())


def test_weights_after_batches_with_withdrawals(spark, tmp_path):
    path, live, opened = str(tmp_path / "index"), {}, []
    for n in range(10):
        rows = [doc(i) for i in range(10 * n, 10 * n + 10)]
        if n:
            back = 10 * n - 7  # one of the batch before goes, another is replaced, one is refused
            rows += [doc(back, gone=True), doc(back + 1, gone=True), doc(back + 1, "new"), doc(back + 2, "refused"), doc(9999, gone=True)]
            live.pop(back)
            live[back + 1] = doc(back + 1, "new")
        live.update({r[0]: r for r in rows[:10]})
        add(spark, path, rows, n, fanout=3)
        opened.append(len(segments.read_manifest(spark, path)["segments"]))
    assert max(opened) <= 2 * 3 and opened[8] == 1 and opened[9] == 2
    built = bm25.build_index(spark.createDataFrame(sorted(live.values()), SCHEMA), CONFIG)
    streamed = segments.segmented_index(spark, CONFIG, path)
    assert weights(streamed) == weights(built)
    assert streamed.stats().first() == built.stats().first()
    assert sorted(streamed.retained.collect()) == sorted(built.retained.collect())
    # Nothing that was withdrawn is left in the merged segment, nor are the withdrawals.
    merged = segments.read_manifest(spark, path)["segments"][0]
    assert (merged["first"], merged["last"], merged["withdrawn"], merged["level"]) == (0, 8, 0, 2)


def test_an_added_batch_is_not_added_again(spark, tmp_path):
    path = str(tmp_path / "index")
    for _ in range(2):
        add(spark, path, [doc(i) for i in range(12)], 0)
    assert segments.segmented_index(spark, CONFIG, path).stats().first()["documents"] == 12
    add(spark, path, [doc(3, gone=True)], 1)
    add(spark, path, [doc(3, "again")], 2)
    assert segments.segmented_index(spark, CONFIG, path).stats().first()["documents"] == 12
    assert ingest.rejected(spark, path).isEmpty()


def test_refused_documents(spark, tmp_path):
    path = str(tmp_path / "index")
    add(spark, path, [doc(i) for i in range(20)], 0)
    mixed = [doc(3), doc(50, "a"), doc(50, "b"), (None, "none", "text", "en", False), (None, "none", "text", "en", True)]
    add(spark, path, mixed, 1)
    refused = ingest.rejected(spark, path).filter("batch = 1").collect()
    assert sorted(((r.doc_id, r.definition[:1], r.reason) for r in refused), key=str) == sorted(
        [(3, "t", ingest.PRESENT), (50, "b", ingest.REPEATED), *[(None, "t", ingest.NO_ID)] * 2], key=str
    )
    with pytest.raises(ValueError, match="already present"):
        add(spark, path, [doc(4)], 2, refuse="fail")
    other = bm25.BM25Config({"name": 5}, prep=WORDS)
    with pytest.raises(ValueError, match="other field weights"):
        segments.segmented_index(spark, other, path)
    with pytest.raises(ValueError, match="no documents"):
        segments.segmented_index(spark, CONFIG, str(tmp_path / "none"))


def test_new_ids_open_no_documents(spark, tmp_path):
    """Ids that no filter holds are known to be new without a look at the documents of any segment."""
    path = str(tmp_path / "index")
    add(spark, path, [doc(i) for i in range(300)], 0)
    add(spark, path, [doc(10_000)], 1)
    assert segments.read_manifest(spark, path)["last"] == {"possible": 0, "opened": 0}
    add(spark, path, [doc(7)], 2)
    assert segments.read_manifest(spark, path)["last"]["opened"] == 1


def test_filters_hold_every_id_and_few_others(spark, tmp_path):
    path = str(tmp_path / "index")
    add(spark, path, [doc(i) for i in range(0, 4000, 2)], 0)
    found = segments.read_manifest(spark, path)["segments"]
    ids = spark.range(4000).select(F.col("id").alias("doc_id"))
    held = {r.doc_id for r in segments._may_hold(spark, path, found, ids).collect()}
    assert held >= set(range(0, 4000, 2))
    assert len(held) < 2000 + 60


def test_stream_of_segments(spark, tmp_path):
    source, path, progress = (str(tmp_path / n) for n in ("source", "index", "progress"))
    for n in range(3):
        rows = [doc(i) for i in range(8 * n, 8 * n + 8)] + ([doc(8 * n - 1, gone=True)] if n else [])
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(SCHEMA).parquet(source)
        segments.ingest_segments(arriving, CONFIG, path, progress, withdraw_col="gone", fanout=2).start().awaitTermination()
    assert segments.segmented_index(spark, CONFIG, path).stats().first()["documents"] == 22
    assert [s["level"] for s in segments.read_manifest(spark, path)["segments"]] == [1, 0]
