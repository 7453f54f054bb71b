import pytest

from lexivec.functions.prep import WORDS
from lexivec.operators import bm25, nearest
from lexivec.sources.index_store import load_index, save_index
from lexivec.streaming import answer, ingest

CONFIG = bm25.BM25Config({"name": 2, "definition": 1}, retained=["lang"], prep=WORDS)
SCHEMA = "doc_id long, name string, definition string, lang string"
FIRST = [(i, f"name {i % 3}", f"text of {i % 5} words", "en") for i in range(20)]
SECOND = [(i, f"name {i % 4}", f"more text {i % 7}", "es") for i in range(15, 40)]


def test_ingest_adds_each_document_once(spark, tmp_path):
    source, path, progress = (str(tmp_path / n) for n in ("source", "index", "progress"))

    def run():
        arriving = spark.readStream.schema(SCHEMA).parquet(source)
        ingest.ingest(arriving, CONFIG, path, progress).start().awaitTermination()

    # Repeats inside a batch, and ids of an earlier batch, are left out.
    spark.createDataFrame([*FIRST, *FIRST[:7]], SCHEMA).repartition(2).write.mode("append").parquet(source)
    run()
    assert ingest.ingested_index(spark, CONFIG, path).stats().first()["documents"] == 20
    spark.createDataFrame(SECOND, SCHEMA).write.mode("append").parquet(source)
    run()
    run()
    streamed = ingest.ingested_index(spark, CONFIG, path)
    whole = bm25.build_index(spark.createDataFrame([*FIRST, *(d for d in SECOND if d[0] >= 20)], SCHEMA), CONFIG)
    queries = spark.createDataFrame([(1, "name 2 more"), (2, "text words 3")], "query_id long, text string")
    for limit in (10, 100):
        assert sorted(bm25.search(streamed, queries, limit).collect()) == sorted(
            bm25.search(whole, queries, limit).collect()
        )
    assert sorted(streamed.retained.collect()) == sorted(whole.retained.collect())
    save_index(streamed, str(tmp_path / "saved"))
    saved = load_index(spark, str(tmp_path / "saved"), WORDS)
    assert sorted(bm25.search(saved, queries).collect()) == sorted(bm25.search(whole, queries).collect())


def test_a_retried_batch_replaces_its_first_attempt(spark, tmp_path):
    path = str(tmp_path / "index")
    batch = spark.createDataFrame(FIRST, SCHEMA)
    for _ in range(2):
        ingest._add_batch(batch, 0, CONFIG, path, "doc_id")
    ingest._add_batch(spark.createDataFrame(SECOND, SCHEMA), 1, CONFIG, path, "doc_id")
    ingest._add_batch(spark.createDataFrame(SECOND, SCHEMA), 1, CONFIG, path, "doc_id")
    assert ingest.ingested_index(spark, CONFIG, path).stats().first()["documents"] == 40


def test_answers_equal_the_batch_result(spark, tmp_path):
    corpus = spark.createDataFrame([(i, [i / 7, 1.0 - i / 9]) for i in range(30)], "id long, vector array<double>")
    asked = spark.createDataFrame([(q, [q * 0.1, 1.0]) for q in range(8)], "query_id long, vector array<double>")
    asked.repartition(3).write.parquet(str(tmp_path / "asked"))
    arriving = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "asked"))
    path = str(tmp_path / "answers")
    answer.answer_vectors(arriving, corpus, path, str(tmp_path / "progress"), 4).start().awaitTermination()
    columns = ["query_id", "id", "sim", "rank"]
    got = answer.answers(spark, path).select(columns).collect()
    assert sorted(got) == sorted(nearest.vector_topk_batch(corpus, asked, 4).select(columns).collect())


def test_keyword_answers(spark, tmp_path):
    index = bm25.build_index(spark.createDataFrame(FIRST, SCHEMA), CONFIG)
    asked = spark.createDataFrame([(1, "name 2"), (2, "words 3")], "query_id long, text string")
    asked.write.parquet(str(tmp_path / "asked"))
    arriving = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "asked"))
    path = str(tmp_path / "answers")
    answer.answer_keywords(arriving, index, path, str(tmp_path / "progress")).start().awaitTermination()
    got = answer.answers(spark, path).select("query_id", "doc_id", "score", "rank").collect()
    assert sorted(got) == sorted(bm25.search(index, asked).collect())


def test_refused_documents_are_recorded(spark, tmp_path):
    path = str(tmp_path / "index")
    ingest._add_batch(spark.createDataFrame(FIRST, SCHEMA), 0, CONFIG, path, "doc_id")
    mixed = [FIRST[3], (50, "new", "text", "en"), (50, "another", "text", "en"), (None, "none", "text", "en"), (None, "none", "text", "en")]
    for _ in range(2):  # a retry refuses the same rows
        ingest._add_batch(spark.createDataFrame(mixed, SCHEMA), 1, CONFIG, path, "doc_id")
    refused = ingest.rejected(spark, path).filter("batch = 1").collect()
    assert sorted(((r.doc_id, r.name, r.reason) for r in refused), key=str) == sorted(
        [(3, FIRST[3][1], ingest.PRESENT), (50, "new", ingest.REPEATED), *[(None, "none", ingest.NO_ID)] * 2], key=str
    )
    assert ingest.ingested_index(spark, CONFIG, path).stats().first()["documents"] == 21
    with pytest.raises(ValueError, match="already present"):
        ingest._add_batch(spark.createDataFrame(FIRST[:1], SCHEMA), 2, CONFIG, path, "doc_id", refuse="fail")
    assert ingest.ingested_index(spark, CONFIG, path).stats().first()["documents"] == 21


def test_a_stream_keeps_its_settings(spark, tmp_path):
    path, source = str(tmp_path / "index"), str(tmp_path / "source")
    spark.createDataFrame(FIRST, SCHEMA).write.parquet(source)
    arriving = spark.readStream.schema(SCHEMA).parquet(source)
    ingest.ingest(arriving, CONFIG, path, str(tmp_path / "progress")).start().awaitTermination()
    other = bm25.BM25Config({"name": 5, "definition": 1}, retained=["lang"], prep=WORDS)
    with pytest.raises(ValueError, match="other field weights"):
        ingest.ingest(arriving, other, path, str(tmp_path / "more"))
    with pytest.raises(ValueError, match="other field weights"):
        ingest.ingested_index(spark, other, path)


def test_a_table_that_is_a_folder_of_files_is_a_stream(spark, tmp_path):
    from checks.queries import table_stream

    rows = spark.range(10)
    rows.repartition(3).write.parquet(str(tmp_path / "a.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "b.parquet")
    for name in "ab":
        found = table_stream(spark, str(tmp_path), name, rows.schema)
        out = str(tmp_path / f"out-{name}")
        started = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"at-{name}"))
        started.trigger(availableNow=True).start(out).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(10))
