import pytest
from pyspark.sql import functions as F

from lexivec.operators.nearest import vector_topk_batch
from lexivec.streaming import standing

SCHEMA = "id long, vector array<double>"
COLUMNS = ["query_id", "id", "sim", "rank"]


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    standing.use_state_store(spark)
    yield
    spark.conf.set(name, before)


def corpus(n, start=0):
    # Few different directions, so that many similarities are equal and ids decide.
    return [(i, [float(i * 7 % 5), 1.0, float(-(i % 3))]) for i in range(start, start + n)]


@pytest.fixture
def asked(spark):
    rows = [(q, [1.0, q * 0.5, 0.25 * q]) for q in range(6)] + [(99, None)]
    return spark.createDataFrame(rows, "query_id long, vector array<double>")


def listen(spark, folder, asked, **options):
    arriving = spark.readStream.schema(SCHEMA).parquet(str(folder / "arrived"))
    standing.standing_queries(arriving, asked, str(folder / "lists"), str(folder / "progress"), **options).start().awaitTermination()
    return standing.standing_answers(spark, str(folder / "lists")).select(COLUMNS)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).coalesce(1).write.mode("append").parquet(str(folder / "arrived"))


def test_lists_equal_the_batch_result_after_every_batch(spark, tmp_path, asked, store):
    # Late documents come with small ids, to win ties against hits that are held.
    batches = [corpus(30, 100), corpus(40, 0) + [(7777, None)], [(500, [-9.0, -9.0, 0.0])], corpus(30, 60)]
    seen = []
    for batch in batches:
        arrive(spark, tmp_path, batch)
        seen += batch
        # Each round is a new run of the stream that goes on from the checkpoint.
        got = listen(spark, tmp_path, asked, k=4)
        want = vector_topk_batch(spark.createDataFrame(seen, SCHEMA), asked, 4).select(COLUMNS)
        assert sorted(got.collect()) == sorted(want.collect())
    earlier = standing.standing_answers(spark, str(tmp_path / "lists"), until=0).select(COLUMNS)
    first = vector_topk_batch(spark.createDataFrame(batches[0], SCHEMA), asked, 4).select(COLUMNS)
    assert sorted(earlier.collect()) == sorted(first.collect())


def test_unchanged_lists_are_not_written_again(spark, tmp_path, asked, store):
    arrive(spark, tmp_path, corpus(30))
    listen(spark, tmp_path, asked, k=3)
    arrive(spark, tmp_path, [(900, [-50.0, -50.0, 0.0])])
    listen(spark, tmp_path, asked, k=3)
    stored = spark.read.parquet(str(tmp_path / "lists"))
    assert {r["batch"] for r in stored.select("batch").distinct().collect()} == {0}


def test_floor_and_short_lists(spark, tmp_path, asked, store):
    arrive(spark, tmp_path, corpus(5))
    got = listen(spark, tmp_path, asked, k=10, above=3.0)
    want = vector_topk_batch(spark.createDataFrame(corpus(5), SCHEMA), asked, 10, above=3.0).select(COLUMNS)
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.filter(F.col("sim") <= 3.0).count() == 0


def test_text_ids(spark, tmp_path, store):
    documents = spark.createDataFrame([("b", [1.0]), ("a", [1.0]), ("c", [2.0])], "id string, vector array<double>")
    asked = spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>")
    documents.write.parquet(str(tmp_path / "arrived"))
    arriving = spark.readStream.schema(documents.schema).parquet(str(tmp_path / "arrived"))
    standing.standing_queries(arriving, asked, str(tmp_path / "lists"), str(tmp_path / "progress"), k=2).start().awaitTermination()
    got = standing.standing_answers(spark, str(tmp_path / "lists")).select(COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == [("q", "a", 1.0, 2), ("q", "c", 2.0, 1)]


def test_refusals(spark, tmp_path, asked, store):
    table = spark.createDataFrame(corpus(3), SCHEMA)
    with pytest.raises(ValueError, match="must be a stream"):
        standing.best_so_far(table, asked)
    table.write.parquet(str(tmp_path / "arrived"))
    arriving = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "arrived"))
    with pytest.raises(ValueError, match="at least 1"):
        standing.best_so_far(arriving, asked, k=0)
    with pytest.raises(ValueError, match="several"):
        standing.best_so_far(arriving, asked, k=10**7)


def test_queries_that_are_too_many_for_one_stream(spark, tmp_path, asked, store, monkeypatch):
    assert len(standing.query_sets(asked)) == 1
    monkeypatch.setattr(standing, "BROADCAST_ROWS", 4)
    sets = standing.query_sets(asked.union(asked.filter("query_id = 1")))
    assert len(sets) == 3
    assert sorted(r.query_id for s in sets for r in s.collect()) == [0, 1, 1, 2, 3, 4, 5, 99]
