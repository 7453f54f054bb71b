import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexivec import scale
from lexivec.operators import checks, ranking
from lexivec.operators.prepare import extend_record


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows in one group, most of them with equal scores."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50 + 1).alias("query_id"),
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 9 == 0, F.col("id") * 7 % 11).otherwise(F.lit(5)).alias("units"),
    )


def order():
    return [F.col("units").desc(), F.col("doc_id").asc()]


def plain_ranks(df):
    return sorted(df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order()))).collect())


def test_rank_all_equals_a_window(hot):
    ranked = scale.rank_all(hot.repartition(7), ["query_id"], order())
    assert sorted(ranked.select("query_id", "doc_id", "units", "rank").collect()) == plain_ranks(hot)


def test_rank_all_without_groups(hot):
    ranked = scale.rank_all(hot, [], order()).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 3001))
    assert [(-r["units"], r["doc_id"]) for r in ranked] == sorted((-r["units"], r["doc_id"]) for r in ranked)


@pytest.mark.parametrize("k", [1, 7, 1000, 1001, 5000])
def test_top_per_group(hot, k):
    top = scale.top_per_group(hot, ["query_id"], order(), k)
    wanted = [r for r in plain_ranks(hot) if r["rank"] <= k]
    assert sorted(top.select("query_id", "doc_id", "units", "rank").collect()) == wanted


def test_top_per_group_cuts_before_the_shuffle(hot):
    plan = scale.top_per_group(hot, ["query_id"], order(), 5)._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("WindowGroupLimit [query_id", plan.index("Exchange"))
    assert "Partial" in plan[partial : partial + 200]


def test_pages_make_up_the_ranking(hot):
    ranked = scale.top_per_group(hot, ["query_id"], order(), 35).persist()
    pages = [ranking.page(ranked, shown).collect() for shown in range(0, 50, 10)]
    assert sorted(r for p in pages for r in p) == sorted(ranked.collect())
    assert all(len([r for r in pages[0] if r["query_id"] == q]) == 10 for q in {r["query_id"] for r in pages[0]})
    assert pages[4] == []
    one = hot.filter("query_id = 0")
    assert [r["doc_id"] for r in ranking.page_of_one(one, order(), 10, 5).collect()] == [
        r["doc_id"] for r in plain_ranks(one) if 10 < r["rank"] <= 15
    ]
    ranked.unpersist()


def test_head_sort(spark):
    rows = [(1, r, s) for r, s in enumerate([0.1, None, 0.9, 0.5, 1.0], start=1)]
    ranked = spark.createDataFrame(rows, "query_id int, rank int, score double")
    new = ranking.head_sort(ranked, "score", head=4).orderBy("new_rank").collect()
    assert [(r["new_rank"], r["rank"]) for r in new] == [(1, 3), (2, 4), (3, 1), (4, 2), (5, 5)]
    ordered = ranked.orderBy(*ranking.head_order("score", 4)).collect()
    assert [r["rank"] for r in ordered] == [3, 4, 1, 2, 5]


def test_side_by_side(spark):
    semantic = spark.createDataFrame([(1, 1, 7, 0.9), (1, 2, 8, 0.8)], "query_id int, rank int, id int, score double")
    lexical = spark.createDataFrame([(1, 1, 8, 3.0)], "query_id int, rank int, id int, score double")
    rows = ranking.side_by_side(semantic, lexical).orderBy("rank").collect()
    assert [(r["semantic_id"], r["lexical_id"], r["lexical_found"]) for r in rows] == [(7, 8, True), (8, None, False)]


def test_attach_enrich_counts_shuffle(spark):
    hits = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "query_id int, doc_id int")
    records = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id int, code string")
    for most in (None, 3):
        joined = ranking.attach_records(hits, records, most=most)
        assert sorted((r["query_id"], r["code"]) for r in joined.collect()) == [(1, "a"), (1, "b"), (2, "a")]
    listed = spark.createDataFrame(
        [("a", [("Longdefinition", "old"), ("x", "y"), ("Longdefinition", "new")]), ("b", [("x", "y")])],
        "code string, metatype array<struct<id: string, value: string>>",
    )
    assert {r["code"]: r["description"] for r in ranking.enrich(records, listed).collect()} == {"a": "new", "b": None}
    asked = hits.sparkSession.createDataFrame([(1,), (2,), (3,)], "query_id long")
    assert {r["query_id"]: r["hits"] for r in ranking.result_counts(hits, asked).collect()} == {1: 2, 2: 1, 3: 0}
    assert sorted(ranking.shuffle_rows(hits, 3).collect()) == sorted(hits.collect())


def test_extend_record(spark):
    df = spark.createDataFrame([(1, 2)], "id int, sim int")
    assert extend_record(df, {"sim": F.lit(9)}).first()["sim"] == 9
    assert extend_record(df, {"sim": F.lit(9), "show": F.lit(True)}, True).first().asDict() == {"id": 1, "sim": 2, "show": True}


def test_duplicates(spark):
    df = spark.createDataFrame([(1,), (2,), (1,)], "id int")
    assert [tuple(r) for r in checks.duplicate_ids(df, "id").collect()] == [(1, 2)]


def test_sizes(spark):
    df = spark.createDataFrame([(1, "abc", [1.0, 2.0], ["x", "yz"]), (2, None, None, None)], "i int, s string, v array<double>, w array<string>")
    assert scale.measure(df)[0] == 2
    assert scale.is_small(df)
    assert not scale.is_small(df, 1)
    assert not scale.is_small(df, 10, 20)
    assert not scale.is_small(df, 0)
    assert scale.measure(df.limit(0)) == (0, 0)


def test_partition_count_follows_the_files(spark, tmp_path):
    spark.range(200_000).select(F.rand(1).alias("r")).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert scale.partition_count(df) == 4
    assert 8 <= scale.partition_count(df, 200_000) <= 10
    # Joins and aggregates do not inflate the count.
    joined = df.join(df.withColumnRenamed("r", "s"), F.col("r") == F.col("s"))
    assert scale.partition_count(joined, 200_000) <= 20


def test_pages_after_a_cursor_make_the_ranking(spark):
    """Ties over the borders of pages, a query that ends early and one without hits."""
    from lexivec.functions.prep import WORDS
    from lexivec.operators import bm25
    from lexivec.operators.ranking import next_cursor
    from lexivec.plans.search import keyword_page_after

    docs = [(i, "same words here" if i % 3 else f"same {'other ' * (i % 7)}") for i in range(40)] + [(99, "rare")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    index = bm25.build_index(table, bm25.BM25Config({"text": 1}, prep=WORDS))
    queries = spark.createDataFrame([(1, "same words"), (2, "rare"), (3, "absent")], "query_id long, text string")
    cursor, shown = None, []
    for page in range(12):
        found = keyword_page_after(index, queries, cursor, 4).collect()
        assert all(r["rank"] <= 4 for r in found)
        shown += [(r.query_id, 4 * page + r["rank"], r.doc_id, r.score) for r in found]
        kept = spark.createDataFrame(found, "query_id long, doc_id long, score double, rank int")
        cursor = spark.createDataFrame(next_cursor(kept, "score", "doc_id", cursor).collect(), "query_id long, score double, doc_id long")
    whole = bm25.search(index, queries, None).collect()
    assert sorted(shown) == sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in whole)
