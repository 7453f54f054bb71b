import math
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexivec.functions.prep import CONTENT_WORDS, WORDS
from lexivec.operators import bm25
from lexivec.operators.bm25 import BM25Config
from lexivec.sources import index_store
from lexivec.sources.index_store import load_index, save_index

DOCS = [
    (0, "poverty rate", "share of people in poverty and people at risk", "en"),
    (1, "child health", "poverty of a child", "en"),
    (2, "people", "people people people", "es"),
    (3, "", "", "es"),
    (4, "rate", None, "fr"),
    (5, "people", "people people people", "fr"),
]
QUERIES = [(1, "people poverty people"), (2, "nothing known"), (3, "rate RATE child"), (4, ""), (5, "people rate")]


def brute_force(docs, queries, weights, places=4, k1=1.2, b=0.75, k=1.0):
    """The published formula, by plain loops."""
    freqs, lengths = {}, {}
    for doc_id, *fields, _ in docs:
        freqs[doc_id], lengths[doc_id] = Counter(), 0.0
        for text, weight in zip(fields, weights, strict=True):
            words = (text or "").lower().split()
            lengths[doc_id] += len(words) * abs(weight)
            for word in words:
                freqs[doc_id][word] += weight
    mean = sum(lengths.values()) / len(docs)
    df = Counter(w for f in freqs.values() for w in f)
    results = {}
    for query_id, text in queries:
        scores = {}
        for word in text.lower().split():
            for doc_id, f in freqs.items():
                if word in f:
                    idf = math.log((len(docs) - df[word] + 0.5) / (df[word] + 0.5) + k)
                    norm = 1 - b + b * lengths[doc_id] / mean
                    raw = abs(f[word] * (k1 + 1) / (k1 * norm + f[word])) * idf if f[word] else 0.0
                    sign = (f[word] > 0) - (f[word] < 0)
                    units = sign * math.copysign(math.floor(abs(raw) * 10**places + 0.5), raw)
                    scores[doc_id] = scores.get(doc_id, 0) + units
        ranked = sorted(scores.items(), key=lambda s: (-s[1], s[0]))
        results[query_id] = [(d, s / 10**places) for d, s in ranked]
    return {q: r for q, r in results.items() if r}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, name string, definition string, lang string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string")


def config(**options):
    return BM25Config({"name": 2, "definition": 1}, **{"prep": WORDS, **options})


def found(hits):
    rows = sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"]))
    result = {}
    for r in rows:
        result.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(result[r["query_id"]])
    return result


@pytest.mark.parametrize("weights", [(2, 1), (1, -0.5), (0.1, 0.3), (-2, 1)])
def test_equals_brute_force(docs, queries, weights):
    built = bm25.build_index(docs, BM25Config(dict(zip(("name", "definition"), weights, strict=True)), prep=WORDS))
    assert found(bm25.search(built, queries)) == brute_force(DOCS, QUERIES, weights)


@pytest.mark.parametrize(("k1", "b", "k"), [(0.0, 0.0, 0.0), (2.0, 1.0, 0.5), (1.2, 0.3, 3.0)])
def test_parameters(docs, queries, k1, b, k):
    built = bm25.build_index(docs, config(k1=k1, b=b, k=k), precision=6)
    assert found(bm25.search(built, queries)) == brute_force(DOCS, QUERIES, (2, 1), 6, k1, b, k)


def test_ties_by_document(docs, queries):
    hits = found(bm25.search(bm25.build_index(docs, config()), queries))[1]
    assert [d for d, s in hits if s == dict(hits)[2]] == [2, 5]


@pytest.mark.parametrize(("limit", "most"), [(1, 1), (2, 2), (0, 10), (-1, 1), (100, 10), (5000, 10), (None, 10)])
def test_limits(docs, queries, limit, most):
    hits = found(bm25.search(bm25.build_index(docs, config()), queries, limit))
    assert hits == {q: r[:most] for q, r in brute_force(DOCS, QUERIES, (2, 1)).items()}


def test_join_by_term_with_every_term_split(docs, queries, monkeypatch):
    monkeypatch.setattr(bm25, "HOT_FLOOR", 1)
    monkeypatch.setattr(bm25, "HOT_SHARE", 0.0)
    built = bm25.build_index(docs, config())
    assert found(bm25.search(built, queries, broadcast_rows=0)) == brute_force(DOCS, QUERIES, (2, 1))
    split = bm25.weights(built).collect()
    monkeypatch.undo()
    whole = bm25.weights(built).collect()
    assert sorted(split) == sorted(whole)
    assert len(whole) == 17


def test_filter(docs, queries):
    built = bm25.build_index(docs, config(retained=["lang"]))
    hits = found(bm25.search(built, queries, where=F.col("lang") != "es"))
    kept = {q: [(d, s) for d, s in r if DOCS[d][3] != "es"] for q, r in brute_force(DOCS, QUERIES, (2, 1)).items()}
    assert hits == kept
    assert {r["lang"] for r in built.retained.collect()} == {"en", "es", "fr"}


def test_document_order_does_not_matter(docs, queries):
    turned = docs.orderBy(F.col("doc_id").desc()).repartition(3)
    built = bm25.build_index(turned, config())
    assert found(bm25.search(built, queries)) == brute_force(DOCS, QUERIES, (2, 1))


def test_documents_read_in_place(docs, queries):
    built = bm25.build_index(docs.repartition(3), config(), spread=False)
    assert found(bm25.search(built, queries)) == brute_force(DOCS, QUERIES, (2, 1))


def test_default_preparation(spark):
    rows = [
        (1, "Child meals", "Children were not eating healthy meals. They played."),
        (2, "Healthy eating", "The kids eat well."),
        (3, "Poverty", "Rates of poverty."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, name string, definition string")
    built = bm25.build_index(docs, BM25Config({"name": 2, "definition": 1}))
    queries = spark.createDataFrame([(1, "eats healthy"), (2, "not eating"), (3, "the")], "query_id long, text string")
    hits = found(bm25.search(built, queries))
    assert {q: [d for d, _ in r] for q, r in hits.items()} == {1: [2], 2: [1]}


def test_stats_and_empty_documents(docs):
    built = bm25.build_index(docs, config())
    stats = built.stats().first()
    assert (stats["documents"], stats["total_length"]) == (6, 33.0)
    assert stats["mean_length"] == stats["total_length"] / 6
    assert {r["doc_id"]: r["length"] for r in built.documents.collect()}[3] == 0.0
    assert stats["terms"] == built.idf.count()


def test_vocabulary_in_first_seen_order(docs):
    rows = bm25.vocabulary(docs, config()).orderBy("term_id").collect()
    words = [w for d in DOCS for text in d[1:3] for w in (text or "").split()]
    assert [r["term"] for r in rows] == list(dict.fromkeys(words))
    assert [r["term_id"] for r in rows] == list(range(len(rows)))


def test_inverted_index_blocks(docs):
    rows = bm25.inverted_index(bm25.build_index(docs, config()), block=2).collect()
    by_term = {(r["term"], r["block"]): r["doc_ids"] for r in rows}
    assert by_term["people", 0] == [0, 2]
    assert by_term["people", 1] == [5]
    assert by_term["poverty", 0] == [0, 1]


def test_preparation_by_field(docs, queries):
    marked = [*WORDS, lambda tokens: F.transform(tokens, lambda t: F.concat(t, F.lit("*")))]
    built = bm25.build_index(docs, config(field_prep={"name": marked, "search": marked}))
    hits = found(bm25.search(built, queries))
    assert {q: {d for d, _ in r} for q, r in hits.items()} == {1: {0, 2, 5}, 3: {0, 1, 4}, 5: {0, 2, 4, 5}}


def test_save_and_load(spark, docs, queries, tmp_path):
    path = str(tmp_path / "index")
    built = bm25.build_index(docs, config(retained=["lang"]), precision=5)
    save_index(built, path)
    loaded = load_index(spark, path, WORDS)
    assert (loaded.precision, loaded.config.retained, loaded.config.field_weights) == (
        5,
        ("lang",),
        {"name": 2.0, "definition": 1.0},
    )
    wanted = brute_force(DOCS, QUERIES, (2, 1), 5)
    assert found(bm25.search(loaded, queries)) == wanted
    assert found(bm25.search(loaded, queries, broadcast_rows=0)) == wanted
    assert found(bm25.search(loaded, queries, where=F.col("lang") == "fr"))
    one = queries.filter("query_id = 3")
    assert found(bm25.search(loaded, one)) == {3: wanted[3]}
    assert sorted(bm25.weights(loaded).collect()) == sorted(bm25.weights(built).collect())


def test_load_checks_the_format(spark, docs, tmp_path):
    with pytest.raises(ValueError, match="no index"):
        load_index(spark, str(tmp_path / "absent"))
    path = str(tmp_path / "index")
    save_index(bm25.build_index(docs, config()), path)
    (totals,) = Path(path).glob("*/totals")
    spark.range(3).write.mode("overwrite").parquet(str(totals))
    with pytest.raises(ValueError, match="no valid table totals"):
        load_index(spark, path)
    spark.createDataFrame([(99, 0, "{}")], "version int, number int, meta string").write.mode("overwrite").parquet(path + "/meta")
    with pytest.raises(ValueError, match="format"):
        load_index(spark, path)


def test_a_load_sees_a_whole_index_while_another_is_written(spark, docs, queries, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    save_index(bm25.build_index(docs, config()), path)
    old = found(bm25.search(load_index(spark, path, WORDS), queries))
    with pytest.raises(ValueError, match="there is an index"):
        save_index(bm25.build_index(docs, config()), path)
    other = bm25.build_index(docs.filter("doc_id <> 0"), config())
    seen = []
    real = index_store.with_units

    def watched(*given):
        seen.append(found(bm25.search(load_index(spark, path, WORDS), queries)))
        return real(*given)

    monkeypatch.setattr(index_store, "with_units", watched)
    save_index(other, path, mode="overwrite")
    assert seen == [old]
    new = found(bm25.search(load_index(spark, path, WORDS), queries))
    assert new == found(bm25.search(other, queries)) != old


def test_input_checks(spark, docs):
    with pytest.raises(ValueError, match="at least 3"):
        bm25.build_index(docs.limit(2), config())
    with pytest.raises(ValueError, match="duplicate document id: 1"):
        bm25.build_index(docs.union(docs.filter("doc_id = 1")), config())
    with pytest.raises(ValueError, match="is null"):
        bm25.build_index(docs.withColumn("doc_id", F.expr("nullif(doc_id, 2)")), config())
    for wrong in (BM25Config({"absent": 1}), config(retained=["absent"])):
        with pytest.raises(ValueError, match="missing field in the documents: absent"):
            bm25.build_index(docs, wrong)
    with pytest.raises(TypeError, match="array of strings"):
        bm25.build_index(docs, config(prep=[F.lower]))


def test_config_checks_and_defaults():
    for weights in ({}, None, {"a": 0}, {"a": None}, {"a": "x"}, {"a": math.nan}):
        with pytest.raises(ValueError, match="weight"):
            BM25Config(weights)
    made = BM25Config({"a": -1, "b": "2"}, k1=-1, b=1.5, k="x")
    assert (made.k1, made.b, made.k, made.field_weights) == (1.2, 0.75, 1.0, {"a": -1.0, "b": 2.0})
    kept = BM25Config({"a": 1}, k1=0, b=0, k=0)
    assert (kept.k1, kept.b, kept.k) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError, match="retained"):
        BM25Config({"a": 1}, retained=[""])
    with pytest.raises(ValueError, match="retained"):
        BM25Config({"a": 1}, retained="lang")
    with pytest.raises(ValueError, match="list of functions"):
        BM25Config({"a": 1}, prep=["x"])
    with pytest.raises(ValueError, match="no weighted field"):
        BM25Config({"a": 1}, field_prep={"b": WORDS})
    assert BM25Config({"a": 1}, field_prep={"search": CONTENT_WORDS}).steps("search") == CONTENT_WORDS


@pytest.mark.parametrize(("given", "places"), [(None, 4), ("x", 4), (2, 4), (7, 7), (20, 9), ("6", 6), (5.9, 5)])
def test_precision(given, places):
    assert bm25.precision_of(given) == places


def test_learner_names():
    assert bm25.learn is bm25.build_index
    assert bm25.predict is bm25.search


def test_counted_index_reads_no_text_again(spark):
    docs = spark.createDataFrame([(i, f"word{i} shared", "shared text") for i in range(5)], "doc_id long, name string, definition string")
    built = bm25.build_index(docs, bm25.BM25Config({"name": 2, "definition": 1}))
    once = bm25.counted(built)
    assert once.tokens is None and bm25.counted(once) is once
    for table in ("postings", "documents", "terms", "totals"):
        plan = getattr(once, table)._jdf.queryExecution().optimizedPlan().toString()
        assert "definition" not in plan
        assert sorted(map(tuple, getattr(once, table).collect())) == sorted(map(tuple, getattr(built, table).collect()))
