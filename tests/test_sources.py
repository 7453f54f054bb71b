import datetime
import json

import pytest
from pyspark.sql import functions as F

from lexivec.functions.scores import score_round
from lexivec.operators.prepare import with_links
from lexivec.sources import metadata, tables


def test_series_csv(spark, tmp_path):
    path = tmp_path / "series.csv"
    path.write_text(
        "Series Code,Indicator Name,Long definition,Short definition\n"
        'A.1,"Rate, total","First line\nsecond ""quoted"" line",short\nB.2,Plain,,only short\nC.3,None,,\n'
    )
    rows = [tuple(r) for r in tables.read_series(spark, str(path)).collect()]
    assert rows == [
        ("A.1", "Rate, total", 'First line\nsecond "quoted" line', "short"),
        ("B.2", "Plain", None, "only short"),
        ("C.3", "None", None, None),
    ]
    wrong = tmp_path / "wrong.csv"
    wrong.write_text("Code,Name,Long,Short\nA,B,C,D\n")
    with pytest.raises(Exception, match="CSV header"):
        tables.read_series(spark, str(wrong)).collect()
    with pytest.raises(ValueError, match="format"):
        tables.read_series(spark, str(path), "xlsx")


@pytest.mark.parametrize("fmt", ["jsonl", "parquet"])
def test_corpus_round_trip(spark, tmp_path, fmt):
    rows = [("A", "n", "d\n\n\"x\"", [0.1, -2.0]), ("B", "m", None, None)]
    df = spark.createDataFrame(rows, tables.CORPUS)
    tables.write_corpus(df.withColumn("extra", F.lit(1)), str(tmp_path / fmt), fmt)
    back = tables.read_corpus(spark, str(tmp_path / fmt), fmt)
    assert back.schema == tables.CORPUS
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_corpus_json_array(spark, tmp_path):
    records = [{"code": "A", "name": "n", "definition": "d", "embedding": [0.5, 1]}, {"code": "B", "name": "m"}]
    (tmp_path / "corpus.json").write_text(json.dumps(records, indent=1))
    rows = [tuple(r) for r in tables.read_corpus(spark, str(tmp_path / "corpus.json")).collect()]
    assert rows == [("A", "n", "d", [0.5, 1.0]), ("B", "m", None, None)]


def test_lookup(spark, tmp_path):
    df = spark.createDataFrame([("A", "x"), ("B", None)], "code string, definition string")
    tables.write_lookup(df, str(tmp_path / "lookup"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "lookup")).collect())) == [("A", "x"), ("B", None)]
    with pytest.raises(ValueError, match="not unique"):
        tables.write_lookup(df.union(df), str(tmp_path / "again"))
    assert not (tmp_path / "again").exists()


def test_name_and_definition(spark):
    df = spark.createDataFrame([("a\nb\nc",), ("one",), ("",), ("\nx",)], "text string")
    rows = [(r["name"], r["definition"]) for r in tables.name_and_definition(df).collect()]
    assert rows == [("a", "b\nc"), ("one", ""), ("", ""), ("", "x")]


def test_links(spark):
    row = with_links(spark.createDataFrame([("SI.POV",)], "code string")).first()
    assert row["page_url"].endswith("/indicator/SI.POV")
    assert "/series/SI.POV/metadata?format=json" in row["metadata_url"]
    assert "indicators=SI.POV&locations=1W&start=1984" in row["chart_url"]


def test_score_round(spark):
    df = spark.createDataFrame([(0.125,), (0.12,), (2.0 / 3,)], "x double")
    assert [r[0] for r in df.select(score_round(F.col("x"))).collect()] == [0.13, 0.12, 0.67]


DOCUMENT = {
    "type": "document",
    "metadata_information": {"title": "t", "idno": "D1", "producers": [{"name": "p"}], "production_date": "2024/05/12"},
    "document_description": {
        "title_statement": {"idno": "D1", "title": "A report", "sub_title": ""},
        "authors": [{"first_name": "Ann", "full_name": "Ann B"}, {"first_name": "Cy"}],
        "date_published": "2014/07/01",
        "date_created": "",
        "identifiers": [{"type": "x", "identifier": str(i)} for i in range(4)],
        "type": "report",
        "abstract": "",
        "keywords": [{"name": f"k{i}", "vocabulary": "v"} for i in range(3)],
        "themes": [],
    },
    "provenance": [
        {"origin_description": {"harvest_date": "2024-05-12", "altered": True, "date_stamp": "2024-05-12 13:37:47"}}
    ],
    "schematype": "document",
}


def test_metadata(spark, tmp_path):
    for name, idno in (("a", "D1"), ("b", "D2")):
        made = json.loads(json.dumps(DOCUMENT))
        made["document_description"]["title_statement"]["idno"] = idno
        if idno == "D2":
            made["document_description"]["keywords"] = []
            made["provenance"] = []
        (tmp_path / f"{name}.json").write_text(json.dumps(made, indent=2))
    df = metadata.read_metadata(spark, str(tmp_path))
    rows = {r["idno"]: r for r in metadata.metadata_documents(df).collect()}
    assert rows["D1"]["date_published"] == datetime.date(2014, 7, 1)
    assert rows["D1"]["production_date"] == datetime.date(2024, 5, 12)
    assert rows["D1"]["harvest_date"] == datetime.date(2024, 5, 12)
    assert rows["D1"]["date_stamp"] == datetime.datetime(2024, 5, 12, 13, 37, 47)
    assert (rows["D1"]["abstract"], rows["D1"]["date_created"], rows["D1"]["altered"]) == (None, None, True)
    assert (rows["D2"]["harvest_date"], rows["D2"]["title"]) == (None, "A report")

    def items(field):
        return sorted((r["idno"], r[1] is not None) for r in metadata.metadata_items(df, field).collect())

    keywords = metadata.metadata_items(df, "keywords")
    assert sorted((r["idno"], r["name"] or "") for r in keywords.collect()) == [
        ("D1", "k0"), ("D1", "k1"), ("D1", "k2"), ("D2", ""),
    ]
    assert metadata.metadata_items(df, "authors").count() == 4
    assert metadata.metadata_items(df, "identifiers").count() == 8
    assert items("themes") == [("D1", False), ("D2", False)]


def test_explode_json(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "{}")], "id int, props string")
    rows = sorted((r["id"], r["name"] or "", r["value"]) for r in metadata.explode_json(df, "id", "props").collect())
    assert rows == [(1, "a", "1"), (1, "b", "x"), (2, "", None)]
