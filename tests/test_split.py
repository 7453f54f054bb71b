import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lexivec.sources import split
from lexivec.sources.tables import SERIES, read_corpus, read_series

HARD = ['a "quoted" word', "back\\slash\\", '\\"', "{[", "]}", "日本語 ñ 😀", "line\nbreak", "", '\\\\"}', None, ","]


def located(data, size, is_json):
    """The ranges of these bytes with what they begin in, composed as the reader does it."""

    def read(at, n):
        return data[at : at + n]

    state, depth, out = split.OUTSIDE, 0, []
    for start in range(0, len(data), size):
        stop = min(len(data), start + size)
        out.append((start, stop, state, depth))
        state, rise = split._transitions(read, start, stop, is_json)[state]
        depth += rise
    return read, out


VALUES = st.recursive(
    st.none() | st.integers() | st.text(alphabet='a"\\{}[],:\n é😀', max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(alphabet='"\\{}é', max_size=3), inner, max_size=3),
    max_leaves=6,
)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["x", 'y"', "z\\"]), VALUES, max_size=3), max_size=6), st.integers(1, 40), st.booleans(), st.integers(1, 9))
def test_json_records_at_any_border(records, size, plain, block):
    text = json.dumps(records, ensure_ascii=plain, indent=None if plain else 1).encode()
    before, split.BLOCK = split.BLOCK, block
    try:
        read, ranges = located(text, size, True)
        found = [json.loads(r) for place in ranges for r in split._json_records(read, *place)]
    finally:
        split.BLOCK = before
    assert found == records


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='a",\n\ré', max_size=6), min_size=2, max_size=2), max_size=6), st.integers(1, 30), st.booleans(), st.integers(1, 9))
def test_csv_records_at_any_border(rows, size, ended, block):
    records = [",".join('"' + v.replace('"', '""') + '"' for v in row).encode() for row in [["h", "i"], *rows]]
    text = b"\r\n".join(records) + (b"\n" if ended else b"")
    before, split.BLOCK = split.BLOCK, block
    try:
        read, ranges = located(text, size, False)
        found = [
            r for place in ranges for r in split._after_header(split._csv_records(read, *place), ["h", "i"], place[0] == 0)
        ]
    finally:
        split.BLOCK = before
    assert found == records[1:]


def corpus(n):
    return [{"code": f"c{i}", "name": HARD[i % len(HARD)], "definition": HARD[i * 3 % len(HARD)], "embedding": [i / 4, -1.5]} for i in range(n)]


@pytest.mark.parametrize("size", [7, 64, 1000, 10**9])
def test_array_equals_the_whole_file_reader(spark, tmp_path, size):
    folder = tmp_path / "with blank"
    folder.mkdir()
    # The smaller the ranges, the fewer records, as each range is a task of its own.
    n = 12 if size < 100 else 60
    (folder / "a.json").write_text(json.dumps(corpus(n), ensure_ascii=False), "utf-8")
    (folder / "b.json").write_text("\ufeff" + json.dumps(corpus(3), indent=2), "utf-8")
    (folder / "c.json").write_text("[]")
    (folder / "d.json").write_text("")
    read = split.read_corpus_split(spark, str(folder), range_bytes=size if size > 7 else 37)
    want = [tuple(r.values()) for r in corpus(n) + corpus(3)]
    assert sorted(map(str, map(tuple, read.collect()))) == sorted(map(str, want))
    assert sorted(map(str, read_corpus(spark, str(folder / "a.json")).collect())) == sorted(map(str, split.read_corpus_split(spark, str(folder / "a.json")).collect()))


def test_one_file_is_many_tasks(spark, tmp_path):
    file = tmp_path / "a.json"
    file.write_text(json.dumps(corpus(200)))
    records = split.split_records(spark, str(file), range_bytes=2000)
    from pyspark.sql import functions as F

    assert records.count() == 200
    assert records.select(F.spark_partition_id().alias("p")).distinct().count() > 2


@pytest.mark.parametrize("size", [50, 10**9])
def test_csv_equals_the_whole_file_reader(spark, tmp_path, size):
    names = SERIES.fieldNames()
    rows = [[f"c{i}", HARD[i % len(HARD)] or "", HARD[i * 3 % len(HARD)] or "", "plain"] for i in range(25)]
    quoted = [",".join('"' + v.replace('"', '""') + '"' for v in row) for row in [names, *rows]]
    (tmp_path / "a.csv").write_text("\n".join([quoted[0], "c,unquoted,,", "", *quoted[1:]]), "utf-8")
    got, want = split.read_series_split(spark, str(tmp_path), range_bytes=size), read_series(spark, str(tmp_path))
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize(
    ("text", "message"),
    [('[{"code": "a}]', "left open"), ('[{"code": "a"}', "left open"), ('{"code": "a"}', "does not begin"), ('[{"code": 1 2}]', "MALFORMED|Malformed")],
)
def test_broken_arrays_are_errors(spark, tmp_path, text, message):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=message):
        split.read_corpus_split(spark, str(tmp_path / "a.json"), range_bytes=5).collect()


def test_wrong_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("one,two\n1,2\n")
    schema = T.StructType([T.StructField("two", T.StringType()), T.StructField("one", T.StringType())])
    with pytest.raises(Exception, match="columns of the file"):
        split.read_series_split(spark, str(tmp_path / "a.csv"), schema).collect()
    with pytest.raises(ValueError, match="at least 1"):
        split.read_series_split(spark, str(tmp_path / "a.csv"), schema, range_bytes=0)


def test_little_is_read_past_the_end_of_a_small_range():
    data = b"[" + b",".join(b'{"a":%d}' % i for i in range(1000)) + b"]"
    asked = []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    assert len(list(split._json_records(read, 0, 64, split.OUTSIDE, 0))) == 8
    assert max(asked) <= 64


def test_small_ranges_share_tasks(spark):
    ranges = spark.range(5000).selectExpr("'f' AS path", "5000L AS length", "id AS start", "id + 1 AS stop")
    assert split._spread(ranges).rdd.getNumPartitions() <= 8
