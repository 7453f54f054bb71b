import math

import pytest
from pyspark.sql import functions as F

from lexivec.functions import scores, vectors


def value(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


PAIR = "x array<double>, y array<double>"


def test_dot_and_cosine_known_values(spark):
    assert value(spark, vectors.dot(F.col("x"), F.col("y")), PAIR, [1.0, 2.0], [2.0, 3.0]) == 8.0
    cosine = value(spark, vectors.cosine(F.col("x"), F.col("y")), PAIR, [1.0, 2.0], [2.0, 3.0])
    assert cosine == pytest.approx(8 / math.sqrt(65), abs=1e-12)


def test_empty_vectors_give_null(spark):
    for f in (vectors.dot, vectors.cosine):
        assert value(spark, f(F.col("x"), F.col("y")), PAIR, [], []) is None
    assert value(spark, vectors.l2norm(F.col("x")), PAIR, [], []) is None
    assert value(spark, vectors.dot(F.col("x"), F.col("y")), PAIR, None, [1.0]) is None


def test_unequal_length_is_an_error(spark):
    for f in (vectors.dot, vectors.cosine):
        with pytest.raises(Exception, match="equal length"):
            value(spark, f(F.col("x"), F.col("y")), PAIR, [1.0], [1.0, 2.0])
    with pytest.raises(Exception, match="equal length"):
        value(spark, vectors.dot_literal(F.col("x"), [1.0]), PAIR, [1.0, 2.0], [])


def test_zero_vector(spark):
    assert value(spark, vectors.l2norm(F.col("x")), PAIR, [0.0, 0.0], []) == 0.0
    assert math.isnan(value(spark, vectors.cosine(F.col("x"), F.col("y")), PAIR, [0.0, 0.0], [1.0, 2.0]))


def test_norm_does_not_overflow(spark):
    assert value(spark, vectors.l2norm(F.col("x")), PAIR, [3e200, -4e200], []) == pytest.approx(5e200)
    assert value(spark, vectors.l2norm(F.col("x")), PAIR, [3e-200, 4e-200], []) == pytest.approx(5e-200)


def test_accessor_gets_element_index_and_side(spark):
    schema = "x array<struct<v: double>>, y array<struct<v: double>>"
    accessor = lambda e, i, side: e["v"] + i * 10 + side
    x, y = [(1.0,), (2.0,)], [(3.0,), (4.0,)]
    a, b = [1.0, 12.0], [4.0, 15.0]
    dot = value(spark, vectors.dot(F.col("x"), F.col("y"), accessor), schema, x, y)
    assert dot == a[0] * b[0] + a[1] * b[1]
    cosine = value(spark, vectors.cosine(F.col("x"), F.col("y"), accessor), schema, x, y)
    assert cosine == pytest.approx(dot / (math.hypot(*a) * math.hypot(*b)))
    norm = value(spark, vectors.l2norm(F.col("x"), lambda e, i: e["v"] + i * 10), schema, x, y)
    assert norm == pytest.approx(math.hypot(*a))


def test_dot_literal_short_and_long(spark):
    assert value(spark, vectors.dot_literal(F.col("x"), [2.0, 3.0]), PAIR, [1.0, 2.0], []) == 8.0
    long = [0.5] * (vectors.UNROLL_LIMIT + 1)
    assert value(spark, vectors.dot_literal(F.col("x"), long), PAIR, [2.0] * len(long), []) == len(long)
    assert value(spark, vectors.dot_literal(F.col("x"), []), PAIR, [], []) == 0.0


def test_half_away(spark):
    rows = [(0.00005, 0.0001), (-0.00005, -0.0001), (1.23456, 1.2346), (0.0, 0.0), (-1.23444, -1.2344)]
    df = spark.createDataFrame(rows, "x double, want double")
    assert df.filter(scores.half_away(F.col("x"), 4) != F.col("want")).count() == 0


def test_finite(spark):
    rows = [(1.0, True, True), (1.5, True, False), (math.inf, False, False), (math.nan, False, False), (None, False, None)]
    df = spark.createDataFrame(rows, "x double, n boolean, i boolean")
    got = df.select(
        scores.is_finite_number(F.col("x")).alias("n"), F.coalesce(scores.is_finite_integer(F.col("x")), F.lit(False)).alias("i")
    ).collect()
    assert [r["n"] for r in got] == [r[1] for r in rows]
    assert [r["i"] for r in got] == [bool(r[2]) for r in rows]


def test_low_confidence(spark):
    rows = [(0.5, None), (0.9, None), (0.5, 0.2), (0.9, 0.1)]
    df = spark.createDataFrame(rows, "sim double, r double")
    got = df.select(scores.low_confidence(F.col("sim"), F.col("r")).alias("low")).collect()
    assert [r["low"] for r in got] == [True, False, False, True]
