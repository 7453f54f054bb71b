import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.operators import ranking

MOMENT = datetime.datetime(2024, 1, 1)


def in_order(df):
    return [tuple(r)[:-1] for r in sorted(df.collect(), key=lambda r: r[-1])]


@pytest.fixture(scope="module")
def rows(spark):
    # Nulls, a repeated row, and moments that differ by a microsecond.
    data = [(i % 40 or None, "x" * (i % 3) or None, MOMENT + datetime.timedelta(microseconds=i % 2)) for i in range(300)]
    return spark.createDataFrame(data + [(7, "same", MOMENT)] * 150, "n int, t string, m timestamp")


def test_the_order_does_not_depend_on_files(spark, rows, tmp_path):
    orders = []
    for files in (1, 50):
        rows.repartition(files).write.parquet(str(tmp_path / str(files)))
        orders.append(in_order(ranking.shuffle_keyed(spark.read.parquet(str(tmp_path / str(files))), 5)))
    assert orders[0] == orders[1]
    assert sorted(map(str, orders[0])) == sorted(str(tuple(r)) for r in rows.collect())
    assert in_order(ranking.shuffle_keyed(rows, 6)) != orders[0]


def test_places_are_dense_and_copies_written_by_several_tasks_are_the_same(rows):
    whole, cut = (ranking.shuffle_keyed(rows, 5, copies=n) for n in (1 << 16, 7))
    assert sorted(r.place for r in whole.collect()) == list(range(450))
    assert in_order(whole) == in_order(cut)


def test_copies_and_rows_spread_evenly(spark):
    same = spark.range(4000).select(F.lit("a").alias("v")).union(spark.range(8000).select(F.col("id").cast("string").alias("v")))
    placed = ranking.shuffle_keyed(same, 1).toPandas()
    # Copies in twenty stretches of 600 places: 200 expected in each, with a deviation of 11.5.
    counts = np.histogram(placed[placed.v == "a"].place, bins=20, range=(0, 12000))[0]
    assert ((counts - 200) ** 2 / (200 * 2 / 3)).sum() < 50
    others = placed[placed.v != "a"]
    assert abs(np.corrcoef(others.v.astype(int), others.place)[0, 1]) < 0.05


def test_every_order_of_few_rows_is_as_likely(spark):
    rows = spark.createDataFrame([(c,) for c in "abc"], "v string").coalesce(1)
    orders = {tuple(v for (v,) in in_order(ranking.shuffle_keyed(rows, seed))) for seed in range(24)}
    assert len(orders) >= 5


def test_empty_tables_and_clashing_names(spark, rows):
    assert ranking.shuffle_keyed(rows.limit(0), 1).collect() == []
    odd = spark.createDataFrame([(1, 2)], "`a.b` int, `c d` int")
    assert in_order(ranking.shuffle_keyed(odd, 1)) == [(1, 2)]
    with pytest.raises(ValueError, match="already"):
        ranking.shuffle_keyed(rows, 1, place="n")
