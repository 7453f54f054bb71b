"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from checks.compare import connect, difference
from checks.oracles import ORACLES
from checks.queries import QUERIES

FOLDER = entry_module.SMOKE_TABLES

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are absent")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_entry(spark):
    result = entry_module.entry(spark)
    assert result.columns == [
        "query_id", "rank", "semantic_id", "semantic_score", "lexical_id", "lexical_score", "lexical_found", "semantic_low",
    ]
    assert result.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= entry_module.queries().items()
    assert ORACLES.items() <= entry_module.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    result = QUERIES[name](spark, FOLDER)
    plan = result._jdf.queryExecution().executedPlan().toString()
    # The label grid of the confusion matrix is the only table made of all pairs, and needs no join.
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert difference(result.toPandas(), connection.execute(ORACLES[name]).df()) is None
