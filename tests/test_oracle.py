import pytest
from oracle import connect, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
ROWS_ONLY = sorted(set(entry.queries()) - set(ORACLES))


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    result = entry.queries()[name](spark, FOLDER).toPandas()
    assert difference(result, duck.sql(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_returns_rows(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert {r.split for r in entry.entry(spark).collect()} == {"train", "val", "test"}


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())
