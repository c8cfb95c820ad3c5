import os

import pytest

import __spark_entry__ as registered
from compare import database, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", registered.queries())
def test_query_agrees_with_its_sql(spark, con, name):
    frame = registered.queries()[name](spark, SF_DIR).toPandas()
    sql = registered.oracle_sql().get(name)
    if sql:
        assert difference(frame, con.sql(sql).df()) is None
    else:
        assert len(frame.columns)


def test_entry(spark):
    assert registered.entry(spark).count() > 0
    assert set(registered.oracle_sql()) <= set(registered.queries())
