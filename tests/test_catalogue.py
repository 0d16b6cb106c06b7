"""Every query that SQL can state, against that SQL, on the smallest data."""

import __spark_entry__ as entry
import pytest
from compare import compare, connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    ok, note = compare(spark, con, name, FOLDER)
    assert ok, note


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
