import pytest

import __spark_entry__ as entry
from verification.check import compare, connect
from verification.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 20


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert not compare(spark, con, SF, name).startswith("FAIL")
