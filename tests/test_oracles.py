"""Every query with an equivalent statement, on the smallest tables."""

import pytest
from harness import connection, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CORE = {name: sql for name, sql in entry.oracle_sql().items() if name[:1] != "p" or not name[1:2].isdigit() or name[2:3].isdigit()}


@pytest.fixture(scope="module")
def con():
    found = connection(FOLDER)
    found.execute("set TimeZone = 'UTC'")
    return found


def test_every_statement_has_its_query():
    assert not set(entry.oracle_sql()) - set(entry.queries())


@pytest.mark.parametrize("name", sorted(CORE))
def test_oracle(spark, con, name):
    assert difference(entry.queries()[name](spark, FOLDER), con, CORE[name]) == ""


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
