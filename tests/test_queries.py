"""Every registered query against its SQL, on the smallest test tables."""

import os

import pytest
from compare import difference, duck

import __spark_entry__ as entry

NAMES = sorted(entry.queries())
pytestmark = pytest.mark.skipif(
    not os.path.exists(entry.ENTRY_TABLES), reason="test tables are not there"
)


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, folder, name):
    df = entry.queries()[name](spark, folder)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(NAMES)
