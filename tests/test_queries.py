"""Every core query against its SQL, and every query without SQL for a stable schema."""

import os

import pytest

from sumire.plans.catalogue import QUERIES, SQL
from tests.oracle import FOLDER, compare, connection

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert all(len(r) == len(df.columns) for r in df.collect())


def test_entry_point_lists_all():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
