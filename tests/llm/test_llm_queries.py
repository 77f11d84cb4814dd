import os

import pytest

from sumire.llm.queries import QUERIES, SQL
from tests.oracle import FOLDER, compare, connection

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_are_distinct(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert rows and len({tuple(map(str, r)) for r in rows}) == len(rows)
