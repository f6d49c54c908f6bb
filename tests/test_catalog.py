"""Every registered query equals its SQL on the smallest tables."""

import pytest

from stellwerk.catalog import build
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
CATALOG = build()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(CATALOG.sql) == set(CATALOG.queries)


@pytest.mark.parametrize("name", list(CATALOG.queries))
def test_query_equals_sql(spark, con, name):
    got = CATALOG.queries[name](spark, SF).toPandas()
    assert compare(got, con.execute(CATALOG.sql[name]).df()) is None
