"""Registered queries: equal to their SQL, and all there."""

from __future__ import annotations

import pytest

import __spark_entry__
from stellwerk.llm import catalog
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator_and_the_pipeline():
    assert [n.split("_")[0] for n in catalog.QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert {*catalog.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    numbers = {int(n.split("_")[0][2:]) for n in catalog.SQL}
    assert numbers == {1, 4, 8, 10, 11, 12, 13}


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert compare(got, duck(SF).execute(catalog.SQL[name]).df()) is None
