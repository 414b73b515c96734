"""Registered training-data queries against their SQL."""

import pytest

from skein.llm import queries
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert oracle.differences(spark, oracle.connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


def test_queries_are_named_by_number():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
