"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import pytest

from skein.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert oracle.differences(spark, con, SF, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)
