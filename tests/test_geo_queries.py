"""Every geo query against its DuckDB SQL."""

import pytest

from skylattice.plans import fence_queries, geo_queries, run_queries  # noqa: F401  (all register)
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
#: Queries that have no row at the smallest scale.
LARGER = {"fence_conflict_check": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(geo_queries.ORACLES))
def test_as_sql(spark, name):
    n, differs = compare(spark, geo_queries.QUERIES[name], geo_queries.ORACLES[name], LARGER.get(name, SF))
    assert not differs
    assert n > 0 or name in {"coverage_gaps"}


def test_every_query_has_sql():
    assert set(geo_queries.QUERIES) == set(geo_queries.ORACLES)
