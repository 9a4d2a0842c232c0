import pytest

from knotwork.plans import queries
from tests.oracle import mismatch


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert mismatch(spark, name, queries.QUERIES[name], queries.SQL[name], "/root/testdata/sf0.001") == ""
