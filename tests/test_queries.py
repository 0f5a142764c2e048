import pytest

from reedbed.plans import registry, reports, studies
from tests.oracle import difference

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries() | reports.queries() | studies.queries()
SQL = registry.oracle_sql() | reports.oracle_sql() | studies.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert not difference(spark, QUERIES[name], SQL[name], SF)
