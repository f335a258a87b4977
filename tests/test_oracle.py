import pytest
from oracle import check

from quillon.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name])
