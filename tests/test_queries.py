import pytest
from compare import assert_same, oracle

from tallyspark.plans import oracles, queries

SQL = oracles.oracle_sql()


def test_every_query_has_sql():
    assert set(SQL) == set(queries.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir).toPandas(), oracle(sf_dir, SQL[name]))
