"""Every registered query against its SQL counterpart, exactly."""

import pytest
from compare import difference, sql_connection

from tallyspark.plans.oracle import ORACLE
from tallyspark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def connection(folder):
    return sql_connection(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, connection):
    got = QUERIES[name](spark, folder).toPandas()
    assert len(got)
    if name in ORACLE:
        assert difference(got, connection.execute(ORACLE[name]).df()) is None


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
