import pytest

from tessera.queries import ORACLES, QUERIES
from tests.compare import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    names, got = spark_rows(QUERIES[name](spark, SF))
    want_names, want = sql_rows(con, ORACLES[name])
    assert names == want_names
    assert got == want
