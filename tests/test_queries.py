import pytest
from duebook.plans import registered as queries

from compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, con, name):
    got, want = compare(spark, con, queries.QUERIES[name], queries.SQL[name], SF)
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1]
