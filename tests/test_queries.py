"""Every registered query against its SQL on the smallest tables."""

import pytest

from foliolens.plans import compare, load_all

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = load_all()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, detail = compare.compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert ok, detail
