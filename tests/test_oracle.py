"""Every registered query against its SQL."""

import pytest
from oracle import connect, difference

from leadloom.plans import oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: The smallest tables hold no accepted company that is a parent.
LARGER = {"parent_company", "director_overlap"}


@pytest.mark.parametrize("name", [n for n in queries() if n not in LARGER])
def test_same_rows(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name) is None


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(LARGER))
def test_same_rows_of_larger_tables(spark, name):
    larger = "/root/testdata/sf0.01"
    assert difference(spark, connect(larger), larger, name) is None
