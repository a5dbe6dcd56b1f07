"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import pytest
from oracle import compare, duck

from quaverlake.plans import all_queries, all_sql

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_equals_sql(spark, con, name):
    assert compare(all_queries()[name](spark, SF_DIR), con, all_sql()[name]) is None


def test_every_twin_has_a_query():
    assert set(all_sql()) <= set(all_queries())
