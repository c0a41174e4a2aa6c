"""Every registered query against its SQL on the smallest tables."""

import pytest
from __spark_entry__ import entry

from check import compare, connect
from diffmill.plans.oracle import all_oracles
from diffmill.plans.queries import all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) is None


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["id", "body"]
    assert rows.count() > 0
