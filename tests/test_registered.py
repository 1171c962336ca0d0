"""Every registered query against its SQL at the smallest scale."""

import pytest
from check import compare, connect

from __spark_entry__ import entry, oracle_sql
from lakeops.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_check():
    # The training-data operators have tests of their own.
    assert set(REGISTRY) == {name for name in oracle_sql() if name in REGISTRY}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    assert compare(spark, con, REGISTRY[name], SF) is None


def test_entry(spark):
    assert entry(spark).count() == 25
