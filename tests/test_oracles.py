"""Every query with an oracle, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tools.check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    assert compare(spark, duck, FOLDER, name) in (None, "both empty")


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
