"""Every registered query against its check statement at the smallest scale."""

import pytest

import __spark_entry__ as contract
from tests.parity import connect, differences

FOLDER = "/root/testdata/sf0.001"
CHECKED = sorted(contract.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_check_statements_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, con, name):
    assert differences(contract.queries()[name](spark, FOLDER), con, contract.oracle_sql()[name]) == []
