"""Every named query runs at the smallest scale and agrees with its SQL."""

import re

import pytest

import __spark_entry__ as e
from lumbre.queries.registry import OPERATORS
from tests.oracle import compare, connect

BASE = "/root/testdata/sf0.001"
NAMES = sorted(e.queries())


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = e.queries()[name](spark, BASE)
    sql = e.oracle_sql().get(name)
    if sql:
        assert compare(con, df, sql) == ""
    else:
        df.collect()


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_every_query_names_its_operators():
    assert all(re.match(r"^[A-Z0-9. ]+", ops) for ops in OPERATORS.values())
