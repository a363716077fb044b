"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import re

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL
from .oracle_check import compare, duck

# The corpus queries have tests of their own beside their subpackage.
QUERIES = {k: q for k, q in E.queries().items() if not re.match(r"op\d+_|pipeline$", k)}
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    msg, ok = compare(spark, con, key, QUERIES[key], ORACLE.get(key), SF_SMALL)
    assert ok, msg


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLE)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "revenue_p50" in df.columns
