"""Every registered query against its check statement."""

from __future__ import annotations

import pytest
from compare import assert_same

import __spark_entry__ as contract

QUERIES = contract.queries()
STATEMENTS = contract.oracle_sql()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in STATEMENTS])
def test_query_matches_statement(spark, duck, data, name):
    assert_same(QUERIES[name](spark, data), duck, STATEMENTS[name])


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).columns
