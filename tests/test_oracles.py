"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf, con, name):
    problem = compare(spark, con, name, queries()[name], oracle_sql()[name], sf)
    # all conversations of the smallest table set are known
    assert problem is None or (name, problem) == ("unknown_conversations", "no rows")


def test_entry(spark):
    assert entry(spark).count() == 11
