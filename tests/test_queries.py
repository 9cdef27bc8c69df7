"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries

from check import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SMOKE_DIR, name, queries()[name], oracle_sql().get(name))
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
