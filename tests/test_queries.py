"""Every registered query with a SQL twin gives the same rows on DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SLOW = {"saved_model_hybrid_alerts"}


@pytest.fixture(scope="module")
def db():
    return check.connect(SF)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql() and n not in SLOW])
def test_same_rows(spark, db, name):
    assert check.compare(spark, db, SF, name).startswith("ok")


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
