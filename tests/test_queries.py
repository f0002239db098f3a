"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import check
from conftest import SMALL

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck_small, name):
    ok, note = check(spark, SMALL, name, entry.queries()[name], ORACLE.get(name), duck_small)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
