"""Every query that has an oracle must agree with it, and every other one must run."""
from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.harness import compare

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    if name in ORACLES:
        assert compare(df, ORACLES[name], SF) is None
    else:
        assert df.count() >= 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
