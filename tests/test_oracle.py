"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from check import compare

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["analyser"] == "dq" and row["violation_count"] > 0


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, name):
    verdict = compare(spark, SMALL, name)
    assert not verdict.startswith("FAIL"), verdict
