"""Every registered query runs at the smallest size; the driver compares them at sf0.01."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, oracle_rows


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["hour", "swap_count", "total_amount0", "total_amount1"]
    assert df.count() == 50


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 77


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sf, name):
    result = compare(spark, sf, name)
    assert result == "", result


def test_oracle_tool(sf):
    assert oracle_rows(sf, "SELECT count(*) AS n FROM region")[2] == [(5,)]
