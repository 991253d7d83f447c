"""Every registered query runs; those with SQL return the rows that DuckDB returns."""

from __future__ import annotations

import pytest
from oracle import FOLDER, assert_same

import __spark_entry__
from tarn.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLE_SQL:
        assert_same(df, ORACLE_SQL[name])
    else:
        df.collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
