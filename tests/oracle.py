"""Holds a query's rows against those of the SQL that DuckDB runs on the same files."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in (value.asDict().values() if hasattr(value, "asDict") else value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows(names: list[str], found) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in found)


def assert_same(df, sql: str, folder: str = FOLDER) -> None:
    answer = connection(folder).execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    expected = rows(names, answer.fetchall())
    got = rows(df.columns, df.collect())
    assert got == expected, f"only in Spark: {list((got - expected).items())[:3]}; only in SQL: {list((expected - got).items())[:3]}"
