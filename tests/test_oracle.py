"""Every query with SQL gives the rows that DuckDB gives."""

import os
from collections import Counter

import duckdb
import pytest

from palisade.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("PALISADE_SF", "/root/testdata/sf0.001")
TABLES = ("documents", "pages", "conversations", "labels", "benchmark")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    expected = rows(want.columns, want.fetchall())
    assert sum(expected.values()) > 0 or name in {"regex_rule", "blocklist"}
    assert got == expected
