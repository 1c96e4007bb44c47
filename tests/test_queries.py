"""Every registered trace query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lumenspan.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem", "part", "supplier", "events", "documents", "conversations", "labels", "benchmark"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    rows = QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(rows.columns)) for r in rows.collect()), key=repr)
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    at = [columns.index(c) for c in sorted(rows.columns)]
    assert sorted(columns) == sorted(rows.columns)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
