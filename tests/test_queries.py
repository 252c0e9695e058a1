"""Every registered query with a SQL twin, side by side on the smallest data."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(name, spark, duck):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    twin = duck.sql(entry.oracle_sql()[name])
    assert cols == sorted(twin.columns)
    assert plain(df.select(*cols).collect()) == plain(twin.project(", ".join(f'"{c}"' for c in cols)).fetchall())
