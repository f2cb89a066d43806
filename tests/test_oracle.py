"""Differential test: every registered query against its DuckDB SQL (sf0.001)."""

import importlib
import os
import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "scripts"))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from sparqa.sources.tables import DRIVER_TABLES
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


E = importlib.import_module("__spark_entry__")


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    from oracle_check import digest

    df = E.queries()[name](spark, SF_SMALL)
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    want = digest([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0], "columns differ"
    assert got[1] == want[1], "row counts differ"
    assert got[2] == want[2], "values differ"
