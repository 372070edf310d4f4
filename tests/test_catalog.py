"""Each query against its SQL in DuckDB, as sorted rows."""

import os

import duckdb
import pytest

from ledgerlake.catalog import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


#: Queries whose results no SQL gives; tests/test_models.py holds them.
WITHOUT_SQL = {"growth_models", "ridge_penalties", "explanation_stability"}


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    clean = lambda rows: sorted(repr(tuple(0.0 if isinstance(v, float) and v == 0 else v for v in r)) for r in rows)
    got = clean(tuple(r[c] for c in cols) for r in df.collect())
    want = clean(con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLES[name]})").fetchall())
    assert got == want and len(got)
