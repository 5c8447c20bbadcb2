"""Every registered query with a DuckDB twin must agree with it (row count,
column names, order-insensitive values rounded to 6 decimals). Runs on sf0.001
to stay quick; the driver repeats the check at sf0.01."""

from __future__ import annotations

import os

import duckdb
import pytest

from tests.conftest import SMALL
from tools.compare import TABLES, digest

from __spark_entry__ import oracle_sql, queries  # noqa: E402

ORACLE = oracle_sql()
QUERIES = queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_is_registered_with_a_name_from_the_inventory():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 80


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    rel = con.execute(ORACLE[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(ocols)
    orows = [tuple(r[ocols.index(c)] for c in cols) for r in rel.fetchall()]
    assert len(srows) == len(orows)
    assert digest(cols, srows)[0] == digest(cols, orows)[0]
