"""Every engine query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tablewarden.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the synthetic tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def shape(rows):
    return sorted(tuple("" if v is None else f"{float(v):.6g}" if isinstance(v, bool | int | float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    got = QUERIES[name](spark, str(DATA))
    want = tables.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert shape(got.select(*names).collect()) == shape(want.fetchall())
