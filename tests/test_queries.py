"""Every registered query runs on the smallest tables; those with SQL give what DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from lakewarden.plans import registry

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, FOLDER)
    rows = sorted((tuple(plain(r[c]) for c in sorted(found.columns)) for r in found.collect()), key=repr)
    if name in SQL:
        want = duck.sql(SQL[name])
        order = sorted(want.columns)
        assert order == sorted(found.columns)
        places = [want.columns.index(c) for c in order]
        assert rows == sorted((tuple(plain(r[k]) for k in places) for r in want.fetchall()), key=repr)
