"""Every query against its SQL in DuckDB over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test data here")


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, database, name):
    found = entry.queries()[name](spark, str(DATA))
    rows = [tuple(r) for r in found.collect()]
    told = database.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    assert sorted(found.columns) == sorted(columns)
    assert canonical(rows, found.columns) == canonical(told.fetchall(), columns)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
