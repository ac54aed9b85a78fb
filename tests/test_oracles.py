"""Every core query that SQL can express gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from threadloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    found = catalog.QUERIES[name](spark, SF)
    ours = rows_of(found.columns, found.collect())
    if name not in catalog.ORACLES:
        assert ours
        return
    said = sql.execute(catalog.ORACLES[name])
    columns = [d[0] for d in said.description]
    assert sorted(columns) == sorted(found.columns)
    assert ours == rows_of(columns, said.fetchall())
