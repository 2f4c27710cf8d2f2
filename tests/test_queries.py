"""Every chat query against its SQL in DuckDB."""

import os

import pytest

from chatvitals import queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, db, name):
    df = queries.queries()[name](spark, sf)
    found = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.collect(), df.columns) == _rows(found.fetchall(), names)


def test_report_blocks(spark, sf):
    kinds = {r["kind"] for r in queries.queries()["report_blocks"](spark, sf).select("kind").distinct().collect()}
    assert {"overview", "row", "header", "cards", "issue"} <= kinds


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())
