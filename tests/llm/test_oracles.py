"""Queries of this package against their SQL on DuckDB."""

import duckdb
import pytest

from chatvitals.llm.queries import ORACLE_SQL, QUERIES


def _rows(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    names = sorted(c[0] for c in result.description)
    want = _rows(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall())
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == names
    assert _rows(tuple(r) for r in df.select(*names).collect()) == want
