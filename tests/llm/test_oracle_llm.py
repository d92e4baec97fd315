"""Queries with a SQL form against DuckDB."""

import duckdb
import pytest

from evidentia.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(name, size, spark, sf):
    d = sf.rpartition("/")[0] + f"/{size}"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{d}/documents.parquet')")
    con.execute(f"create view embeddings as select * from read_parquet('{d}/embeddings.parquet')")
    cur = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    df = QUERIES[name](spark, d)
    assert sorted(columns) == sorted(df.columns)
    norm = lambda r: tuple(round(x, 3) if isinstance(x, float) else x for x in r)
    got, want = sorted(map(norm, df.select(*columns).collect())), sorted(map(norm, cur.fetchall()))
    bad = next(((a, b) for a, b in zip(got, want, strict=True) if a != b), None)
    assert bad is None
