"""Every query with a SQL form gives the same rows as DuckDB; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BARE = ("C4_block_anchors",)  # the pages have no named anchors
ONLY = os.environ.get("ORACLE_ONLY")
NAMES = [n for n in entry.registry.QUERIES if not ONLY or n.startswith(tuple(ONLY.split(",")))]


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'; set threads=4")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat(" ")
    try:
        return round(float(v), 5) + 0.0 if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([norm(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, duck):
    df = entry.registry.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    sql = entry.registry.ORACLE_SQL.get(name)
    if sql is None:
        assert got or name in BARE
        return
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows(columns, cur.fetchall())
    bad = next(((a, b) for a, b in zip(got, want, strict=False) if a != b), None)
    assert len(got) == len(want) and bad is None, f"{len(got)} rows, want {len(want)}; first difference {str(bad)[:600]}"
    assert got, "no rows"
