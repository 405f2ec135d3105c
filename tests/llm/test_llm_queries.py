"""Registered queries against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from mapmill.llm.oracles import ORACLE_SQL
from mapmill.llm.queries import QUERIES

TABLES = ["documents", "embeddings", "pages", "labels"]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    plain = lambda v: repr(round(v, 9)) if isinstance(v, float) and math.isfinite(v) else repr(v)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    rel = duck.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
