"""Each query against its SQL in DuckDB, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from quillspark.plans import graph_queries, io_queries, paper_queries, record_queries, stream_queries, text_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = (graph_queries, text_queries, record_queries, paper_queries, io_queries, stream_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def test_names_are_told_apart():
    assert sum(len(m.QUERIES) for m in MODULES) == len(QUERIES) and ORACLES.keys() <= QUERIES.keys()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 7) + 0.0
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, db):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in cols) if name in ORACLES else tuple(map(str, r)) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
