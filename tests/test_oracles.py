"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from cellweave import ml_queries

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ml_queries.ORACLES))
def test_query(spark, duck, name):
    df = ml_queries.QUERIES[name](spark, D)
    want = duck.sql(ml_queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(df.columns)]
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got == Counter(tuple(plain(r[k]) for k in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
