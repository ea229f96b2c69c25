"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def value(v):
        if isinstance(v, (list, tuple)):
            return tuple(map(value, v))
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return v if v is None or (isinstance(v, int) and not isinstance(v, bool)) else str(v)

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = plain(got.select(cols).collect())
    b = plain(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    assert len(a) == len(b)
    assert repr(a) == repr(b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "chunk_pos", "rank", "semantic", "bm25", "fused_norm"]
