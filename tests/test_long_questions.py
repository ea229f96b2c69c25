"""Queries whose SQL takes whole questions, on questions of more terms than the others take."""

import duckdb
import pytest

import __spark_entry__
from test_entry import plain


@pytest.mark.parametrize("name", ["bm25_pruned", "session_topk"])
def test_terms_at_the_end_count(spark, tmp_path, name):
    docs = [(k, f"word{k % 7} tail{k} common", f"src{k % 2}") for k in range(40)]
    asked = [(1, "word3 " * 150 + "tail11 " * 300), (2, "absent " * 128 + "tail20 tail21"), (3, "common word1"), (4, None)]
    vectors = [(1, [1.0, 0.0])]
    con = duckdb.connect()
    for table, rows, kinds in (("documents", docs, "doc_id long, text string, source string"), ("benchmark", asked, "item_id long, text string"), ("embeddings", vectors, "vec_id long, embedding array<float>")):
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(got.columns)
    a = plain(got.select(cols).collect())
    assert a == plain(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    at, of = cols.index("chunk_pos"), cols.index("query_id")
    assert {(1, 11), (2, 20), (2, 21)} <= {(r[of], r[at]) for r in a}
