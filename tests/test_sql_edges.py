"""Queries beside their SQL on inputs at the edges of rounding."""

import duckdb

from skyloom.plans import graphs


def test_mean_that_rounds_to_minus_zero(spark, tmp_path):
    path = f"{tmp_path}/embeddings.parquet"
    duckdb.sql(f"COPY (SELECT i AS vec_id, [CASE WHEN j % 3 = 0 THEN -2e-6 WHEN j % 3 = 1 THEN 2e-6 ELSE i END FOR j IN range(64)]::FLOAT[] AS embedding, 1 AS label FROM range(3) t(i)) TO '{path}' (FORMAT parquet)")
    made, sql = graphs.QUERIES["a18_aggregate_embeddings"]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM '{path}'")
    got, want = made(spark, str(tmp_path)).first()["embedding"], db.sql(sql).fetchall()[0][1]
    assert [str(x) for x in got] == [str(x) for x in want] and "-0.0" in map(str, got)
