"""Plans of large tables: what must not gather the rows of a group, or sketch a column more often than once."""

import threading

import numpy as np
from pyspark.sql import functions as F

from skyloom.operators import learning as M
from skyloom.operators import quantiles as Q
from skyloom.operators import sampling as S
from skyloom.operators import scaling as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_move_no_row_to_its_source_or_cell(spark, monkeypatch):
    df = spark.range(60).select("id", (F.col("id") % 2).cast("string").alias("catalog_source"), *[(F.col("id") * i % 7).cast("double").alias(c) for i, c in enumerate(("redshift", "ra", "dec", "mag_g", "mag_r", "X", "Y", "Z"), 2)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = X.engineer_features(df, ["mag_g", "mag_r"])
        assert "SortMergeJoin" not in plan(out) and "ShuffledHashJoin" not in plan(out)
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 60
    for r in rows:
        assert r["ra_src_count"] == 30 and r["local_density_grid_approx"] == sum(q["grid_cell_id"] == r["grid_cell_id"] for q in rows)


def test_a_column_is_sketched_once_for_all_its_quantiles(spark, monkeypatch):
    calls, sketch = [], F.percentile_approx
    monkeypatch.setattr(Q, "DIRECT", 10)
    monkeypatch.setattr(F, "percentile_approx", lambda *a: calls.append(a) or sketch(*a))
    values = np.random.default_rng(2).normal(size=500).round(2)
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    row = Q.quantiles(df, ["x"], (0.0, 0.005, 0.5, 0.995, 1.0)).first()
    assert np.allclose(row["q__x"], np.quantile(values, (0.0, 0.005, 0.5, 0.995, 1.0)), atol=1e-12) and len(calls) == 1


def test_runs_of_k_means_go_on_together(spark, monkeypatch):
    met, fit = threading.Barrier(2, timeout=60), M.KMeans.fit
    monkeypatch.setattr(M.KMeans, "fit", lambda self, data: met.wait() >= 0 and fit(self, data))  # no run begins alone
    df = spark.createDataFrame([(float(x + 10 * c), c) for c in range(3) for x in (0.0, 0.1, 0.2)], "x double, c int")
    assert all(r["cluster"] == r["c"] for r in M.kmeans(df, ["x"], 3, runs=2).collect())


def test_pairs_of_two_domains_build_no_array_and_shuffle_nothing(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=(40, 3)) + 1
    a, b = (spark.createDataFrame([(i + at, *map(float, r)) for i, r in enumerate(m)], "id long, f0 double, f1 double, f2 double") for m, at in ((x, 0), (y, 100)))
    a = a.withColumn("f1", F.when(F.col("id") != 3, F.col("f1")))  # imputed by the mean of both
    out = M.cross_domain_distances(a, b, ["f0", "f1", "f2"], "id")
    said = plan(out)
    assert "lambda" not in said and "hashpartitioning" not in said and "rangepartitioning" not in said
    x[3, 1] = np.r_[np.delete(x[:, 1], 3), y[:, 1]].mean()
    both = np.r_[x, y]
    x, y = ((m - both.mean(0)) / both.std(0) for m in (x, y))
    got = {(r["id_a"], r["id_b"]): r["d"] for r in out.collect()}
    assert len(got) == 1200
    assert all(abs(got[i, j + 100] - np.sqrt(((x[i] - y[j]) ** 2).sum())) < 1e-9 for i in range(30) for j in range(40))


def test_models_of_a_split_are_fitted_by_all_cores(spark, monkeypatch):
    met, train = [], M.train
    monkeypatch.setattr(M, "train", lambda df, *a: met.append(df) or train(df, *a))
    df = spark.range(4000).coalesce(1).select("id", (F.col("id") % 10 == 0).cast("double").alias("label"), *[F.rand(i).alias(f"f{i}") for i in (1, 2)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(S.exact_split(df, "label", "id"))
        _, scores = M.train_and_evaluate(df, "id", "label", ["f1", "f2"], kinds=["logistic_regression"])
        sizes = [r["count"] for r in met[0].groupBy(F.spark_partition_id()).count().collect()]
        assert scores.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(sizes) == 3200 and len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 1.5 * 3200 / len(sizes)
