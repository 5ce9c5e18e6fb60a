"""Density clusters without a row for each pair of a dense place."""

import numpy as np
import pytest

from skyloom.operators import learning as M
from skyloom.operators import metric


def by_hand(x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None], label[None], len(x)).min(1), len(x))
        if (new == label).all():
            break
        label = new
    every = np.where(core, label, np.where(near & core[None], label[None], len(x)).min(1))
    number = {c: i for i, c in enumerate(sorted(set(label[core].tolist())))}
    return {i: number.get(int(c), -1) for i, c in enumerate(every)}


@pytest.mark.parametrize("axes", [2, 6])
def test_clusters_equal_all_pairs(spark, axes, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(150, axes)) * 0.1, rng.normal(size=(60, axes)) * 0.1 + 2, rng.uniform(-1, 3, size=(60, axes))])
    x[140:150] = x[:10]
    names = [f"f{i}" for i in range(axes)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names))
    for f in ("radius_counts", "radius_forest"):  # several blocks
        monkeypatch.setattr(M, f, lambda *a, made=getattr(metric, f): made(*a, block=30))
    got = {r["id"]: r["cluster"] for r in M.dbscan(df, names, "id", 0.3, 5).collect()}
    assert got == by_hand(x, 0.3, 5) and -1 in got.values()


def test_dense_places_are_no_pairs(spark):
    rows = [("p", i, i * 1e-6, 0.0) for i in range(400)]
    points = spark.createDataFrame(rows, "graph_id string, node_id long, a double, b double")
    near = metric.radius_counts(points, ["a", "b"], 1.0, 4, block=100).collect()
    assert all(r["dst"] is None for r in near) and sum(r["d"] for r in near) == 400 * 399
    assert metric.radius_forest(points, ["a", "b"], 1.0, block=100).count() < 400 * 20
