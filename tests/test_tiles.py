"""Blocks of points that meet in tiles, and large groups on few axes."""

import numpy as np
import pytest

from skyloom.operators import metric
from skyloom.operators import neighbors as N


def brute(x, ids, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return {(int(ids[i]), r + 1): (int(ids[j]), round(float(d[i, j]), 9)) for i in range(len(x)) for r, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], ids[j]))[:k])}


@pytest.mark.parametrize("tasks", [1, 1000])
def test_tiles_of_a_sphere_equal_brute_force(spark, monkeypatch, tasks):
    """No block can be left out, so all meet, in strips of several blocks and in tiles of several or of one."""
    monkeypatch.setattr(metric, "TASKS", tasks)
    monkeypatch.setattr(metric, "TILE", 100)
    monkeypatch.setattr(metric, "STRIP", 64)
    x = np.random.default_rng(5).normal(size=(260, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[200:220] = x[:20]  # copies
    axes = [f"c{i}" for i in range(16)]
    df = spark.createDataFrame([("g", int(i) * 3, *map(float, v)) for i, v in enumerate(x)], "graph_id string, node_id long, " + ", ".join(f"{a} double" for a in axes))
    got = {(r["src"], r["rank"]): (r["dst"], round(r["d"], 9)) for r in metric.metric_knn(df, 3, axes, block=24).collect()}
    assert got == brute(x, np.arange(260) * 3, 3)


def test_a_large_group_on_three_axes_goes_by_blocks(spark, monkeypatch):
    """Dense in the middle, where the cells of a grid would hold too many; a small group beside it."""
    seen, whole = [], N.metric_knn
    monkeypatch.setattr(N, "metric_knn", lambda points, *a: (seen.append(points.count()), whole(points, *a))[1])
    x = np.random.default_rng(6).normal(size=(150, 3)) ** 3
    df = spark.createDataFrame([("g" if i < 130 else "h", i, *map(float, v)) for i, v in enumerate(x)], "graph_id string, node_id long, x double, y double, z double")
    got = {(r["src"], r["rank"]): (r["dst"], round(r["d"], 9)) for r in N.knn(df, 4, small=100).collect()}
    assert got == brute(x[:130], np.arange(130), 4) | brute(x[130:], np.arange(130, 150), 4) and seen == [130]
