"""Spectra of graphs larger than a task: right, or an error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import distances as D
from skyloom.operators import krylov, sparse
from skyloom.operators import spectral as S


def tables(spark, graphs):
    """``graphs``: name, number of nodes and edges of each."""
    nodes = [(g, i) for g, n, _ in graphs for i in range(n)]
    edges = [(g, int(a), int(b), float(w)) for g, _, e in graphs for a, b, w in e]
    return spark.createDataFrame(nodes, "graph_id string, node_id long"), spark.createDataFrame(edges, "graph_id string, src long, dst long, weight double")


@pytest.fixture
def few_vectors(monkeypatch):
    lanczos = krylov.lanczos
    monkeypatch.setattr(krylov, "lanczos", lambda *a, **k: lanczos(*a, **{**k, "most": 24}))
    monkeypatch.setattr(krylov, "BLOCK", 32)
    monkeypatch.setattr(sparse, "HELD", 20)


#: A line of 24 nodes, 20 triangles, one linked to the next by an edge of no weight, and 10 nodes without edges.
MANY = [(i, i + 1, 1 + i % 3) for i in range(23)] + [(24 + 3 * t + a, 24 + 3 * t + b, 2) for t in range(20) for a, b in ((0, 1), (0, 2), (1, 2))] + [(26, 27, 0)]
RING = [(min(i, (i + 1) % 60), max(i, (i + 1) % 60), 1) for i in range(60)]


@pytest.mark.parametrize("kind, largest", [("normalized", False), ("adjacency", True)])
def test_an_eigenvalue_of_many_components_comes_as_often_as_it_should(spark, few_vectors, kind, largest):
    got = S.spectrum(*tables(spark, [("many", 94, MANY), ("few", 3, [(0, 1, 1.0)])]), 40, kind, True, largest).collect()
    src, dst, w = (np.array(x) for x in zip(*MANY))
    want = np.linalg.eigvalsh(S._matrix(94, src, dst, w.astype(float), kind))
    want = -np.sort(-np.abs(want)) if largest else want  # a magnitude may come with both signs
    eig = np.array({r["graph_id"]: r["eig"] for r in got}["many"])
    assert len(got) == 2 and np.allclose(np.abs(eig) if largest else eig, want[:40], atol=1e-9)


def test_what_does_not_settle_is_an_error(spark, few_vectors):
    with pytest.raises(ArithmeticError):
        S.spectral_features(S.spectrum(*tables(spark, [("ring", 60, RING)]), 30)).collect()


def test_no_distance_comes_of_what_has_not_settled(spark, few_vectors):
    nodes, edges = tables(spark, [("few", 3, [(0, 1, 1.0)]), ("ring", 60, RING)])
    with pytest.raises(ArithmeticError):
        D.spectral_distance(S.spectrum(nodes, edges, 16), D.all_pairs(nodes.select(F.col("graph_id").alias("id"))), 16).collect()
