import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import distances as D
from skyloom.operators import embeddings as E
from skyloom.operators import graphs as G
from skyloom.operators import learning as M
from skyloom.operators import neighbors as N
from skyloom.operators import paths as P
from skyloom.operators import spectral as Q
from skyloom.operators import topology as T


def edge_table(spark, graph, pairs, weight=1.0):
    return spark.createDataFrame([(graph, a, b, weight) for a, b in pairs], "graph_id string, src long, dst long, weight double")


def node_table(spark, graph, n):
    return G.nodes_0_to(spark, n, graph)


def test_ring_spectrum_is_cosines(spark):
    n = 12
    found = Q.spectrum(node_table(spark, "ring", n), G.ring(spark, n), None, "adjacency").first()["eig"]
    assert np.allclose(sorted(found), sorted(2 * math.cos(2 * math.pi * k / n) for k in range(n)))


def test_complete_graph_spectrum(spark):
    n = 6
    edges = edge_table(spark, "k", [(a, b) for a in range(n) for b in range(a + 1, n)])
    found = Q.spectrum(node_table(spark, "k", n), edges, None).first()["eig"]
    assert np.allclose(found, [0.0] + [n / (n - 1)] * (n - 1))


def test_isolated_nodes_stay(spark):
    f = T.degree_features(node_table(spark, "g", 5), edge_table(spark, "g", [(0, 1), (1, 2)])).first()
    assert (f["n_nodes"], f["n_edges"], f["degree_min"], f["degree_max"]) == (5, 2, 0, 2)


def test_triangles_by_hand(spark):
    edges = edge_table(spark, "g", [(0, 1), (0, 2), (1, 2), (2, 3)])
    assert [tuple(r)[1:] for r in T.triangles(edges).collect()] == [(0, 1, 2)]
    c = {r["node_id"]: r["clustering"] for r in T.local_clustering(node_table(spark, "g", 4), edges).collect()}
    assert c[0] == 1.0 and c[2] == pytest.approx(1 / 3) and c[3] == 0.0


def test_components_and_paths(spark):
    nodes, edges = node_table(spark, "g", 7), edge_table(spark, "g", [(0, 1), (1, 2), (2, 3), (5, 6)])
    labels = {r["node_id"]: r["component"] for r in G.connected_components(nodes, edges).collect()}
    assert labels == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5}
    p = P.path_features(nodes, edges).first()
    assert p["diameter"] == 3 and p["path_mean"] == pytest.approx(20 / 12)
    assert T.component_features(nodes, edges).first()["n_components"] == 3


def test_betweenness_of_a_path(spark):
    nodes, edges = node_table(spark, "g", 3), edge_table(spark, "g", [(0, 1), (1, 2)])
    b = {r["node_id"]: r["betweenness"] for r in P.betweenness(nodes, edges).collect()}
    assert b == {0: 0.0, 1: 1.0, 2: 0.0}


def test_weighted_lengths(spark):
    edges = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 1.0), ("g", 0, 2, 5.0)], "graph_id string, src long, dst long, weight double")
    m = P.distance_matrices(node_table(spark, "g", 3), edges).first()["matrix"]
    assert m[0] == [0.0, 1.0, 2.0]


@pytest.mark.parametrize("small", [5, 10000])
def test_knn_equals_brute_force(spark, small):
    rng = np.random.default_rng(1)
    xyz = np.concatenate([rng.random((150, 3)), rng.random((100, 3)) * 0.01, np.zeros((5, 3))])
    pts = spark.createDataFrame([("g", i, *map(float, p)) for i, p in enumerate(xyz)], "graph_id string, node_id long, x double, y double, z double")
    got = {(r["src"], r["rank"]): r["dst"] for r in N.knn(pts, 6, small=small).collect()}
    for i in range(len(xyz)):
        d = np.sqrt(((xyz - xyz[i]) ** 2).sum(axis=1))
        order = [j for j in sorted(range(len(xyz)), key=lambda j: (d[j], j)) if j != i][:6]
        found = [got[i, r] for r in range(1, 7)]
        assert np.allclose(d[found], d[order])


def test_wasserstein_of_a_shift(spark):
    v = spark.createDataFrame([("a", float(x)) for x in range(5)] + [("b", x + 2.5) for x in range(5)], "id string, value double")
    pairs = D.all_pairs(v)
    assert D.wasserstein(v, pairs).first()["d"] == pytest.approx(2.5)
    assert D.kolmogorov_smirnov(v, pairs).first()["d"] == pytest.approx(0.6)


def test_gromov_wasserstein_of_a_graph_with_itself(spark):
    nodes = node_table(spark, "a", 6).union(node_table(spark, "b", 6)).union(node_table(spark, "c", 6))
    ring = [(i, (i + 1) % 6) for i in range(6)]
    moved = [((i + 2) % 6, (i + 3) % 6) for i in range(6)]
    edges = edge_table(spark, "a", ring).union(edge_table(spark, "b", moved)).union(edge_table(spark, "c", [(0, i) for i in range(1, 6)]))
    edges = G.canonical_edges(edges)
    d = {(r["id_a"], r["id_b"]): r["d"] for r in D.gromov_wasserstein(P.distance_matrices(nodes, edges), D.all_pairs(nodes.select(F.col("graph_id").alias("id")))).collect()}
    assert d["a", "b"] < 0.05 < d["a", "c"]


def test_random_walks_follow_edges(spark):
    edges = G.ring(spark, 6)
    walks = E.random_walks(node_table(spark, "ring", 6), edges, walks=2, length=5).collect()
    assert len(walks) == 12 and all(abs(a - b) in (1, 5) for r in walks for a, b in zip(r["walk"], r["walk"][1:]))


def test_regular_graph_has_equal_degrees(spark):
    edges = G.random_members(spark, "regular", 20, 2, 0.0, 4)
    deg = G.both_ways(edges).groupBy("graph_id", "node_id").count()
    assert deg.filter("count <> 4").count() == 0 and deg.count() == 40


def test_rewiring_keeps_the_number_of_edges(spark):
    edges = G.random_members(spark, "torus", 25, 2, 0.5)
    assert {r["count"] for r in edges.groupBy("graph_id").count().collect()} == {50}


def test_metrics_and_clusters(spark):
    rows = [(i, float(i % 2), float(i % 2) * 5 + (i % 7) * 0.01) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label double, f double")
    out = {r["id"]: r["cluster"] for r in M.dbscan(df, ["f"], "id", 0.1, 3).collect()}
    assert set(out.values()) == {0, 1} and all(out[i] == i % 2 for i in out)
    m = M.clustering_metrics(df.withColumn("cluster", F.col("label").cast("int")), ["f"], "id").first()
    assert m["silhouette"] > 0.95
    k = {r["id"]: r["cluster"] for r in M.kmeans(df, ["f"], 2, runs=1).collect()}
    assert all(k[i] == i % 2 for i in k)
    assert M.roc_auc(df, "label", "f").first()[0] == 1.0


def test_logistic_and_ridge_match_closed_forms(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = x @ [1.0, -2.0] + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, label double")
    n, std = df.agg(F.count("id"), F.stddev_samp("label")).first()
    model = M.train(df, ["a", "b"], {"r": M.ridge(n, std)})["r"].stages[-1]
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-5)
