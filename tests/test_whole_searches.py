"""Path features and distances of all nodes: no sample of the sources, however large a graph is."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import distances as D
from skyloom.operators import frontier, sparse
from skyloom.operators import paths as P
from skyloom.plans import graphs as plans


def tables(spark, *graphs):
    nodes, edges = ([r for g in graphs for r in g[i]] for i in (0, 1))
    return spark.createDataFrame(nodes, "graph_id string, node_id long"), spark.createDataFrame(edges, "graph_id string, src long, dst long, weight double")


def star(g, n):
    """Of its ordered pairs of nodes 2 / n are one hop apart, the others two."""
    return [(g, i) for i in range(n)], [(g, 0, i, 1.0) for i in range(1, n)]


def test_hops_of_a_distance_are_those_of_all_nodes(spark):
    two = tables(spark, star("a", 1100), star("b", 30))
    d = D.path_length_distance(*two, D.all_pairs(two[0].select(F.col("graph_id").alias("id")))).collect()
    assert d[0]["d"] == pytest.approx(2 / 30 - 2 / 1100, rel=1e-9)


def test_joins_search_from_all_nodes_some_at_a_time(spark, monkeypatch):
    seen, levels = [], frontier.levels
    monkeypatch.setattr(frontier, "SOURCES", 10)
    monkeypatch.setattr(frontier, "levels", lambda links, sources: seen.append(sources.count()) or levels(links, sources))
    monkeypatch.setattr(P, "WHOLE", 10)
    monkeypatch.setattr(sparse, "HELD", 20)
    got = {r["value"]: r["n"] for r in P.hop_lengths(*tables(spark, star("s", 30))).collect()}
    assert got == {1.0: 58, 2.0: 29 * 28} and len(seen) == 3 and sum(seen) == 30


def line(g, n, weights):
    return [(g, i) for i in range(n)], [(g, i, i + 1, float(w)) for i, w in enumerate(weights[: n - 1])]


@pytest.mark.parametrize("hub", [64, 2])
def test_lengths_of_sources_near_each_other_equal_the_matrix(hub, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(sparse, "HUB", hub)
    monkeypatch.setattr(sparse, "WIDE", 12)
    n, m = 300, 520
    src, dst, w = rng.integers(0, 250, m), rng.integers(0, 250, m), rng.integers(0, 9, m) / 7.0
    src[:20], dst[:20] = 250, np.arange(251, 271)  # a star of its own; nodes from 271 on have no edge
    src[20:100] = 3
    want = P.length_matrix(n, src, dst, w, np.arange(n))
    got, seen = np.full((n, n), np.inf), np.zeros(n, int)
    for part in range(3):
        for some, nodes, far in sparse.near_lengths(n, sparse.neighbours(n, src, dst, w), np.arange(n), part, 3):
            got[np.ix_(some, nodes)] = far.T
            seen[some] += 1
    assert (seen == 1).all() and np.array_equal(got, want)


@pytest.mark.parametrize("by", ["task", "parts", "joins"])
def test_weighted_means_are_of_all_nodes(spark, by, monkeypatch):
    n, weights = (24 if by == "joins" else 300), np.random.default_rng(3).integers(1, 9, 300)
    at = np.concatenate([[0], np.cumsum(weights[: n - 1])])
    monkeypatch.setattr(frontier, "SOURCES", 12)
    if by != "task":
        monkeypatch.setattr(P, "WHOLE", 20)
    if by == "joins":
        monkeypatch.setattr(sparse, "HELD", 20)
    got = P.weighted_path_mean(*tables(spark, line("a", n, weights))).collect()
    assert got[0]["weighted_path_mean"] == pytest.approx(np.abs(at[:, None] - at).sum() / (n * (n - 1)), rel=1e-12)


def test_feature_table_takes_lengths_from_all_nodes(spark, tmp_path):
    """A graph of 250 vectors; 200 of its nodes were sources once."""
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.random.default_rng(5).normal(size=(250, 3)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = plans.QUERIES["e04_feature_table"][0](spark, str(tmp_path)).collect()
    e = plans.graph(spark, str(tmp_path))[1].toPandas()
    far = P.length_matrix(250, e["src"].to_numpy(), e["dst"].to_numpy(), e["weight"].to_numpy(), np.arange(250))
    assert len(got) == 1 and got[0]["weighted_path_mean"] == pytest.approx(far[np.isfinite(far) & (far > 0)].mean(), rel=1e-12)


def test_combined_distance_is_of_all_nodes(spark):
    """Two stars: degrees are 1 but for the middle, no triangles, and 2 / n of the pairs are one hop apart."""
    two = tables(spark, star("a", 1100), star("b", 30))
    d = D.combined_distance(*two, D.all_pairs(two[0].select(F.col("graph_id").alias("id")))).collect()
    degree = 28 * (1 / 30 - 1 / 1100) + 1070 / 1100
    assert d[0]["d"] == pytest.approx((degree + 2 / 30 - 2 / 1100) / 3, rel=1e-9)
