"""Operators on graphs and groups larger than a task: blocks about pivots, Lanczos, frontiers and exact transport."""

import itertools

import numpy as np
import pytest

from skyloom.operators import distances as D
from skyloom.operators import embeddings as E
from skyloom.operators import frontier, krylov, metric
from skyloom.operators import neighbors as N
from skyloom.operators import paths as P
from skyloom.operators import spectral as S


def points_of(spark, x, groups=None):
    names = [f"a{j}" for j in range(x.shape[1])]
    rows = [(groups[i] if groups else "g", i, *map(float, v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "graph_id string, node_id long, " + ", ".join(f"{n} double" for n in names)), names


def clustered(n, axes, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(12, axes)) * 5)[rng.integers(0, 12, n)] + rng.normal(size=(n, axes)) * 0.3


def neighbours_by_hand(x, k, name, groups):
    d = metric.distances(x, x, name)
    out = {}
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i and groups[j] == groups[i]), key=lambda j: (d[i, j], j))
        out |= {(i, r + 1): (j, round(d[i, j], 9)) for r, j in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("name", ["euclidean", "manhattan", "chebyshev", 3.0])
def test_neighbours_about_pivots_equal_brute_force(spark, name):
    x = clustered(500, 9)
    x[400:] = x[:100]  # copies: ties at no distance
    groups = [("a", "b", None)[i % 3] if i < 440 else "few" for i in range(500)]
    df, axes = points_of(spark, x, groups)
    got = {(r["src"], r["rank"]): (r["dst"], round(r["d"], 9)) for r in metric.metric_knn(df, 4, axes, name, block=32).collect()}
    assert got == neighbours_by_hand(x, 4, name, groups)


def test_points_without_a_coordinate_take_no_part(spark):
    df, axes = points_of(spark, np.array([[0.0] * 5, [1.0] * 5, [float("nan")] * 5, [3.0] * 5]))
    df = df.union(spark.createDataFrame([("g", 9, *[None] * 5)], df.schema))
    assert {(r["src"], r["dst"]) for r in N.knn(df, 1, axes).collect()} == {(0, 1), (1, 0), (3, 1)}
    assert N.knn(df.limit(0), 1, axes).count() == 0 and N.radius_pairs(df.limit(0), axes, 1.0).count() == 0


def test_far_blocks_never_meet(spark):
    x = clustered(900, 64)
    df, axes = points_of(spark, x)
    assert metric.pairs_measured(df, 4, axes, block=32) < 900 * 899 / 3
    got = {(r["src"], r["rank"]): (r["dst"], round(r["d"], 9)) for r in metric.metric_knn(df, 4, axes, block=32).collect()}
    assert got == neighbours_by_hand(x, 4, "euclidean", ["g"] * 900)


def test_no_block_is_large(spark):
    x = np.vstack([np.zeros((300, 5)), np.ones((200, 5)), clustered(300, 5)])
    df, axes = points_of(spark, x)
    base = df.selectExpr("graph_id", "node_id as src", f"array({', '.join(axes)}) as v")
    sent = spark.sparkContext.broadcast(metric._pivots(base, "graph_id", 40))
    sizes = metric._placed(base, "graph_id", sent, "euclidean", 40).groupBy("blk").count().collect()
    assert max(r["count"] for r in sizes) <= 80 and sum(r["count"] for r in sizes) == 800


@pytest.mark.parametrize("radius", [0.0, 1.2, 9.0])
def test_pairs_within_a_radius_on_many_axes(spark, radius, monkeypatch):
    x = clustered(300, 6)
    x[250:] = x[:50]
    df, axes = points_of(spark, x)
    monkeypatch.setattr(metric, "BLOCK", 16)
    d = metric.distances(x, x, "euclidean")
    got = [(r["src"], r["dst"]) for r in metric.metric_radius_pairs(df, axes, radius, block=16).collect()]
    assert len(set(got)) == len(got) and set(got) == {(i, j) for i in range(300) for j in range(i + 1, 300) if d[i, j] <= radius}


# spectra and paths


@pytest.fixture(scope="module")
def graph(spark):
    """A long graph, one of two parts, one without edges; parallel edges, loops and equal weights."""
    rng = np.random.default_rng(4)
    nodes, edges = [("bare", 0), ("bare", 1)], []
    for g, n in (("long", 70), ("parts", 30), ("tiny", 4)):
        nodes += [(g, 3 * i) for i in range(n)]
        for i in range(n):
            for j in rng.integers(max(0, i - 5), min(n, i + 5), 2):
                if g != "parts" or (i < 18) == (j < 18):
                    edges.append((g, 3 * i, 3 * int(j), float(rng.integers(1, 5)) / 2))
    n = spark.createDataFrame(nodes, "graph_id string, node_id long").cache()
    return n, spark.createDataFrame(edges, "graph_id string, src long, dst long, weight double").cache()


@pytest.mark.parametrize("kind, largest", [("normalized", False), ("laplacian", False), ("adjacency", True)])
def test_lanczos_equals_dense(spark, graph, kind, largest, monkeypatch):
    monkeypatch.setattr(krylov, "BLOCK", 32)
    want = {r["graph_id"]: r["eig"] for r in S.spectrum(*graph, 5, kind, True, largest).collect()}
    monkeypatch.setattr(S, "WHOLE", 3)
    got = {r["graph_id"]: r["eig"] for r in S.spectrum(*graph, 5, kind, True, largest).collect()}
    assert got.keys() == want.keys()
    for g in want:  # a magnitude may come with both signs
        assert np.allclose(np.abs(got[g]), np.abs(want[g]), atol=1e-8)


def test_lanczos_that_has_not_settled_says_so(spark, graph):
    entries = krylov.operator_entries(*graph, "laplacian")
    got = {r["graph_id"]: r["residual"] for r in krylov.lanczos(graph[0], entries, 6, most=12).collect()}
    assert got["long"] > 1e-6 and got["tiny"] == 0


def test_components_of_a_sparse_table_equal_dense(spark, graph, monkeypatch):
    monkeypatch.setattr(krylov, "BLOCK", 32)
    want = {(r[0], r[1]): np.array(r[2]) for r in E.node_embeddings(*graph, 6, 3, 8).collect()}
    monkeypatch.setattr(E, "WHOLE", 4)
    got = {(r[0], r[1]): np.array(r[2]) for r in E.node_embeddings(*graph, 6, 3, 8).collect()}
    assert got.keys() == want.keys()
    for g in ("long", "parts", "tiny", "bare"):
        a, b = (np.array([m[k] for k in sorted(m) if k[0] == g]) for m in (want, got))
        apart = np.linalg.svd(np.linalg.qr(a[:, :4])[0].T @ np.linalg.qr(b[:, :4])[0])[1] if np.linalg.matrix_rank(a[:, :4]) == 4 else np.ones(1)
        assert np.sqrt(max(0.0, 1 - apart.min() ** 2)) < 1e-6
        assert np.allclose(np.linalg.norm(a, axis=0), np.linalg.norm(b, axis=0), atol=1e-6)


def test_walks_take_any_neighbour_and_stop_at_dead_ends(spark):
    hub = spark.createDataFrame([("g", 0, i, 1.0) for i in range(1, 40)], "graph_id string, src long, dst long, weight double")
    nodes = spark.createDataFrame([("g", i) for i in range(41)], "graph_id string, node_id long")
    got = E.random_walks(nodes, hub, 6, 12, 3).collect()
    assert len(got) == 41 * 6
    for r in got:
        assert r["walk"] == [40] if r["start"] == 40 else len(r["walk"]) == 12 and all((a == 0) != (b == 0) for a, b in zip(r["walk"], r["walk"][1:]))
    assert len({x for r in got for x in r["walk"]}) == 41


def test_positional_encoding_and_states_of_large_matrices(spark, graph, monkeypatch):
    monkeypatch.setattr(krylov, "BLOCK", 32)
    one = [x.filter("graph_id = 'long'") for x in graph]
    want = S.positional_encoding(*one, 3).first()["pe"]
    matrix = krylov.operator_entries(*one, "laplacian").groupBy("graph_id", "i", "j").sum("value").withColumnRenamed("sum(value)", "value")
    states = S.matrix_spectrum(matrix, 4).first()
    monkeypatch.setattr(S, "WHOLE", 9)
    assert np.allclose(S.positional_encoding(*one, 3).first()["pe"], want, atol=1e-6)
    got = S.matrix_spectrum(matrix, 4).first()
    assert np.allclose(got["eig"], states["eig"], atol=1e-8) and np.allclose(got["ipr"], states["ipr"], atol=1e-6)


OPERATORS = {
    "path_features": lambda g: P.path_features(*g), "sampled_paths": lambda g: P.path_features(*g, 12), "weighted_path_mean": lambda g: P.weighted_path_mean(*g, 10),
    "hop_lengths": lambda g: P.hop_lengths(*g, 15), "betweenness": lambda g: P.betweenness(*g, None), "sampled_betweenness": lambda g: P.betweenness(*g, 9),
    "centrality_features": lambda g: P.centrality_features(*g, 12),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_frontiers_equal_matrices(graph, name, monkeypatch):
    monkeypatch.setattr(frontier, "SOURCES", 40)

    def rows():
        out = OPERATORS[name](graph).collect()
        keys = [c for c in ("graph_id", "node_id", "value") if c in out[0]]
        return {tuple(r[k] for k in keys): [v for c, v in r.asDict().items() if c not in keys] for r in out}

    if name == "sampled_paths":  # a matrix takes all nodes of graphs up to a hundred
        monkeypatch.setattr(P, "WHOLE", 3)
        got = rows()
        assert got["long",][0] > 1 and got["bare",] == [0.0, 0]
        return
    want = rows()
    monkeypatch.setattr(P, "WHOLE", 29)
    got = rows()
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert [x is None for x in got[k]] == [x is None for x in v]
        assert np.allclose([x for x in got[k] if x is not None], [x for x in v if x is not None], atol=1e-12)


def test_negative_weights_are_refused(spark):
    links = spark.createDataFrame([("g", 1, 2, -1.0)], "graph_id string, node_id long, other long, w double")
    with pytest.raises(ValueError):
        frontier.lengths(links, links.selectExpr("graph_id", "node_id as source"))


# transport


def test_transport_is_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(150):
        n, m = rng.integers(1, 4, 2)
        cost = rng.normal(size=(n, m)) if rng.random() < 0.7 else rng.integers(0, 3, size=(n, m)).astype(float)
        flow, prices = D.transport(cost, np.full(n, m), np.full(m, n), None if rng.random() < 0.5 else rng.normal(size=m))
        assert (flow.sum(1) == m).all() and (flow.sum(0) == n).all() and (flow >= 0).all()
        whole = np.repeat(np.repeat(cost, m, 0), n, 1)  # a unit of mass each
        if n * m <= 6:
            best = min(sum(whole[i, p[i]] for i in range(n * m)) for p in itertools.permutations(range(n * m)))
            assert abs((flow * cost).sum() - best) < 1e-9
    for n, m in ((40, 40), (23, 31)):
        cost = rng.normal(size=(n, m))
        flow, prices = D.transport(cost, np.full(n, m), np.full(m, n))
        rows = (cost - prices).min(1)  # prices that fit prove that nothing is cheaper
        assert abs((flow * cost).sum() - m * rows.sum() - n * prices.sum()) < 1e-8


def test_conditional_gradient_descends_and_keeps_marginals():
    rng = np.random.default_rng(3)
    for n, m in ((14, 14), (12, 17)):
        x, y = (np.linalg.norm(p[:, None] - p[None], axis=2) for p in (rng.normal(size=(n, 3)), rng.normal(size=(m, 3))))
        const = (x**2).mean(1)[:, None] + (y**2).mean(1)[None]
        costs = []
        t, cost = D.conditional_gradient(x, y, np.full((n, m), 1 / (n * m)), const, 1.0, 0.0, 50, 1e-12, costs)
        assert all(a > b for a, b in zip(costs, costs[1:])) and cost <= costs[-1]
        assert np.abs(t.sum(1) - 1 / n).max() < 1e-12 and np.abs(t.sum(0) - 1 / m).max() < 1e-12
