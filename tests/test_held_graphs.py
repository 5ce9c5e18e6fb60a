"""Graphs beyond a matrix of their nodes, of which a task holds the edges: against matrices, and against the joins of larger ones."""

import numpy as np
import pytest

from skyloom.operators import frontier, sparse
from skyloom.operators import paths as P
from skyloom.operators import spectral as S


@pytest.fixture(scope="module")
def graph(spark):
    """Twelve separate random trees with a few more edges, and nodes without any, as one graph; a ring as another."""
    rng = np.random.default_rng(4)
    nodes = [("many", i) for i in range(0, 3000, 5)] + [("ring", i) for i in range(50)]
    edges = [("ring", min(i, (i + 1) % 50), max(i, (i + 1) % 50), 1.0) for i in range(50)]
    for c in range(12):
        for i in range(1, 45):
            edges.append(("many", 5 * (45 * c + int(rng.integers(i))), 5 * (45 * c + i), float(rng.integers(1, 9))))
        for _ in range(20):
            a, b = sorted(rng.choice(45, 2, replace=False))
            edges.append(("many", int(5 * (45 * c + a)), int(5 * (45 * c + b)), float(rng.integers(1, 9))))
    return spark.createDataFrame(nodes, "graph_id string, node_id long").cache(), spark.createDataFrame(edges, "graph_id string, src long, dst long, weight double").cache()


@pytest.mark.parametrize("kind, largest", [("normalized", False), ("laplacian", False), ("adjacency", True)])
def test_every_component_has_its_zero(graph, kind, largest, monkeypatch):
    want = {r["graph_id"]: r["eig"] for r in S.spectrum(*graph, 80, kind, True, largest).collect()}
    monkeypatch.setattr(S, "WHOLE", 9)
    got = {r["graph_id"]: r["eig"] for r in S.spectrum(*graph, 80, kind, True, largest).collect()}
    for g in want:  # 60 nodes without edges and twelve components: a block of four finds a zero four times
        assert np.allclose(np.abs(got[g]), np.abs(want[g]), atol=1e-9)
    if not largest:
        assert np.sum(np.abs(got["many"]) < 1e-9) == 72


def test_eigenvalues_of_any_multiplicity_and_no_matrix(monkeypatch):
    m = 24
    i = np.arange(m * m)
    src, dst = np.concatenate([i, i]), np.concatenate([(i // m + 1) % m * m + i % m, i // m * m + (i % m + 1) % m])
    monkeypatch.setattr(sparse, "DENSE", 10)
    for kind, largest in (("laplacian", False), ("normalized", False), ("adjacency", True)):
        want = np.linalg.eigvalsh(S._matrix(m * m, src, dst, np.ones(len(src)), kind))
        want = want[np.argsort(-np.abs(want) if largest else want, kind="stable")][:15]
        assert np.allclose(np.abs(sparse.spectrum(m * m, src, dst, np.ones(len(src)), kind, 15, largest)), np.abs(want), atol=1e-10)


def test_encodings_add_up(graph, monkeypatch):
    monkeypatch.setattr(S, "WHOLE", 9)
    got = {r["graph_id"]: r["pe"] for r in S.positional_encoding(*graph, 4).collect()}
    # vectors of a zero of one component: sums of roots of degrees, or one node alone
    assert len(got["many"]) == len(got["ring"]) == 4 and all(0 < x < 1 for x in got["many"] + got["ring"])


OPERATORS = {
    "paths": lambda g: P.path_features(*g), "weighted": lambda g: P.weighted_path_mean(*g, sample=300), "hops": lambda g: P.hop_lengths(*g, sample=100),
    "betweenness": lambda g: P.betweenness(*g, sample=70), "centrality": lambda g: P.centrality_features(*g, sample=70),
}


@pytest.mark.parametrize("by_joins", [False, True])
@pytest.mark.parametrize("name", OPERATORS)
def test_parts_of_sources_equal_matrices(graph, name, by_joins, monkeypatch):
    if by_joins and name == "centrality":
        pytest.skip("joins from all sources are held by test_large_graphs")
    monkeypatch.setattr(sparse, "BITS", 128)

    def rows():
        out = OPERATORS[name](graph).collect()
        keys = [c for c in ("graph_id", "node_id", "value") if c in out[0]]
        return {tuple(r[k] for k in keys): [v for c, v in r.asDict().items() if c not in keys] for r in out}

    want = rows()
    monkeypatch.setattr(P, "WHOLE", 60)  # the ring stays a matrix
    if by_joins:
        monkeypatch.setattr(sparse, "HELD", 60)
        monkeypatch.setattr(frontier, "SOURCES", 300)
    else:  # graphs that a task can hold are not searched by joins
        monkeypatch.setattr(frontier, "two_way_links", None)
    got = rows()
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(got[k], v, atol=1e-12)


def test_rows_of_lengths_equal_the_matrix(graph, monkeypatch):
    monkeypatch.setattr(P, "ROWS", 100)
    want = {r["graph_id"]: (r["ids"], r["matrix"]) for r in P.distance_matrices(*graph).collect()}
    got = {(r["graph_id"], r["node_id"]): r["lengths"] for r in P.distance_rows(*graph).collect()}
    assert len(got) == sum(len(ids) for ids, _ in want.values())
    for g, (ids, matrix) in want.items():
        assert all(got[g, i] == row for i, row in zip(ids, matrix))


def test_negative_weights_are_refused():
    links = sparse.neighbours(2, np.array([0]), np.array([1]), np.array([-1.0]))
    with pytest.raises(ValueError):
        sparse.lengths(2, links, [0])


def test_edges_of_a_graph_go_once_to_a_task_that_gives_rows_of_lengths_in_turn(graph, monkeypatch):
    """No group of rows is made as a whole, as those of a cogroup are."""
    nodes, edges = graph
    monkeypatch.setattr(P, "ROWS", 5)
    monkeypatch.setattr(P, "DEALT", 40)
    made = P.distance_rows(nodes, edges)
    held = {r["graph_id"]: r["count"] for r in nodes.groupBy("graph_id").count().collect()}
    assert made.rdd.getNumPartitions() == sum(-(-n // 40) for n in held.values())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "MapInArrow" in plan
    assert made.count() == nodes.count()
