"""Walks and components of graphs whose edges a task holds: against the joins and iterations of larger ones, and matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import embeddings as E
from skyloom.operators import krylov


@pytest.fixture(scope="module")
def graph(spark):
    """A tree with more edges, one of them twice and a loop; nodes without edges; a pair; a graph without a name."""
    rng = np.random.default_rng(7)
    edges = [("tree", 3 * int(rng.integers(i)), 3 * i, 1.0) for i in range(1, 60)] + [("tree", 0, 3, 1.0), ("tree", 9, 9, 1.0), ("pair", 5, -4, 1.0)]
    nodes = [("tree", 3 * i) for i in range(66)] + [("pair", 5), ("pair", -4), ("bare", 1), (None, 2)]
    return spark.createDataFrame(nodes, "graph_id string, node_id long").cache(), spark.createDataFrame(edges, "graph_id string, src long, dst long, weight double").cache()


def test_hashes_are_those_of_spark(spark):
    rows = spark.range(-20, 20).select(F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(7), F.lit(-3)).alias("more")).toPandas()
    assert (E.hashed(E.hashed(rows["h"].to_numpy(), 7), -3) == rows["more"]).all()


def test_walks_are_those_of_joins_without_a_table_a_step(graph, monkeypatch):
    read = lambda df: sorted((r["graph_id"] or "", r["start"], r["w"], r["walk"]) for r in df.collect())
    want = read(E._joined_walks(*graph, 4, 13, 42))

    def none(*_):
        raise AssertionError("walks that a task can make were staged")

    monkeypatch.setattr(E, "stored", none)
    assert read(E.random_walks(*graph, 4, 13)) == want and len(want) == 70 * 4
    monkeypatch.setattr(E, "SLOTS", 600)  # many parts
    assert read(E.random_walks(*graph, 4, 13)) == want


def test_counts_are_those_of_the_walks(graph, monkeypatch):
    read = lambda df: sorted(map(tuple, df.collect()))
    named = graph[0].filter("graph_id is not null")
    want = read(E.cooccurrence(E._joined_walks(named, graph[1], 4, 13, 42), 3))
    monkeypatch.setattr(E, "COUNTED", 200)
    assert read(E.walk_counts(named, graph[1], 4, 13, 3)) == want
    monkeypatch.setattr(E, "LINKS", 5)  # one graph by joins, the others not
    assert read(E.walk_counts(named, graph[1], 4, 13, 3)) == want


@pytest.mark.parametrize("most", [20_000_000, 0])
def test_components_of_a_held_table_equal_dense(graph, monkeypatch, most):
    monkeypatch.setattr(krylov, "BLOCK", 32)
    named = graph[0].filter("graph_id is not null")
    read = lambda: {(r[0], r[1]): np.array(r[2]) for r in E.node_embeddings(named, graph[1], 6, 8, 20).collect()}
    want = read()
    monkeypatch.setattr(E, "WHOLE", 3)
    monkeypatch.setattr(E, "ENTRIES", most)
    got = read()
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-5 * max(1.0, np.abs(want[k]).max())), k
