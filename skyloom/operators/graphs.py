"""Node and edge tables: construction, lattices, Hamiltonians, components, statistics.

Graphs are rows of ``graph_id``; edges are undirected, ``src < dst``, without loops; the node table decides which
nodes there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.operators.neighbors import knn_edges
from skyloom.operators.paths import _per_graph as per_graph
from skyloom.operators.sampling import grid_stride, hash_order, lcg_order, sample_n_by  # noqa: F401  part of the interface
from skyloom.operators.scaling import normalize_coordinates, scale_weights
from skyloom.staging import freed, running_sum, stored

#: Edges of a graph whose components a task finds; larger graphs are contracted in rounds.
COMPONENT_EDGES = 500_000

NODE, EDGE = ("graph_id", "node_id"), ("graph_id", "src", "dst", "weight")


def canonical_edges(edges: DataFrame, src: str = "src", dst: str = "dst", weight: Column | None = None, order: Column | None = None) -> DataFrame:
    """Edges with src < dst, loops out, each pair once; of repeated pairs the last by ``order`` wins."""
    w = weight if weight is not None else (F.col("weight") if "weight" in edges.columns else F.lit(1.0))
    o = order if order is not None else w
    pairs = edges.filter(F.col(src) != F.col(dst)).select(
        "graph_id", F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"), w.cast("double").alias("weight"), o.alias("_o")
    )
    return pairs.groupBy("graph_id", "src", "dst").agg(F.max_by("weight", "_o").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end: graph_id, node_id, other, weight."""
    ends = F.array(F.struct(F.col("src").alias("node_id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other")))
    return edges.select("graph_id", "weight", F.explode(ends).alias("e")).select("graph_id", "e.node_id", "e.other", "weight")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, degree, strength; nodes without an edge have 0."""
    counted = both_ways(edges).groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    return nodes.select(*NODE).join(counted, list(NODE), "left").na.fill(0, ["degree"]).na.fill(0.0, ["strength"])


def catalog_graph(nodes: DataFrame, k: int, axes: Sequence[str] = ("x", "y", "z"), metric: str = "euclidean", unit_cube: bool = True, unit_weights: bool = True) -> tuple[DataFrame, DataFrame]:
    """kNN graph of a catalog: coordinates to the unit cube, edges, weights to [0, 1]; attributes stay with the nodes."""
    placed = normalize_coordinates(nodes, axes) if unit_cube else nodes
    edges = knn_edges(placed, k, axes, metric)
    return placed, scale_weights(edges, "minmax") if unit_weights else edges


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select(*NODE)
    return edges.join(ids.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi"
    ).select(*edges.columns)


def relabel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids 0 .. n-1 in each graph, in the order of the old ones; ranges of nodes are counted, no graph is ordered in a task."""
    counted = running_sum(nodes, list(NODE), F.lit(1), "_at")
    first = counted.groupBy(F.col("graph_id").alias("_of")).agg(F.min("_at").alias("_first"))
    ids = counted.join(first, F.col("graph_id") == F.col("_of")).withColumn("_new", F.col("_at") - F.col("_first")).drop("_at", "_of", "_first")
    key = ids.select("graph_id", "node_id", "_new")
    moved = edges.join(key.withColumnsRenamed({"node_id": "src", "_new": "_s"}), ["graph_id", "src"]).join(
        key.withColumnsRenamed({"node_id": "dst", "_new": "_d"}), ["graph_id", "dst"]
    )
    new_edges = moved.select(
        "graph_id", F.least("_s", "_d").cast("long").alias("src"), F.greatest("_s", "_d").cast("long").alias("dst"),
        *[c for c in edges.columns if c not in ("graph_id", "src", "dst")],
    )
    return ids.withColumn("node_id", F.col("_new").cast("long")).drop("_new"), new_edges


def exact_size(nodes: DataFrame, edges: DataFrame, n: int | Column, seed: int = 42, order=hash_order) -> tuple[DataFrame, DataFrame]:
    """Each graph's first ``n`` nodes by hash, their edges, new ids."""
    kept = sample_n_by(nodes, n, ["graph_id"], "node_id", seed, order)
    return relabel(kept, induced(edges, kept))


def downsample(nodes: DataFrame, edges: DataFrame, n: int, method: str = "degree", largest: bool = False, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The ``n`` nodes of the highest degree or betweenness, or random ones; of the largest component if asked."""
    if largest:
        nodes = largest_component(nodes, edges)
        edges = induced(edges, nodes)
    if method == "random":
        return exact_size(nodes, edges, n, seed)
    if method == "betweenness":
        from skyloom.operators.paths import betweenness

        rated = nodes.join(betweenness(nodes, edges), list(NODE)).withColumnRenamed("betweenness", "_v")
    else:
        rated = nodes.join(degrees(nodes, edges).withColumnRenamed("degree", "_v").drop("strength"), list(NODE))
    w = Window.partitionBy("graph_id").orderBy(F.desc("_v"), "node_id")
    kept = rated.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select(*nodes.columns)
    return kept, induced(edges, kept)


def match_sizes(nodes: DataFrame, edges: DataFrame, seed: int = 42, order=hash_order) -> tuple[DataFrame, DataFrame]:
    """All graphs to the size of the smallest."""
    least = nodes.groupBy("graph_id").count().agg(F.min("count")).first()[0] or 0
    return exact_size(nodes, edges, least, seed, order)


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """graph_id, node_id, component: the smallest node reached.

    Graphs of up to ``COMPONENT_EDGES`` edges are labelled in a task each. The edges of larger ones are contracted: in a
    round each node goes to that of itself and its neighbours which comes first by a hash of the round, edges are named anew,
    and loops and repeats drop out, so a path of n nodes takes some log n rounds. The labels of the rounds are then followed
    back. Tables of a round are deleted as soon as the next has been written.
    """
    few, many = _by_edges(nodes, edges)
    kind = dict(nodes.dtypes)
    small = per_graph(
        few[0], few[1].select("graph_id", "src", "dst", F.lit(1.0).alias("weight")), _labelled,
        f"graph_id {kind['graph_id']}, node_id {kind['node_id']}, component {kind['node_id']}",
    )
    return small if many is None else small.unionByName(_contracted(*many, rounds))


def _labelled(g, ids, src, dst, w):
    import numpy as np

    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, label[src], label[dst])
        np.minimum.at(new, label[dst], label[src])
        while True:  # labels of labels
            far = new[new]
            if np.array_equal(far, new):
                break
            new = far
        if np.array_equal(new, label):
            return {"graph_id": [g] * len(ids), "node_id": ids, "component": ids[label]}
        label = new


def _by_edges(nodes: DataFrame, edges: DataFrame):
    sizes = edges.groupBy("graph_id").agg(F.count("*").alias("_m")).filter(F.col("_m") > COMPONENT_EDGES).select("graph_id")
    if not sizes.take(1):
        return (nodes, edges), None
    large = stored(sizes, "large")
    return tuple(tuple(x.join(large, "graph_id", how) for x in (nodes, edges)) for how in ("left_anti", "left_semi"))


def _contracted(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    ends = lambda a, b: (F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    left = stored(edges.filter("src <> dst").select("graph_id", *ends("src", "dst")).distinct(), "left")
    moves = []
    for i in range(rounds):
        if not left.take(1):
            break
        pair = lambda a, b: F.struct(F.col(a).alias("node_id"), F.col(b).alias("other"))
        both = left.select("graph_id", F.explode(F.array(pair("src", "dst"), pair("dst", "src"))).alias("e")).select("graph_id", "e.*")
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(i)).alias("h"), F.col(c).alias("to"))
        first = both.groupBy("graph_id", "node_id").agg(F.min(ranked("other")).alias("near"))
        moves.append(stored(first.select("graph_id", "node_id", F.least("near", ranked("node_id"))["to"].alias("to")), "moves"))
        a, b = (moves[-1].select("graph_id", F.col("node_id").alias(x), F.col("to").alias(y)) for x, y in (("src", "a"), ("dst", "b")))
        met = left.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"]).filter("a <> b").select("graph_id", *ends("a", "b"))
        further = stored(met.distinct(), "left")
        freed(left)
        left = further
    else:
        raise RuntimeError("components did not settle")
    freed(left)
    label = None
    for m in reversed(moves):
        if label is not None:
            far = label.select("graph_id", F.col("node_id").alias("to"), F.col("to").alias("far"))
            followed = stored(m.join(far, ["graph_id", "to"], "left").select("graph_id", "node_id", F.coalesce("far", "to").alias("to")), "followed")
            # a node of a later round is one of this, too, so its label is there
            freed(label, m)
            label = followed
        else:
            label = m
    if label is None:
        return nodes.select(*NODE, F.col("node_id").alias("component"))
    named = nodes.select(*NODE).join(label, list(NODE), "left").select(*NODE, F.coalesce("to", "node_id").alias("to"))
    least = named.groupBy("graph_id", "to").agg(F.min("node_id").alias("component"))
    return named.join(least, ["graph_id", "to"]).select(*NODE, "component")


def largest_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of each graph's largest component; of equal ones that of the smallest node."""
    labels = connected_components(nodes, edges)
    sizes = labels.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("graph_id").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return nodes.join(labels.join(best, ["graph_id", "component"], "left_semi").select(*NODE), list(NODE), "left_semi")


def graph_statistics(nodes: DataFrame, edges: DataFrame, connected: bool = False) -> DataFrame:
    """A row a graph: counts, density, degree and weight mean, std (population), min, max.

    With ``connected`` also the number of components, and the mean clustering of graphs of one component and three nodes
    or more, null of others.
    """
    deg = degrees(nodes, edges).groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.avg("degree").alias("degree_mean"), F.stddev_pop("degree").alias("degree_std"),
        F.min("degree").alias("degree_min"), F.max("degree").alias("degree_max"),
    )
    w = edges.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.avg("weight").alias("weight_mean"), F.stddev_pop("weight").alias("weight_std"),
        F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"),
    )
    n, m = F.col("n_nodes"), F.col("n_edges")
    out = deg.join(w, "graph_id", "left").na.fill(0, ["n_edges"]).withColumn("density", F.coalesce(F.try_divide(2.0 * m, n * (n - 1)), F.lit(0.0)))
    if not connected:
        return out
    from skyloom.operators.topology import clustering_features

    parts = connected_components(nodes, edges).groupBy("graph_id").agg(F.count_distinct("component").alias("n_components"))
    local = clustering_features(nodes, edges).select("graph_id", F.col("clustering_mean").alias("clustering"))
    whole = (F.col("n_components") == 1) & (F.col("n_nodes") > 2)
    return out.join(parts, "graph_id", "left").join(local, "graph_id", "left").withColumn("clustering", F.when(whole, F.col("clustering")))


def compare_graphs(stats: DataFrame, a, b) -> DataFrame:
    """Absolute differences of every statistic of two graphs."""
    names = [c for c in stats.columns if c != "graph_id"]
    one = stats.filter(F.col("graph_id") == a).select(*[F.col(c).alias(f"{c}_a") for c in names])
    two = stats.filter(F.col("graph_id") == b).select(*[F.col(c).alias(f"{c}_b") for c in names])
    return one.join(two).select(*[F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"{c}_diff") for c in names])


# lattices, potentials and operators on them


def grid_2d(spark: SparkSession, nx: int, ny: int, x: tuple[float, float], y: tuple[float, float], graph_id: str = "grid") -> DataFrame:
    """graph_id, node_id, ix, iy, x, y of an evenly spaced grid, y fastest."""
    dx, dy = ((b - a) / (n - 1) if n > 1 else 0.0 for (a, b), n in ((x, nx), (y, ny)))
    ix, iy = F.floor(F.col("id") / ny), F.col("id") % ny
    return spark.range(nx * ny).select(
        F.lit(graph_id).alias("graph_id"), F.col("id").alias("node_id"), ix.cast("long").alias("ix"), iy.cast("long").alias("iy"),
        (F.lit(x[0]) + ix * dx).alias("x"), (F.lit(y[0]) + iy * dy).alias("y"),
    )


def oscillator_potential(wx: float = 1.0, wy: float = 1.0, x0: float = 0.0, y0: float = 0.0) -> Column:
    return 0.5 * wx**2 * (F.col("x") - x0) ** 2 + 0.5 * wy**2 * (F.col("y") - y0) ** 2


def well_potential(depth: float = 10.0, half_x: float = 1.0, half_y: float = 1.0, barrier: float = 0.0, bumps: Sequence[tuple] = ()) -> Column:
    """-depth strictly inside the box, else the barrier, plus Gaussians (amplitude, x, y, sigma)."""
    v = F.when((F.abs("x") < half_x) & (F.abs("y") < half_y), F.lit(-float(depth))).otherwise(F.lit(float(barrier)))
    for amplitude, x, y, sigma in bumps:
        v = v + amplitude * F.exp(-((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2) / (2 * sigma**2))
    return v


def hamiltonian(grid: DataFrame, potential: Column, nx: int, ny: int, dx: float, dy: float, mass: float = 1.0, hbar: float = 1.0) -> DataFrame:
    """graph_id, i, j, value (both triangles) of the five-point operator on a ``grid_2d``, Dirichlet edges."""
    t = hbar * hbar / (2 * mass)
    hops = [(1, 0, -t / dx**2), (-1, 0, -t / dx**2), (0, 1, -t / dy**2), (0, -1, -t / dy**2)]
    cells = [F.struct(F.col("node_id").alias("j"), (F.lit(2 * t / dx**2 + 2 * t / dy**2) + F.col("_v")).alias("value"))]
    for a, b, value in hops:
        inside = (F.col("ix") + a).between(0, nx - 1) & (F.col("iy") + b).between(0, ny - 1)
        cells.append(F.when(inside, F.struct((F.col("node_id") + a * ny + b).alias("j"), F.lit(value).alias("value"))))
    rows = grid.withColumn("_v", potential).select("graph_id", F.col("node_id").alias("i"), F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return rows.select("graph_id", "i", F.col("c.j").alias("j"), F.col("c.value").alias("value"))


def matrix_graph(matrix: DataFrame, threshold: float = 1e-10, absolute: bool = True) -> DataFrame:
    """Edges of a symmetric matrix (graph_id, i, j, value): upper triangle, above ``threshold``."""
    w = F.abs("value") if absolute else F.col("value")
    return matrix.filter("i < j").select("graph_id", F.col("i").alias("src"), F.col("j").alias("dst"), w.alias("weight")).filter(F.col("weight") > threshold)


def quantum_graph(grid: DataFrame, matrix: DataFrame, potential: Column | None = None, threshold: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """Nodes of a grid with their ``potential``, and the edges of its operator above ``threshold``."""
    nodes = grid if potential is None else grid.withColumn("potential", potential)
    return nodes, matrix_graph(matrix, threshold)


def reduced_quantum_graph(grid: DataFrame, matrix: DataFrame, most: int, potential: Column | None = None, method: str = "grid", threshold: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """The same on at most ``most`` nodes of an even stride, with the part of the operator between them."""
    kept = grid_stride(grid, most, method=method)
    nodes, edges = quantum_graph(kept, matrix, potential, threshold)
    return nodes, induced(edges, nodes)


def ring(spark: SparkSession, n: int, graph_id: str = "ring") -> DataFrame:
    i, j = F.col("id"), (F.col("id") + 1) % n
    edges = spark.range(n).select(F.lit(graph_id).alias("graph_id"), F.least(i, j).alias("src"), F.greatest(i, j).alias("dst"), F.lit(1.0).alias("weight"))
    return edges.filter("src <> dst").distinct()


def torus_2d(spark: SparkSession, side: int, graph_id: str = "torus") -> DataFrame:
    r, c = F.floor(F.col("id") / side), F.col("id") % side
    others = F.array(((r + 1) % side) * side + c, r * side + (c + 1) % side)
    edges = spark.range(side * side).select(F.col("id"), F.explode(others).alias("o"))
    return edges.select(
        F.lit(graph_id).alias("graph_id"), F.least("id", "o").cast("long").alias("src"), F.greatest("id", "o").cast("long").alias("dst"), F.lit(1.0).alias("weight")
    ).filter("src <> dst").distinct()


def nodes_0_to(spark: SparkSession, n: int, graph_id: str) -> DataFrame:
    return spark.range(n).select(F.lit(graph_id).alias("graph_id"), F.col("id").alias("node_id"))


def onsite_potential(nodes: DataFrame, width: float, seed: int = 42) -> DataFrame:
    """``eps`` uniform in [-width/2, width/2), from a hash of graph, node and seed."""
    u = F.pmod(F.xxhash64("graph_id", "node_id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return nodes.withColumn("eps", (u - 0.5) * width)


def tight_binding(nodes: DataFrame, edges: DataFrame, hopping: float = 1.0) -> DataFrame:
    """H = diag(eps) - hopping * adjacency as (graph_id, i, j, value)."""
    diagonal = nodes.select("graph_id", F.col("node_id").alias("i"), F.col("node_id").alias("j"), F.col("eps").alias("value"))
    hops = both_ways(edges).select("graph_id", F.col("node_id").alias("i"), F.col("other").alias("j"), F.lit(-float(hopping)).alias("value"))
    return diagonal.union(hops)


def random_members(spark: SparkSession, family: str, n: int, size: int, p: float = 0.0, degree: int = 4, seed: int = 42) -> DataFrame:
    """Edges of ``size`` graphs of a family (ring, torus, regular), each edge rewired with chance ``p``.

    A member is a task's unit: regular graphs and rewiring are sequential draws. Member r uses seed + 10000 r.
    """
    side = round(n**0.5)
    if family not in ("ring", "torus", "regular"):
        raise ValueError(f"unknown family {family!r}")
    if family == "torus" and side * side != n:
        raise ValueError("a torus needs a square number of nodes")

    def member(pdf):
        import numpy as np
        import pandas as pd

        r = int(pdf["member"].iloc[0])
        rng = np.random.default_rng(seed + 10000 * r)
        if family == "ring":
            edges = {tuple(sorted((i, (i + 1) % n))) for i in range(n) if n > 1}
        elif family == "torus":
            edges = {tuple(sorted((a * side + b, o))) for a in range(side) for b in range(side) for o in ((a + 1) % side * side + b, a * side + (b + 1) % side) if o != a * side + b}
        else:
            edges = _regular(rng, n, degree)
        edges = _rewired(rng, edges, n, p)
        found = sorted(edges)
        return pd.DataFrame({"graph_id": f"{family}_{n}_{r}", "src": [a for a, _ in found], "dst": [b for _, b in found], "weight": 1.0})

    members = spark.range(size).withColumnRenamed("id", "member").repartition(max(1, min(size, 64)), "member")
    return members.groupBy("member").applyInPandas(member, "graph_id string, src long, dst long, weight double")


def _regular(rng, n: int, degree: int) -> set:
    """A simple graph with all degrees equal: stubs are paired at random; clashing pairs are drawn again."""
    if n * degree % 2 or degree >= n:
        raise ValueError("no such regular graph")
    while True:
        edges, stubs = set(), [i for i in range(n) for _ in range(degree)]
        for _ in range(200):
            rng.shuffle(stubs)
            left = []
            for a, b in zip(stubs[::2], stubs[1::2]):
                e = (min(a, b), max(a, b))
                if a == b or e in edges:
                    left += [a, b]
                else:
                    edges.add(e)
            if not left:
                return edges
            stubs = left


def _rewired(rng, edges: set, n: int, p: float) -> set:
    """Each edge with chance ``p`` leaves its second end for a random node that is no neighbour yet."""
    if p <= 0:
        return edges
    out = set(edges)
    for a, b in sorted(edges):
        if rng.random() >= p:
            continue
        out.discard((a, b))
        for _ in range(100):
            c = int(rng.integers(n))
            e = (min(a, c), max(a, c))
            if c != a and c != b and e not in out:
                out.add(e)
                break
        else:
            out.add((a, b))
    return out
