"""Random walks and node embeddings: walks of a graph whose edges a task holds are made there, those of larger ones by a join a step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators import krylov, sparse
from skyloom.operators.graphs import both_ways
from skyloom.operators.paths import sized
from skyloom.staging import freed, running_sum, stored

#: Nodes of a graph whose co-occurrences a task holds as a matrix; components of larger ones are found by distributed iteration.
WHOLE = 4000
#: Steps of walks between two tables.
STEPS = 8
#: Edges of a graph, and entries of its co-occurrences, that a task holds at most.
LINKS, ENTRIES = 2_000_000, 20_000_000
#: Steps of all walks of a task, and of those that are counted at a time.
SLOTS, COUNTED = 4_000_000, 800_000


def hashed(seed: np.ndarray, value: int | np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int column after others whose hash is ``seed``."""
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    value = np.asarray(value, np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        x = (seed.view(np.uint64) + five + np.uint64(4)) ^ (value * one)
        x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * two + three
        x = (x ^ (x >> np.uint64(33))) * two
        x = (x ^ (x >> np.uint64(29))) * three
        return (x ^ (x >> np.uint64(32))).view(np.int64)


def walked(starts: np.ndarray, ends: np.ndarray, col: np.ndarray, sources: np.ndarray, hashes: np.ndarray, walks: int, length: int, seed: int) -> np.ndarray:
    """Node numbers of ``walks`` walks from each of ``sources``, a row a walk, -1 past a dead end.

    ``hashes`` are of graph and node, so that a step is the one that the join of a larger graph takes.
    """
    draws = hashed(np.repeat(hashes, walks), np.tile(np.arange(walks), len(hashes)))
    out = np.full((len(draws), length), -1, np.int64)
    out[:, 0] = at = np.repeat(sources, walks)
    live = np.arange(len(draws))
    for i in range(length - 1):
        degree = ends[at] - starts[at]
        live, at, degree = live[degree > 0], at[degree > 0], degree[degree > 0]
        at = col[starts[at] + hashed(hashed(draws[live], i), seed) % degree]
        out[live, i + 1] = at
    return out


def counted_pairs(walks: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys a * n + b, a <= b, ascending, and how often a and b of ``walked`` rows lie within ``window`` steps, one order of the two alone."""
    keys = []
    for off in range(1, min(window, walks.shape[1] - 1) + 1):
        a, b = walks[:, :-off].ravel(), walks[:, off:].ravel()
        both = b >= 0
        a, b = a[both], b[both]
        keys.append(np.minimum(a, b) * n + np.maximum(a, b))
    return np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)


def _by_parts(nodes: DataFrame, edges: DataFrame, walks: int, length: int, seed: int, made, schema: str) -> DataFrame:
    """``made(graph_id, ids, starts, walk)`` for parts of each graph's nodes; ``walk(rows)`` makes the walks of some of them.

    A task has all edges of its graph, and ``starts`` are the part's nodes.
    """
    share = max(1, SLOTS // max(1, walks * length))
    sizes = nodes.groupBy("graph_id").agg(F.ceil(F.count("*") / share).cast("int").alias("_parts")).select(F.col("graph_id").alias("_of"), "_parts")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame(columns=names)
        own, src, dst = n["node_id"].to_numpy(), e["src"].to_numpy(), e["dst"].to_numpy()
        ids = np.unique(np.concatenate([own, src, dst])) if len(e) else np.unique(own)
        src, dst = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        row, col = np.concatenate([src, dst]), np.concatenate([dst, src])
        order = np.lexsort((col, row))
        row, col = row[order], col[order]
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        sources, hashes = np.searchsorted(ids, own), n["_hash"].to_numpy(np.int64)
        return made(key[0], ids, own, lambda some: walked(at[:-1], at[1:], col, sources[some], hashes[some], walks, length, seed))

    met = nodes.select(F.col("graph_id").alias("graph_id"), F.col("node_id").alias("node_id"), F.xxhash64("graph_id", "node_id").alias("_hash"))
    met = met.join(sizes, F.col("graph_id") == F.col("_of")).withColumn("_part", F.pmod(F.xxhash64("node_id"), F.col("_parts")).cast("int"))
    left = met.select(*[F.col(c).alias(c) for c in ("graph_id", "_part", "node_id", "_hash")])
    ends = edges.select(*[F.col(c).alias(c) for c in ("graph_id", "src", "dst")]).join(sizes, F.col("graph_id") == F.col("_of"))
    ends = ends.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    right = ends.select(*[F.col(c).alias(c) for c in ("graph_id", "_part", "src", "dst")])
    return left.groupBy("graph_id", "_part").cogroup(right.groupBy("graph_id", "_part")).applyInPandas(run, schema)


def random_walks(nodes: DataFrame, edges: DataFrame, walks: int = 10, length: int = 80, seed: int = 42) -> DataFrame:
    """graph_id, start, w, walk (array of node ids): ``walks`` from every node, each step to a uniform neighbour.

    A step is drawn from a hash of walk, step and seed. Walks stop at a dead end. Of graphs of up to ``sparse.HELD`` nodes
    and ``LINKS`` edges a task has the edges and makes all steps of a part of the walks; larger ones go by a join a step.
    """
    some, huge = sized(nodes.filter("graph_id is not null"), edges, sparse.HELD, LINKS)
    kinds = dict(nodes.dtypes)
    schema = f"graph_id {kinds['graph_id']}, start {kinds['node_id']}, w int, walk array<{kinds['node_id']}>"

    def made(graph, ids, starts, walk):
        found = walk(np.arange(len(starts)))
        sizes = (found >= 0).sum(axis=1)
        rows = [ids[r[:m]] for r, m in zip(found, sizes)]
        return pd.DataFrame({"graph_id": graph, "start": np.repeat(starts, walks), "w": np.tile(np.arange(walks), len(starts)), "walk": rows})

    out = _by_parts(*some, walks, length, seed, made, schema)
    lost = nodes.filter("graph_id is null")  # a graph without a name has no edges
    lost = lost.select("graph_id", F.col("node_id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("w"), F.array("node_id").alias("walk"))
    out = out.unionByName(lost)
    return out if huge is None else out.unionByName(_joined_walks(*huge, walks, length, seed))


def _joined_walks(nodes: DataFrame, edges: DataFrame, walks: int, length: int, seed: int) -> DataFrame:
    """``random_walks`` of graphs of any size.

    Neighbours are rows by node and place, so a step is a join of walks with one neighbour each, and a hub is no list.
    Every ``STEPS`` steps are written.
    """
    ways = both_ways(edges)
    counted = running_sum(ways.select("graph_id", "node_id", "other"), ["graph_id", "node_id", "other"], F.lit(1), "_at")
    first = stored(ways.groupBy("graph_id", "node_id").agg(F.count("*").alias("deg")), "degrees")
    starts = counted.groupBy("graph_id", "node_id").agg(F.min("_at").alias("_first"))
    further = first.select("graph_id", F.col("node_id").alias("other"), F.col("deg").alias("next_deg"))
    near = counted.join(starts, ["graph_id", "node_id"]).join(further, ["graph_id", "other"])
    near = stored(near.select("graph_id", "node_id", (F.col("_at") - F.col("_first")).alias("_place"), F.col("other").alias("_next"), "next_deg"), "near")
    state = nodes.select("graph_id", F.col("node_id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("w"))
    state = state.select("graph_id", "start", "w", F.array("start").alias("walk"), F.col("start").alias("node_id"))
    state, held = state.join(first, ["graph_id", "node_id"], "left"), None
    for i in range(length - 1):
        draw = F.pmod(F.xxhash64("graph_id", "start", "w", F.lit(i), F.lit(seed)), F.col("deg"))
        state = state.withColumn("_place", draw).join(near, ["graph_id", "node_id", "_place"], "left")
        state = state.select(
            "graph_id", "start", "w",
            F.when(F.col("_next").isNotNull(), F.array_append("walk", F.col("_next"))).otherwise(F.col("walk")).alias("walk"),
            F.col("_next").alias("node_id"), F.col("next_deg").alias("deg"),
        )
        if i % STEPS == STEPS - 1:
            state = stored(state, "walks")
            if held is not None:
                freed(held)
            held = state
    return state.select("graph_id", "start", "w", "walk")


def cooccurrence(walks: DataFrame, window: int = 5) -> DataFrame:
    """graph_id, a, b, n: how often a and b lie within ``window`` steps of each other, i <> j."""
    near = F.flatten(
        F.transform(
            "walk",
            lambda x, i: F.transform(
                F.filter(F.sequence(F.greatest(i - window, F.lit(0)), F.least(i + window, F.size("walk") - 1)), lambda j: j != i),
                lambda j: F.struct(x.alias("a"), F.get("walk", j).alias("b")),
            ),
        )
    )
    return walks.select("graph_id", F.explode(near).alias("p")).groupBy("graph_id", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def walk_counts(nodes: DataFrame, edges: DataFrame, walks: int = 10, length: int = 80, window: int = 5, seed: int = 42) -> DataFrame:
    """``cooccurrence`` of ``random_walks``; where a task makes the walks it counts them, too, and no walk is a row."""
    some, huge = sized(nodes, edges, sparse.HELD, LINKS)
    kinds = dict(nodes.dtypes)
    schema = f"graph_id {kinds['graph_id']}, a {kinds['node_id']}, b {kinds['node_id']}, n long"

    def made(graph, ids, starts, walk):
        step, n = max(1, COUNTED // max(1, walks * length)), len(ids)
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(starts), step):
            more, seen = counted_pairs(walk(np.arange(at, min(at + step, len(starts)))), n, window)
            keys, back = np.unique(np.concatenate([keys, more]), return_inverse=True)
            times = np.bincount(back, np.concatenate([times, seen]), len(keys)).astype(np.int64)
        a, b = keys // n, keys % n
        apart = a != b
        times[~apart] *= 2  # a node that comes again is near to itself in both orders
        i, j = np.concatenate([a, b[apart]]), np.concatenate([b, a[apart]])
        return pd.DataFrame({"graph_id": graph, "a": ids[i], "b": ids[j], "n": np.concatenate([times, times[apart]])})

    parts = _by_parts(*some, walks, length, seed, made, schema)
    counts = parts.groupBy("graph_id", "a", "b").agg(F.sum("n").alias("n"))
    return counts if huge is None else counts.unionByName(cooccurrence(_joined_walks(*huge, walks, length, seed), window))


def leading_rows(n: int, i: np.ndarray, j: np.ndarray, value: np.ndarray, dim: int) -> np.ndarray:
    """The first ``dim`` principal components of the rows of a symmetric table less its column means, a row a node.

    ``i`` must ascend. Components are eigenvectors of H M M H, with H the projection away from the constant vector.
    """
    at = np.flatnonzero(np.diff(i, prepend=-1))
    rows = i[at]

    def product(x):
        out = np.zeros(n)
        out[rows] = np.add.reduceat(value * x[j], at)
        return out

    def squared(x):
        x = product(product(x - x.mean()))
        return x - x.mean()

    most = float(np.add.reduceat(np.abs(value), at).max()) ** 2
    e, u = sparse.largest_states(squared, n, dim, 0.0, most)
    found = (u * np.sqrt(np.maximum(e, 0.0))[:, None]).T
    return np.pad(found, ((0, 0), (0, max(0, dim - found.shape[1]))))


def node_embeddings(nodes: DataFrame, edges: DataFrame, dim: int = 64, walks: int = 10, length: int = 80, window: int = 5, seed: int = 42) -> DataFrame:
    """graph_id, node_id, embedding: principal components of co-occurrence rows, zero-padded to ``dim``.

    The sign of a component is fixed by making its largest entry positive. Of graphs of more than ``WHOLE`` nodes a task has
    the co-occurrences as a sparse table; those of more than ``sparse.HELD`` nodes or ``ENTRIES`` pairs go by
    ``krylov.principal_components``.
    """
    counts = stored(walk_counts(nodes, edges, walks, length, window, seed), "cooccurrence")
    (few, some), many = sized(nodes, counts, WHOLE)

    def run(key, n, c):
        ids = np.sort(n["node_id"].to_numpy())
        m = np.full((len(ids), len(ids)), 1e-6)
        m[np.searchsorted(ids, c["a"]), np.searchsorted(ids, c["b"])] += c["n"]
        centred = m - m.mean(axis=0)
        u, s, _ = np.linalg.svd(centred, full_matrices=False)
        return signed(key[0], ids, np.pad((u * s)[:, :dim], ((0, 0), (0, max(0, dim - len(s))))))

    def signed(graph, ids, e):
        sign = np.sign(e[np.abs(e).argmax(axis=0), np.arange(e.shape[1])])
        return pd.DataFrame({"graph_id": graph, "node_id": ids, "embedding": (e * np.where(sign == 0, 1, sign)).tolist()})

    def held(key, n, c):
        ids = np.sort(n["node_id"].to_numpy())
        i, j = (np.searchsorted(ids, c[x].to_numpy()) for x in ("a", "b"))
        order = np.argsort(i, kind="stable")
        e = leading_rows(len(ids), i[order], j[order], c["n"].to_numpy(float)[order], dim) if len(i) else np.zeros((len(ids), dim))
        return signed(key[0], ids, e)

    def cogrouped(nodes, counts, kernel):
        left = nodes.select(F.col("graph_id").alias("graph_id"), "node_id").groupBy("graph_id")
        right = counts.select(F.col("graph_id").alias("graph_id"), "a", "b", "n").groupBy("graph_id")
        return left.cogroup(right).applyInPandas(kernel, "graph_id string, node_id long, embedding array<double>")

    small = cogrouped(few, some, run)
    if many is None:
        return small
    middle, many = sized(*many, sparse.HELD, ENTRIES)
    small = small.unionByName(cogrouped(*middle, held))
    if many is None:
        return small
    entries = many[1].select("graph_id", F.col("a").alias("i"), F.col("b").alias("j"), F.col("n").cast("double").alias("value"))
    return small.unionByName(krylov.principal_components(many[0], entries, dim).select(F.col("graph_id").cast("string").alias("graph_id"), "node_id", "embedding"))


def aggregate_embeddings(vectors: DataFrame, method: str = "mean", by: str = "graph_id", column: str = "embedding") -> DataFrame:
    """Element-wise mean, max, sum, std (population) or concat (mean, max, std) of each group's vectors."""
    cells = vectors.select(by, F.posexplode(F.col(column)).alias("pos", "v"))
    stats = cells.groupBy(by, "pos").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.sum("v").alias("sum"), F.stddev_pop("v").alias("std"))
    rows = stats.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "max", "sum", "std"))).alias("s"))
    part = lambda n: F.transform("s", lambda x: x[n])
    made = F.concat(part("mean"), part("max"), part("std")) if method == "concat" else part(method)
    return rows.select(by, made.alias(column))


def embedding_features(nodes: DataFrame, edges: DataFrame, dim: int = 64, method: str = "mean", **walk) -> DataFrame:
    return aggregate_embeddings(node_embeddings(nodes, edges, dim, **walk), method)


