"""Path and centrality features: a graph of up to ``WHOLE`` nodes is a task's unit of work, with matrices of its nodes.

Of a graph of up to ``sparse.HELD`` nodes a task has the edges and a part of the sources; larger ones go by ``frontier``.
Within a task hops and lengths from all wanted sources are advanced together as array operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators import frontier, sparse
from skyloom.staging import stored

#: Nodes of a graph that a task takes whole, with matrices of its nodes.
WHOLE = 4000
#: Rows of a matrix of lengths that a task gives at a time, sources that it has, and tasks at most.
ROWS, DEALT, PART_TASKS = 16, 1024, 4096
#: Names of large graphs that a filter lists; more are joined.
LARGE_GRAPHS = 1000


def _per_graph(nodes: DataFrame, edges: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel(graph_id, ids, src, dst, weight)`` with ends as row numbers of the sorted ids, for each graph."""

    def run(key, n, e):
        import numpy as np
        import pandas as pd

        ids = np.sort(n["node_id"].to_numpy())
        if not len(ids):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        src, dst = (np.searchsorted(ids, e[c].to_numpy()) for c in ("src", "dst"))
        made = kernel(key[0], ids, src, dst, e["weight"].to_numpy(dtype=float))
        if not len(made["graph_id"]):  # as of a graph without paths; an empty list has no type of its own
            return pd.DataFrame(columns=list(made), dtype=object)
        return pd.DataFrame(made)

    # edges often come from the nodes' own plan: new names for its columns keep the two sides apart
    left = nodes.select(F.col("graph_id").alias("graph_id"), "node_id").groupBy("graph_id")
    right = edges.select(F.col("graph_id").alias("graph_id"), "src", "dst", F.col("weight").cast("double").alias("weight")).groupBy("graph_id")
    return left.cogroup(right).applyInPandas(run, schema)


def sized(nodes: DataFrame, edges: DataFrame, whole: int, links: int | None = None) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """(nodes, edges) of graphs of up to ``whole`` nodes and ``links`` edges, and those of larger ones or None where there is none."""
    over = lambda df, most: df.groupBy("graph_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("graph_id")
    large = over(nodes, whole) if links is None else over(nodes, whole).union(over(edges, links)).distinct()
    names = [r[0] for r in large.limit(LARGE_GRAPHS + 1).collect()]
    if not names:
        return (nodes, edges), None
    if len(names) > LARGE_GRAPHS:
        held = stored(large, "large")
        return tuple(x.join(held, "graph_id", "left_anti") for x in (nodes, edges)), tuple(x.join(held, "graph_id", "left_semi") for x in (nodes, edges))
    inside = F.col("graph_id").isin(names)
    return (nodes.filter(~inside), edges.filter(~inside)), (nodes.filter(inside), edges.filter(inside))


def _per_part(nodes: DataFrame, edges: DataFrame, sources: int, kernel, schema: str) -> DataFrame:
    """``kernel(graph_id, ids, links, part, parts)`` for each part of some ``sources`` nodes of each graph; a task has all of its edges."""
    sizes = nodes.groupBy("graph_id").agg(F.ceil(F.count("*") / sources).cast("int").alias("_parts"))
    sizes = sizes.select(F.col("graph_id").alias("_of"), "_parts", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))

    def run(key, n, e):
        import numpy as np
        import pandas as pd

        ids = np.sort(n["node_id"].to_numpy())
        if not len(ids):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        src, dst = (np.searchsorted(ids, e[c].to_numpy()) for c in ("src", "dst"))
        links = sparse.neighbours(len(ids), src, dst, e["weight"].to_numpy(dtype=float))
        return pd.DataFrame(kernel(key[0], ids, links, key[1], int(n["_parts"].iloc[0])))

    def dealt(df: DataFrame, *columns) -> DataFrame:
        held = df.select(F.col("graph_id").alias("graph_id"), *columns)
        met = held.join(sizes, F.col("graph_id") == F.col("_of")).drop("_of")
        return met.select(*[F.col(c).alias(c) for c in met.columns]).groupBy("graph_id", "_part")  # new names, as above

    left = dealt(nodes, F.col("node_id").alias("node_id"))
    right = dealt(edges, *[F.col(c).alias(c) for c in ("src", "dst")], F.col("weight").cast("double").alias("weight"))
    return left.cogroup(right).applyInPandas(run, schema)


def _dealt(nodes: DataFrame, edges: DataFrame, kernel, schema: str, held, large) -> DataFrame:
    """Graphs of up to ``WHOLE`` nodes by ``kernel``, of up to ``sparse.HELD`` by ``held(nodes, edges)``, others by ``large``."""
    few, many = sized(nodes, edges, WHOLE)
    out = _per_graph(*few, kernel, schema)
    if many is None:
        return out
    kinds = [c.split() for c in schema.split(", ")]
    some, huge = sized(*many, sparse.HELD)
    for made in (held(*some), large(*huge) if huge else None):
        out = out if made is None else out.unionByName(made.select(*[F.col(n).cast(t).alias(n) for n, t in kinds]))
    return out


def hop_matrix(n: int, src, dst, sources):
    """Hops from each of ``sources`` to all nodes, -1 if there is no way: frontiers of all sources at once."""
    import numpy as np

    adjacent = np.zeros((n, n), bool)
    adjacent[src, dst] = adjacent[dst, src] = True
    hops = np.full((len(sources), n), -1, np.int64)
    front = np.zeros((len(sources), n), bool)
    front[np.arange(len(sources)), sources] = True
    step, links = 0, adjacent.astype(np.float32)
    while front.any():
        hops[front] = step
        front = ((front.astype(np.float32) @ links) > 0) & (hops < 0)
        step += 1
    return hops


def length_matrix(n: int, src, dst, weight, sources):
    """Least weighted lengths from ``sources``, inf if there is no way: relaxed until nothing changes."""
    import numpy as np

    far = np.full((len(sources), n), np.inf)
    far[np.arange(len(sources)), sources] = 0.0
    a, b, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([weight, weight])
    order = np.argsort(b, kind="stable")
    a, b, w = a[order], b[order], w[order]
    if not len(b):
        return far
    ends, starts = np.unique(b, return_index=True)
    while True:
        best = np.minimum.reduceat(far[:, a] + w, starts, axis=1)
        new = far.copy()
        new[:, ends] = np.minimum(new[:, ends], best)
        if np.array_equal(new, far):
            return far
        far = new


def chosen_sources(ids, graph_id, sample: int | None, seed: int = 42):
    """Row numbers of the nodes that come first by a stable hash of graph, node and seed."""
    import zlib

    import numpy as np

    if sample is None or len(ids) <= sample:
        return np.arange(len(ids))
    keys = [zlib.crc32(f"{graph_id}:{i}:{seed}".encode()) for i in ids.tolist()]
    return np.sort(np.argsort(keys, kind="stable")[:sample])


def path_features(nodes: DataFrame, edges: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Mean hops and diameter of the largest component, from ``sample`` sources or from all."""

    def kernel(g, ids, src, dst, w):
        import numpy as np

        reach = hop_matrix(len(ids), src, dst, np.arange(len(ids))) if sample is None or len(ids) <= 100 else None
        if reach is None:
            label = np.arange(len(ids))
            while True:
                new = label.copy()
                np.minimum.at(new, src, label[dst])
                np.minimum.at(new, dst, label[src])
                if np.array_equal(new, label):
                    break
                label = new
        else:
            label = np.argmax(reach >= 0, axis=0)
        names, sizes = np.unique(label, return_counts=True)
        inside = np.flatnonzero(label == names[np.argmax(sizes)])
        if reach is None:
            picked = inside[chosen_sources(ids[inside], g, sample, seed)]
            h = hop_matrix(len(ids), src, dst, picked)[:, inside]
        else:
            h = reach[np.ix_(inside, inside)]
        h = h[h > 0]
        return {"graph_id": [g], "path_mean": [float(h.mean()) if len(h) else 0.0], "diameter": [int(h.max()) if len(h) else 0]}

    def part_of(g, ids, links, part, parts):
        import numpy as np

        starts, ends, col, _ = links
        label = sparse.components(len(ids), np.repeat(np.arange(len(ids)), ends - starts), col)
        names, sizes = np.unique(label, return_counts=True)
        inside = np.flatnonzero(label == names[np.argmax(sizes)])
        picked = inside[chosen_sources(ids[inside], g, sample, seed)][part::parts]
        n = sparse.hop_counts(len(ids), links, picked)
        return {"graph_id": [g], "pairs": [int(n.sum())], "hops": [int((n * np.arange(len(n))).sum())], "most": [max(len(n) - 1, 0)]}

    def held(n, e):
        found = _per_part(n, e, sparse.BITS, part_of, "graph_id string, pairs long, hops long, most long").groupBy("graph_id")
        return found.agg(F.coalesce(F.try_divide(F.sum("hops"), F.sum("pairs")), F.lit(0.0)).alias("path_mean"), F.max("most").alias("diameter"))

    return _dealt(nodes, edges, kernel, "graph_id string, path_mean double, diameter long", held, lambda n, e: frontier.path_features(n, e, sample, seed))


def weighted_path_mean(nodes: DataFrame, edges: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Mean weighted length from all nodes, or from up to ``sample`` of them, to every other node they reach."""

    def kernel(g, ids, src, dst, w):
        total, many = sparse.length_sums(len(ids), sparse.neighbours(len(ids), src, dst, w), chosen_sources(ids, g, sample, seed))
        return {"graph_id": [g], "weighted_path_mean": [total / many if many else None]}

    def part_of(g, ids, links, part, parts):
        total, many = sparse.length_sums(len(ids), links, chosen_sources(ids, g, sample, seed), part, parts)
        return {"graph_id": [g], "total": [total], "many": [many]}

    def held(n, e):
        found = _per_part(n, e, WHOLE, part_of, "graph_id string, total double, many long").groupBy("graph_id")
        return found.agg(F.try_divide(F.sum("total"), F.sum("many")).alias("weighted_path_mean"))

    return _dealt(nodes, edges, kernel, "graph_id string, weighted_path_mean double", held, lambda n, e: frontier.weighted_path_mean(n, e, sample, seed))


def hop_lengths(nodes: DataFrame, edges: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """graph_id, value, n: how many pairs are how many hops apart, unreachable ones left out; from all nodes or ``sample`` of them."""

    def counted(g, n):
        import numpy as np

        value = np.flatnonzero(n)
        return {"graph_id": np.full(len(value), g, object), "value": value.astype(float), "n": n[value]}

    def kernel(g, ids, src, dst, w):
        return counted(g, sparse.hop_counts(len(ids), sparse.neighbours(len(ids), src, dst), chosen_sources(ids, g, sample, seed)))

    def part_of(g, ids, links, part, parts):
        return counted(g, sparse.hop_counts(len(ids), links, chosen_sources(ids, g, sample, seed)[part::parts]))

    def held(n, e):
        found = _per_part(n, e, sparse.BITS, part_of, "graph_id string, value double, n long")
        return found.groupBy("graph_id", "value").agg(F.sum("n").alias("n"))

    return _dealt(nodes, edges, kernel, "graph_id string, value double, n long", held, lambda n, e: frontier.hop_lengths(n, e, sample, seed))


def distance_matrices(nodes: DataFrame, edges: DataFrame, weighted: bool = True, shortest: bool = True) -> DataFrame:
    """graph_id, ids, matrix of least lengths or hops, or of edge weights; inf where there is none."""

    def kernel(g, ids, src, dst, w):
        import numpy as np

        every = np.arange(len(ids))
        if shortest and weighted:
            d = length_matrix(len(ids), src, dst, w, every)
        elif shortest:
            d = hop_matrix(len(ids), src, dst, every).astype(float)
            d[d < 0] = np.inf
        else:
            d = np.full((len(ids), len(ids)), np.inf)
            d[src, dst] = d[dst, src] = w if weighted else 1.0
            np.fill_diagonal(d, 0.0)
        return {"graph_id": [g], "ids": [ids.tolist()], "matrix": [d.tolist()]}

    return _per_graph(nodes, edges, kernel, "graph_id string, ids array<bigint>, matrix array<array<double>>")


def distance_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, lengths: the rows of each graph's matrix of least lengths, a row a node, its cells in the order of the ids.

    A task has the edges of one graph, once, and some ``DEALT`` of its sources, and gives ``ROWS`` rows at a time, so neither a
    matrix nor the rows of a task are held; the result is as large as all matrices.
    """

    def packed(g, ids, src, dst, w):
        return {"graph_id": [g], "ids": [ids], "src": [src], "dst": [dst], "weight": [w]}

    schema = "graph_id string, ids array<bigint>, src array<bigint>, dst array<bigint>, weight array<double>"
    graphs = stored(_per_graph(nodes, edges, packed, schema), "graphs")
    parts = F.ceil(F.size("ids") / DEALT).cast("int")
    tasks = graphs.agg(F.sum(parts)).first()[0] or 1
    dealt = graphs.select("*", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).repartition(min(tasks, PART_TASKS))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                one = {c: batch.column(c)[at] for c in batch.schema.names}
                ids, src, dst, w = (one[c].values.to_numpy(zero_copy_only=False) for c in ("ids", "src", "dst", "weight"))
                n, links = len(ids), sparse.neighbours(len(ids), src, dst, w)
                for some, inside, far in sparse.near_lengths(n, links, np.arange(n), one["part"].as_py(), one["parts"].as_py()):
                    for i in range(0, len(some), ROWS):
                        few = some[i : i + ROWS]
                        rows = np.full((len(few), n), np.inf)
                        rows[:, inside] = far[:, i : i + ROWS].T
                        lengths = pa.ListArray.from_arrays(np.arange(len(few) + 1, dtype=np.int32) * n, pa.array(rows.ravel()))
                        made = [pa.array([one["graph_id"].as_py()] * len(few), pa.string()), pa.array(ids[few]), lengths]
                        yield pa.RecordBatch.from_arrays(made, names=["graph_id", "node_id", "lengths"])

    return dealt.mapInArrow(run, "graph_id string, node_id long, lengths array<double>")


def _dependencies(n: int, src, dst, sources):
    """Pair dependencies summed over ``sources`` (Brandes' accumulation, level by level as matrix products)."""
    import numpy as np

    links = np.zeros((n, n))
    links[src, dst] = links[dst, src] = 1.0
    hops = hop_matrix(n, src, dst, sources)
    ways = np.zeros((len(sources), n))
    ways[np.arange(len(sources)), sources] = 1.0
    for level in range(1, int(hops.max(initial=0)) + 1):
        ways += np.where(hops == level, np.where(hops == level - 1, ways, 0.0) @ links, 0.0)
    depend = np.zeros_like(ways)
    for level in range(int(hops.max(initial=0)), 0, -1):
        share = np.where(hops == level, (1.0 + depend) / np.where(ways > 0, ways, 1.0), 0.0) @ links
        depend += np.where(hops == level - 1, ways * share, 0.0)
    depend[np.arange(len(sources)), sources] = 0.0
    return depend.sum(axis=0), hops


def betweenness(nodes: DataFrame, edges: DataFrame, sample: int | None = 100, seed: int = 42) -> DataFrame:
    """graph_id, node_id, betweenness: share of shortest paths through a node, from a sample of sources if large."""

    def kernel(g, ids, src, dst, w):
        n = len(ids)
        picked = chosen_sources(ids, g, sample, seed)
        total, _ = _dependencies(n, src, dst, picked)
        scale = n / len(picked) / ((n - 1) * (n - 2)) if n > 2 else 0.0
        return {"graph_id": [g] * n, "node_id": ids, "betweenness": total * scale}

    held = lambda n, e: _betweenness_by_parts(n, e, sample, seed)
    return _dealt(nodes, edges, kernel, "graph_id string, node_id long, betweenness double", held, lambda n, e: frontier.betweenness(n, e, sample, seed))


def _betweenness_by_parts(nodes: DataFrame, edges: DataFrame, sample: int | None, seed: int) -> DataFrame:
    def part_of(g, ids, links, part, parts):
        n, picked = len(ids), chosen_sources(ids, g, sample, seed)
        scale = n / len(picked) / ((n - 1) * (n - 2)) if n > 2 else 0.0
        return {"graph_id": [g] * n, "node_id": ids, "betweenness": sparse.dependencies(n, links, picked[part::parts]) * scale}

    found = _per_part(nodes, edges, sparse.BITS, part_of, "graph_id string, node_id long, betweenness double")
    return found.groupBy("graph_id", "node_id").agg(F.sum("betweenness").alias("betweenness"))


def _closeness_by_parts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node_id, closeness: every node is a source."""

    def part_of(g, ids, links, part, parts):
        import numpy as np

        near, total = sparse.hop_sums(len(ids), links, np.arange(len(ids))[part::parts])
        return {"graph_id": [g] * len(ids), "node_id": ids, "near": near, "total": total, "n": [len(ids)] * len(ids)}

    found = _per_part(nodes, edges, sparse.BITS, part_of, "graph_id string, node_id long, near long, total long, n long").groupBy("graph_id", "node_id", "n")
    sums = found.agg(F.sum("near").alias("near"), F.sum("total").alias("total"))
    value = F.try_divide(F.col("near"), F.col("total")) * F.col("near") / F.greatest(F.col("n") - 1, F.lit(1))
    return sums.select("graph_id", "node_id", F.coalesce(value, F.lit(0.0)).alias("closeness"))


def centrality_features(nodes: DataFrame, edges: DataFrame, sample: int = 100, seed: int = 42) -> DataFrame:
    """Mean and maximum of betweenness, and of closeness within what a node reaches."""

    def kernel(g, ids, src, dst, w):
        import numpy as np

        n = len(ids)
        picked = chosen_sources(ids, g, sample, seed)
        total, _ = _dependencies(n, src, dst, picked)
        between = total * (n / len(picked) / ((n - 1) * (n - 2)) if n > 2 else 0.0)
        hops = hop_matrix(n, src, dst, np.arange(n))
        near, sums = (hops > 0).sum(axis=1), np.where(hops > 0, hops, 0).sum(axis=1)
        close = np.where(sums > 0, near / np.maximum(sums, 1) * near / max(n - 1, 1), 0.0)
        values = {"betweenness_mean": between.mean(), "betweenness_max": between.max(), "closeness_mean": close.mean(), "closeness_max": close.max()}
        return {"graph_id": [g], **{k: [float(v)] for k, v in values.items()}}

    schema = "graph_id string, betweenness_mean double, betweenness_max double, closeness_mean double, closeness_max double"
    def held(n, e):
        both = [f.groupBy("graph_id").agg(F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max")) for c, f in (
            ("betweenness", _betweenness_by_parts(n, e, sample, seed)), ("closeness", _closeness_by_parts(n, e)),
        )]
        return both[0].join(both[1], "graph_id")

    return _dealt(nodes, edges, kernel, schema, held, lambda n, e: frontier.centrality_features(n, e, sample, seed))
