"""Spectra of graphs and operators: a small kernel a graph, everything after it as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators import krylov, sparse
from skyloom.operators.paths import _per_graph, sized
from skyloom.staging import freed, stored

#: Nodes of a graph whose matrix a task holds; of up to ``sparse.HELD`` it holds the edges, and larger ones go by distributed iteration.
WHOLE = 4000


def _matrix(n, src, dst, w, kind: str):
    import numpy as np

    a = np.zeros((n, n))
    np.add.at(a, (src, dst), w)
    np.add.at(a, (dst, src), w)
    if kind == "adjacency":
        return a
    d = a.sum(axis=1)
    if kind == "laplacian":
        return np.diag(d) - a
    root = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1.0)), 0.0)
    return np.diag((d > 0).astype(float)) - root[:, None] * a * root[None, :]


def spectrum(nodes: DataFrame, edges: DataFrame, k: int | None = 30, kind: str = "normalized", weighted: bool = True, largest: bool = False, affinity: float | None = None) -> DataFrame:
    """graph_id, eig: the ``k`` smallest eigenvalues ascending, or the largest by magnitude descending.

    kind: normalized (I - D^-1/2 A D^-1/2, an isolated node's row is 0), laplacian or adjacency. Weights are taken as
    they are; with ``affinity`` s they become exp(-(w/s)^2), so that far neighbours count less. Graphs of more than
    ``WHOLE`` nodes go by ``sparse.spectrum``, those of more than ``sparse.HELD`` by their components, of which larger ones go by
    ``krylov.lanczos``; these find some eigenvalues, so ``k`` is a must for them. What does not settle is an ArithmeticError.
    """
    few, many = (nodes, edges), None
    if k is not None:
        few, many = sized(nodes, edges, sparse.HELD)

    def weighed(g, ids, src, dst, w):
        import numpy as np

        if k is not None and len(ids) > WHOLE:
            return {"graph_id": [g], "eig": [sparse.spectrum(len(ids), src, dst, w, kind, k, largest).tolist()]}
        e = np.linalg.eigvalsh(_matrix(len(ids), src, dst, w, kind))
        e = e[np.argsort(-np.abs(e), kind="stable")] if largest else e
        return {"graph_id": [g], "eig": [e[:k].tolist()]}

    def kernel(g, ids, src, dst, w):
        import numpy as np

        return weighed(g, ids, src, dst, np.exp(-((w / affinity) ** 2)) if affinity else w if weighted else np.ones_like(w))

    small = _per_graph(*few, kernel, "graph_id string, eig array<double>")
    if many is None:
        return small
    w = F.col("weight").cast("double")
    w = F.exp(-F.pow(w / affinity, F.lit(2))) if affinity else w if weighted else F.lit(1.0)
    united = _united(many[0], many[1].select("graph_id", "src", "dst", w.alias("weight")), k, kind, largest, weighed)
    return small.unionByName(united)


def _united(nodes: DataFrame, edges: DataFrame, k: int, kind: str, largest: bool, kernel) -> DataFrame:
    """``spectrum`` of graphs larger than a task, from those of their components: an eigenvalue of many comes as often as it should.

    Components of up to ``sparse.HELD`` nodes are dealt to tasks of about as many and go by ``kernel``, each larger one by
    ``krylov.lanczos``. ArithmeticError where one of those does not settle.
    """
    from skyloom.operators.graphs import connected_components

    edges = edges.filter(~F.col("weight").eqNullSafe(F.lit(0.0)))
    found = stored(connected_components(nodes, edges), "components")
    sizes = found.groupBy("graph_id", "component").agg(F.count("*").alias("_n"))
    large = F.col("_n") > sparse.HELD
    tasks = sizes.groupBy("graph_id").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.when(large, 0).otherwise(F.col("_n"))) / sparse.HELD)).alias("_tasks"))
    part = F.when(large, F.col("component").cast("string")).otherwise(F.pmod(F.xxhash64("component"), F.col("_tasks")).cast("string"))
    name = F.to_json(F.array(F.col("graph_id").cast("string"), part))
    placed = found.join(sizes.join(tasks, "graph_id"), ["graph_id", "component"]).select("graph_id", "node_id", large.alias("_large"), name.alias("_part"))
    placed = stored(placed, "parts")
    freed(found)
    # new names for the columns of both sides, as edges may come from the nodes' own plan
    ends = placed.select(F.col("graph_id").alias("_of"), F.col("node_id").alias("_at"), "_large", "_part")
    linked = edges.join(ends, (F.col("graph_id") == F.col("_of")) & (F.col("src") == F.col("_at"))).select("_large", F.col("_part").alias("graph_id"), "src", "dst", "weight")
    linked, held = stored(linked, "edges"), placed.select("_large", F.col("_part").alias("graph_id"), "node_id")
    (own, between), (over, links) = ([df.filter(c).drop("_large") for df in (held, linked)] for c in ("not _large", "_large"))
    spectra = _per_graph(own, between, kernel, "graph_id string, eig array<double>")
    if over.take(1):
        spectra = spectra.unionByName(krylov.lanczos(over, krylov.operator_entries(over, links, kind), k, largest, strict=True).select("graph_id", "eig"))
    every = spectra.groupBy(F.get(F.from_json("graph_id", "array<string>"), F.lit(0)).alias("graph_id")).agg(F.flatten(F.collect_list("eig")).alias("eig"))
    first = F.transform("eig", lambda x: F.struct((-F.abs(x) if largest else x).alias("by"), x.alias("x")))
    return every.select("graph_id", F.slice(F.transform(F.sort_array(first), lambda s: s["x"]), 1, k).alias("eig"))


def positional_encoding(nodes: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """graph_id, pe: mean magnitude of each of the ``k`` first eigenvectors after the constant one.

    Graphs of more than ``WHOLE`` nodes go by ``sparse.spectrum``, those of more than ``sparse.HELD`` by ``krylov.lanczos``.
    Vectors of an eigenvalue that comes more than once are not unique, so neither are their means.
    """
    few, many = sized(nodes, edges, sparse.HELD)

    def kernel(g, ids, src, dst, w):
        import numpy as np

        if len(ids) > WHOLE:
            m = sparse.spectrum(len(ids), src, dst, np.ones_like(w), "normalized", k + 1, vectors=True)[1][1:] / len(ids)
            return {"graph_id": [g], "pe": [m.tolist()]}
        _, v = np.linalg.eigh(_matrix(len(ids), src, dst, np.ones_like(w), "normalized"))
        m = np.abs(v[:, 1 : k + 1]).mean(axis=0)
        return {"graph_id": [g], "pe": [np.pad(m, (0, k - len(m))).tolist()]}

    small = _per_graph(*few, kernel, "graph_id string, pe array<double>")
    if many is None:
        return small
    found = krylov.lanczos(many[0], krylov.operator_entries(many[0], many[1].withColumn("weight", F.lit(1.0)), "normalized"), k + 1, powers=(1,))
    mean = F.slice(F.transform("power_1", lambda x: x / F.col("n")), 2, k)
    padded = F.slice(F.concat(mean, F.array_repeat(F.lit(0.0), k)), 1, k)
    return small.unionByName(found.select(F.col("graph_id").cast("string").alias("graph_id"), padded.alias("pe")))


def matrix_spectrum(matrix: DataFrame, k: int = 8) -> DataFrame:
    """graph_id, eig, ipr of the ``k`` lowest states of symmetric matrices (graph_id, i, j, value), each cell once.

    The inverse participation ratio is the sum of the fourth powers of a normalized state's components. Matrices of more
    than ``WHOLE`` rows go by ``krylov.lanczos``.
    """
    ends = matrix.select("graph_id", F.explode(F.array("i", "j")).alias("node_id")).distinct()
    rows, many = sized(ends, matrix, WHOLE)
    if many is not None:
        found = krylov.lanczos(many[0], many[1].select("graph_id", "i", "j", "value"), k, powers=(4,))
        small = matrix_spectrum(rows[1], k)
        return small.unionByName(found.select(F.col("graph_id").cast("string").alias("graph_id"), "eig", F.col("power_4").alias("ipr")))

    def run(pdf):
        import numpy as np
        import pandas as pd

        ids = np.unique(np.concatenate([pdf["i"], pdf["j"]]))
        h = np.zeros((len(ids), len(ids)))
        h[np.searchsorted(ids, pdf["i"]), np.searchsorted(ids, pdf["j"])] = pdf["value"]
        e, v = np.linalg.eigh(h)
        v = v[:, :k] / np.linalg.norm(v[:, :k], axis=0)
        return pd.DataFrame({"graph_id": [pdf["graph_id"].iloc[0]], "eig": [e[:k].tolist()], "ipr": [(v**4).sum(axis=0).tolist()]})

    return matrix.select("graph_id", "i", "j", "value").groupBy("graph_id").applyInPandas(run, "graph_id string, eig array<double>, ipr array<double>")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def spectral_features(spectra: DataFrame, eig: str = "eig", bins: float = 1e-10) -> DataFrame:
    """Gap, algebraic connectivity, mean, std, min, max, median, entropy, skewness, kurtosis and trace of each spectrum.

    The gap is null with fewer than two eigenvalues. Entropy is over magnitudes as shares.
    """
    e = F.col(eig)
    n = F.size(e)
    out = spectra.withColumn("_n", n).withColumns({"spectral_mean": F.try_divide(_total(e), n), "trace": _total(e)})
    mean = F.col("spectral_mean")

    def moment(p: int) -> Column:
        return F.try_divide(_total(F.transform(e, lambda x: F.pow(x - mean, F.lit(p)))), n)

    s = F.sort_array(e)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    out = out.withColumns({
        "spectral_std": F.sqrt(moment(2)), "spectral_min": F.array_min(e), "spectral_max": F.array_max(e), "spectral_median": middle,
        "spectral_gap": F.get(s, F.lit(1)) - F.get(s, F.lit(0)), "algebraic_connectivity": F.get(s, F.lit(1)),
        "_weight": _total(F.transform(e, lambda x: F.abs(x) + bins)),
    })
    share = lambda x: (F.abs(x) + bins) / F.col("_weight")
    std = F.col("spectral_std")
    return out.withColumns({
        "spectral_entropy": -_total(F.transform(e, lambda x: share(x) * F.log(share(x) + bins))),
        "spectral_skewness": moment(3) / (F.pow(std, F.lit(3)) + bins), "spectral_kurtosis": moment(4) / (F.pow(std, F.lit(4)) + bins),
    }).drop("_n", "_weight")


def expand(df: DataFrame, array: str, k: int, prefix: str) -> DataFrame:
    """``prefix_0`` .. ``prefix_{k-1}``, null beyond the array's end."""
    return df.withColumns({f"{prefix}_{i}": F.get(array, F.lit(i)) for i in range(k)}).drop(array)


def state_features(states: DataFrame) -> DataFrame:
    """Mean and population std of the lowest eigenvalues and their participation ratios."""
    out = states
    for c in ("eig", "ipr"):
        n, mean = F.size(c), F.try_divide(_total(F.col(c)), F.size(c))
        out = out.withColumn(f"{c}_mean", mean)
        square = F.try_divide(_total(F.transform(c, lambda x: x * x)), n)
        out = out.withColumn(f"{c}_std", F.sqrt(F.greatest(F.lit(0.0), square - F.pow(F.col(f"{c}_mean"), F.lit(2)))))
    return out.drop("eig", "ipr")
