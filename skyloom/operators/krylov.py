"""Eigenvalues of graphs larger than a task: block Lanczos whose products, sums and vectors are distributed.

Nodes are numbered and dealt into blocks; a block of vectors is a row with an array of numbers for each node of it. Edges
between two blocks are rows of arrays. What reaches the driver are matrices as wide as the basis is long.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.staging import freed, running_sum, stored

#: Nodes of a block, and edges of a row at most.
BLOCK, EDGES = 4096, 1 << 16
#: Vectors of a block step: eigenvalues are found with up to this multiplicity before the whole space is spanned.
WIDTH = 4


@dataclass
class _Graph:
    """What the driver keeps of a graph: its size, the operator's matrix in the basis so far, which vectors are not zero."""

    n: int
    h: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    live: list[np.ndarray] = field(default_factory=list)
    eig: np.ndarray | None = None
    states: np.ndarray | None = None
    residual: float = np.inf
    done: bool = False

    @property
    def spanned(self) -> int:
        return int(sum(x.sum() for x in self.live))


def operator_entries(nodes: DataFrame, edges: DataFrame, kind: str = "normalized") -> DataFrame:
    """``(graph_id, i, j, value)``: both triangles and the diagonal of a graph's adjacency, Laplacian or normalized Laplacian.

    Parallel edges add up, and a self loop counts twice, as both of its ends. The row of a node without weight is zero.
    """
    both = edges.select("graph_id", F.explode(F.array(
        F.struct(F.col("src").alias("i"), F.col("dst").alias("j")), F.struct(F.col("dst").alias("i"), F.col("src").alias("j"))
    )).alias("e"), F.col("weight").cast("double").alias("w")).select("graph_id", "e.i", "e.j", "w")
    both = both.groupBy("graph_id", "i", "j").agg(F.sum("w").alias("w"))
    if kind == "adjacency":
        return both.withColumnRenamed("w", "value")
    degree = stored(both.groupBy("graph_id", "i").agg(F.sum("w").alias("d")), "degree")
    if kind == "laplacian":
        diagonal = degree.select("graph_id", "i", F.col("i").alias("j"), F.col("d").alias("value"))
        return diagonal.unionByName(both.select("graph_id", "i", "j", (-F.col("w")).alias("value")))
    root = degree.select("graph_id", "i", F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(0.0).alias("root"))
    scaled = both.join(root, ["graph_id", "i"]).join(root.select("graph_id", F.col("i").alias("j"), F.col("root").alias("other")), ["graph_id", "j"])
    diagonal = root.filter("root > 0").select("graph_id", "i", F.col("i").alias("j"), F.lit(1.0).alias("value"))
    return diagonal.unionByName(scaled.select("graph_id", "i", "j", (-F.col("root") * F.col("w") * F.col("other")).alias("value")))


def _blocked(nodes: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered nodes, their blocks ``(graph_id, blk, n, at)``, and entries ``(graph_id, rb, cb, i, j, value)`` as arrays by blocks."""
    numbered = stored(running_sum(nodes.select("graph_id", "node_id").distinct(), ["graph_id", "node_id"], F.lit(1), "at"), "numbered")
    place = lambda c, b, i: numbered.select("graph_id", F.col("node_id").alias(c), F.floor(F.col("at") / BLOCK).alias(b), (F.col("at") % BLOCK).cast("int").alias(i))
    blocks = stored(numbered.groupBy("graph_id", F.floor(F.col("at") / BLOCK).alias("blk")).agg(F.count("*").alias("n"), F.collect_list((F.col("at") % BLOCK).cast("int")).alias("at")), "blocks")
    placed = entries.join(place("i", "rb", "ii"), ["graph_id", "i"]).join(place("j", "cb", "jj"), ["graph_id", "j"])
    pairs = ["graph_id", "rb", "cb"]
    placed = stored(placed.select(*pairs, "ii", "jj", "value"), "placed")
    parts = placed.groupBy(*pairs).agg(F.ceil(F.count("*") / EDGES).alias("_parts"))
    salted = placed.join(parts, pairs).withColumn("_s", F.pmod(F.xxhash64("ii", "jj"), F.col("_parts")))
    rows = salted.groupBy(*pairs, "_s").agg(F.collect_list(F.struct("ii", "jj", "value")).alias("e"))
    rows = stored(rows.select(*pairs, F.col("e.ii").alias("i"), F.col("e.jj").alias("j"), F.col("e.value").alias("value")), "entries")
    freed(placed)
    return numbered, blocks, rows


def _split(x: np.ndarray) -> list[float]:
    return x.ravel().tolist()


def _product(entries: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """``(graph_id, blk, x)``: the operator times a block of vectors; each row of entries gives a partial sum of its row block."""

    def part(frames):
        for f in frames:
            sums: dict = {}
            for r in f.itertuples(index=False):
                x = np.asarray(r.x).reshape(-1, width)
                y = sums.setdefault((r.graph_id, r.rb), np.zeros((BLOCK, width)))
                i, scaled = np.asarray(r.i), np.asarray(r.value)[:, None] * x[np.asarray(r.j)]
                for c in range(width):
                    y[:, c] += np.bincount(i, scaled[:, c], minlength=BLOCK)
            yield pd.DataFrame([(g, b, _split(y)) for (g, b), y in sums.items()], columns=["graph_id", "blk", "x"])

    def total(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"graph_id": f["graph_id"].iloc[:1], "blk": f["blk"].iloc[:1], "x": [np.sum([np.asarray(x) for x in f["x"]], axis=0).tolist()]})

    met = entries.join(vectors.select("graph_id", F.col("blk").alias("cb"), "x"), ["graph_id", "cb"]).select("graph_id", "rb", "i", "j", "value", "x")
    schema = f"graph_id {dict(vectors.dtypes)['graph_id']}, blk long, x array<double>"
    return met.mapInPandas(part, schema).groupBy("graph_id", "blk").applyInPandas(total, schema)


def _reduced(basis: list[DataFrame], blocks: DataFrame, w: DataFrame, width: int, change: dict | None) -> DataFrame:
    """Rows ``(graph_id, blk, x, dots)``: ``w``, first made less by ``change`` of the basis, and its products with all of it.

    ``change[graph]`` is the coefficients to take off (basis x width), and what the rest is multiplied by (width x width).
    ``dots`` is the block's share of the products of the basis and of the rest itself with the rest.
    """
    part = lambda df, k, x: df.select("graph_id", "blk", F.lit(k).alias("k"), x.alias("x"))
    every = part(blocks, -2, F.lit(None).cast("array<double>")).unionByName(part(w, -1, F.col("x")))
    for k, q in enumerate(basis):
        every = every.unionByName(part(q, k, F.col("x")))
    sent = w.sparkSession.sparkContext.broadcast(change)
    length = len(basis)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        graph, blk = f["graph_id"].iloc[0], f["blk"].iloc[0]
        by = {k: np.asarray(x).reshape(-1, width) for k, x in zip(f["k"], f["x"]) if k != -2}
        x = by.get(-1, np.zeros((BLOCK, width)))
        q = np.hstack([by[k] for k in range(length)]) if length else np.zeros((BLOCK, 0))
        if sent.value is not None:
            less, factor = sent.value[graph]
            x = (x - q @ less) @ factor
        dots = np.vstack([q.T @ x, x.T @ x])
        return pd.DataFrame({"graph_id": [graph], "blk": [blk], "x": [_split(x)], "dots": [_split(dots)]})

    schema = f"graph_id {dict(w.dtypes)['graph_id']}, blk long, x array<double>, dots array<double>"
    return every.groupBy("graph_id", "blk").applyInPandas(run, schema)


def _dots(rows: DataFrame, width: int) -> dict[object, tuple[np.ndarray, np.ndarray]]:
    """Products of the basis with the vectors, and of the vectors with each other, by graph."""
    sums = rows.select("graph_id", F.posexplode("dots").alias("at", "d")).groupBy("graph_id", "at").agg(F.sum("d").alias("d"))
    got: dict = {}
    for r in sums.collect():
        got.setdefault(r["graph_id"], {})[r["at"]] = r["d"]
    out = {}
    for g, v in got.items():
        m = np.array([v[i] for i in range(len(v))]).reshape(-1, width)
        out[g] = (m[:-width], m[-width:])
    return out


def _orthonormal(gram: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """What makes vectors of these products orthonormal, and which are left; directions of no length become zero."""
    e, v = np.linalg.eigh((gram + gram.T) / 2)
    kept = (e > max(scale, 1e-150) ** 2 * 1e-20) & (e > e.max() * 1e-12)  # products have no more digits
    factor = np.zeros_like(gram)
    factor[:, kept] = v[:, kept] / np.sqrt(e[kept])
    return factor, kept


def eigenvalues_schema(kind: str, powers: tuple[int, ...]) -> str:
    return f"graph_id {kind}, n long, eig array<double>, residual double" + "".join(f", power_{p} array<double>" for p in powers)


def lanczos(nodes: DataFrame, entries: DataFrame, k: int = 30, largest: bool = False, most: int = 400, tolerance: float = 1e-9, width: int = WIDTH, seed: int = 42, powers: tuple[int, ...] = (), strict: bool = False) -> DataFrame:
    """graph_id, n, eig, residual: the ``k`` smallest eigenvalues ascending of symmetric ``entries``, or the largest by magnitude.

    For each p of ``powers`` also ``power_p``: the sums of the p-th powers of the magnitudes of each eigenvector's components.

    Block Lanczos with full reorthogonalisation, made twice. It ends when the wanted residuals are below ``tolerance`` times
    the largest eigenvalue, when the basis spans the space, or at ``most`` basis vectors; ``residual`` is the largest
    one left, so a result that has not settled says so; with ``strict`` it is an ArithmeticError instead. An eigenvalue of higher multiplicity than ``width`` may come
    fewer times than it should unless the space is spanned. All graphs go on together; a step is a few jobs.
    A node without entries has a zero row; a graph of no nodes has no row.
    """
    numbered, blocks, entries = _blocked(nodes, entries)
    kind = dict(blocks.dtypes)["graph_id"]
    graphs, basis = _spanned(blocks, lambda v: _product(entries, v, width), k, largest, most, tolerance, width, seed)
    left = {g: held.residual for g, held in graphs.items() if not held.done}
    if strict and left:
        freed(numbered, entries, *basis)
        raise ArithmeticError(f"{most} vectors leave {len(left)} graphs that have not settled, as {min(left, key=str)} with a residual of {left[min(left, key=str)]:.1e}")
    sums = _powers(basis, graphs, width, powers) if powers and graphs else {}
    freed(numbered, entries, *basis)
    rows = []
    for g, held in graphs.items():
        more = [sums[g][p].tolist() for p in powers]
        rows.append((g, held.n, [float(x) for x in held.eig], 0.0 if held.spanned >= held.n else held.residual, *more))
    return nodes.sparkSession.createDataFrame(rows, eigenvalues_schema(kind, powers))


def principal_components(nodes: DataFrame, entries: DataFrame, k: int, most: int = 400, tolerance: float = 1e-10, width: int = WIDTH, seed: int = 42) -> DataFrame:
    """graph_id, node_id, embedding: the first ``k`` principal components of the rows of ``entries`` (i, j, value), less its column means.

    Taking off column means is a projection away from the constant vector, so components are eigenvectors of H C C' H with H
    that projection: the constant vector is held out of the basis, and C' and C are applied one after the other. No
    array is as long as two sides of the matrix. The largest entry of a component is made positive; graphs of
    fewer than ``k`` nodes are padded with zeros. Components past those that ``most`` basis vectors settle are approximate.
    """
    numbered, blocks, forward = _blocked(nodes, entries)
    second, third, back = _blocked(nodes, entries.select("graph_id", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    freed(second, third)
    kind = dict(blocks.dtypes)["graph_id"]

    def ones(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                x = np.zeros((BLOCK, width))
                x[np.asarray(r.at), 0] = 1 / np.sqrt(r.total)
                out.append((r.graph_id, r.blk, _split(x)))
            yield pd.DataFrame(out, columns=["graph_id", "blk", "x"])

    totals = blocks.groupBy("graph_id").agg(F.sum("n").alias("total"))
    held_out = stored(blocks.join(totals, "graph_id").select("graph_id", "blk", "at", "total").mapInPandas(ones, f"graph_id {kind}, blk long, x array<double>"), "ones")

    def apply(v: DataFrame) -> DataFrame:
        middle = stored(_product(back, v, width), "product")
        out = stored(_product(forward, middle, width), "product")
        freed(middle)
        return out

    graphs, basis = _spanned(blocks, apply, k, True, most, tolerance, width, seed, held_out)
    freed(held_out, forward, back)
    made = _vectors(basis, blocks, {g: held.states * np.sqrt(np.maximum(held.eig, 0)) for g, held in graphs.items()}, width, k)
    out = numbered.join(made, [numbered["graph_id"] == made["_of"], F.floor(F.col("at") / BLOCK) == F.col("_blk"), F.col("at") % BLOCK == F.col("_at")])
    return out.select("graph_id", "node_id", "embedding")


def _vectors(basis: list[DataFrame], blocks: DataFrame, states: dict, width: int, k: int) -> DataFrame:
    """``(_of, _blk, _at, embedding)``: the basis times ``states``, each column with its largest entry positive, ``k`` wide."""
    part = lambda df, n, x: df.select("graph_id", "blk", F.lit(n).alias("k"), x.alias("x"))
    every = part(blocks.withColumn("at", F.col("at").cast("array<double>")), -1, F.col("at"))
    for n, q in enumerate(basis):
        every = every.unionByName(part(q, n, F.col("x")))
    sent = every.sparkSession.sparkContext.broadcast(states)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        graph, blk = f["graph_id"].iloc[0], f["blk"].iloc[0]
        s, v = sent.value[graph], 0.0
        at = np.sort(np.asarray(next(x for n, x in zip(f["k"], f["x"]) if n < 0)).astype(int))
        for n, x in zip(f["k"], f["x"]):
            if 0 <= n and n * width < len(s):
                v = v + np.asarray(x).reshape(-1, width)[at] @ s[n * width : (n + 1) * width]
        v = np.zeros((len(at), s.shape[1])) + v
        return pd.DataFrame({"_of": graph, "_blk": blk, "_at": at.astype("int32"), "embedding": np.pad(v, ((0, 0), (0, k - v.shape[1]))).tolist()})

    schema = f"_of {dict(blocks.dtypes)['graph_id']}, _blk long, _at int, embedding array<double>"
    made = stored(every.groupBy("graph_id", "blk").applyInPandas(run, schema), "vectors")
    cells = made.select("_of", "_blk", "_at", F.posexplode("embedding").alias("i", "v"))
    first = F.max_by(F.signum("v"), F.struct(F.round(F.abs("v"), 9).alias("v"), (-F.col("_blk")).alias("b"), (-F.col("_at")).alias("a")))
    signs = cells.groupBy("_of", "i").agg(first.alias("s")).groupBy(F.col("_of").alias("_same")).agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s"))
    turned = F.zip_with("embedding", "s", lambda x, s: F.when(s["s"] < 0, -x).otherwise(x))
    return made.join(signs, made["_of"] == signs["_same"]).select("_of", "_blk", "_at", turned.alias("embedding"))


def _spanned(blocks: DataFrame, product, k: int, largest: bool, most: int, tolerance: float, width: int, seed: int, held_out: DataFrame | None = None) -> tuple[dict, list[DataFrame]]:
    """What ``lanczos`` finds by graph, and the basis; ``held_out`` is a block of vectors that the basis stays orthogonal to.

    Of a block that is held out the first vector alone may be other than zero.
    """
    spark = blocks.sparkSession
    graphs = {r[0]: _Graph(r[1] - (held_out is not None)) for r in blocks.groupBy("graph_id").agg(F.sum("n")).collect()}
    kind = dict(blocks.dtypes)["graph_id"]
    if not graphs:
        return {}, []
    away = [] if held_out is None else [held_out]

    schema = f"graph_id {kind}, blk long, x array<double>"

    def with_random(vectors: DataFrame | None, step: int) -> DataFrame:
        """``vectors`` with random ones in place of those that are zero, in graphs that the basis does not span yet."""
        fill = {g: ~held.live[-1] if vectors is not None else np.ones(width, bool) for g, held in graphs.items() if held.spanned < held.n}
        sent = spark.sparkContext.broadcast(fill)
        held = blocks.select("graph_id", "blk", "at", *([F.lit(None).cast("array<double>").alias("x")] if vectors is None else []))
        held = held if vectors is None else held.join(vectors, ["graph_id", "blk"])

        def run(frames):
            for f in frames:
                out = []
                for r in f.itertuples(index=False):
                    x = np.zeros((BLOCK, width)) if r.x is None else np.array(r.x).reshape(-1, width)
                    at = np.sort(np.asarray(r.at))
                    new = np.random.default_rng([seed, step, int(r.blk)]).normal(size=(BLOCK, width))
                    for c in np.flatnonzero(sent.value.get(r.graph_id, np.zeros(width, bool))):
                        x[at, c] = new[at, c]
                    out.append((r.graph_id, r.blk, _split(x)))
                yield pd.DataFrame(out, columns=["graph_id", "blk", "x"])

        return held.select("graph_id", "blk", "at", "x").mapInPandas(run, schema)

    found: list[DataFrame] = []

    def cleaned(w: DataFrame) -> tuple[DataFrame, dict, dict, dict]:
        """``w`` less its share of the basis, twice, and orthonormal; that share, the products of the rest, what is not zero."""
        basis = away + found
        one = stored(_reduced(basis, blocks, w, width, None), "dots")
        first = _dots(one, width)
        two = stored(_reduced(basis, blocks, one.drop("dots"), width, {g: (c, np.eye(width)) for g, (c, _) in first.items()}), "dots")
        second = _dots(two, width)
        rest = {g: gram - c.T @ c for g, (c, gram) in second.items()}
        made = {g: _orthonormal(rest[g], float(np.sqrt(max(np.trace(first[g][1]), 0.0)))) for g in rest}
        change = {g: (second[g][0], made[g][0]) for g in rest}
        q = stored(_reduced(basis, blocks, two.drop("dots"), width, change), "basis")
        freed(one, two)
        # short directions came out of the division with few digits
        third = {g: (c, gram[np.ix_(made[g][1], made[g][1])]) for g, (c, gram) in _dots(q, width).items()}
        if any(np.abs(gram - np.eye(len(gram))).max(initial=0.0) > 1e-12 or np.abs(c).max(initial=0.0) > 1e-12 for c, gram in third.values()):
            for g, (c, gram) in third.items():
                factor, at = np.zeros((width, width)), np.flatnonzero(made[g][1])
                e, v = np.linalg.eigh(gram - (c.T @ c)[np.ix_(at, at)])
                factor[np.ix_(at, at)] = v / np.sqrt(e) @ v.T
                change[g] = (c, factor)
            again = stored(_reduced(basis, blocks, q.drop("dots"), width, change), "basis")
            freed(q)
            q = again
        return q, {g: (first[g][0] + second[g][0])[len(away) * width :] for g in rest}, rest, {g: made[g][1] for g in rest}

    def extended(q: DataFrame, live: dict, step: int) -> None:
        """``q`` joins the basis; random vectors take the place of zero ones while a graph is not spanned."""
        for g, held in graphs.items():
            held.live.append(live[g])
        if any(held.spanned < held.n and not held.live[-1].all() for held in graphs.values()):
            filled = with_random(q, step)
            for held in graphs.values():
                held.live.pop()
            whole, _, _, live = cleaned(filled)
            freed(q)
            q = whole
            for g, held in graphs.items():
                held.live.append(live[g])
        found.append(q)

    q, _, _, live = cleaned(with_random(None, 0))
    extended(q, live, 0)
    while True:
        w = product(found[-1])
        w = w if hasattr(w, "_staged_path") else stored(w, "product")
        q, shares, rests, live = cleaned(w)
        freed(w)
        for g, held in graphs.items():
            if held.done:
                continue
            h = np.zeros((len(found) * width,) * 2)
            h[: len(held.h), : len(held.h)] = held.h
            h[:, -width:] = shares[g]
            h[-width:, :] = shares[g].T
            held.h = h
            alive = np.concatenate(held.live)
            e, s = np.linalg.eigh((h + h.T)[np.ix_(alive, alive)] / 2)
            r, v = np.linalg.eigh((rests[g] + rests[g].T) / 2)
            last = np.zeros((width, len(e)))
            last[held.live[-1]] = s[len(s) - int(held.live[-1].sum()) :]
            off = np.linalg.norm((np.sqrt(np.maximum(r, 0))[:, None] * v.T) @ last, axis=0)
            order = (np.argsort(-np.abs(e), kind="stable") if largest else np.argsort(e, kind="stable"))[: min(k, held.n)]
            held.eig, held.residual = e[order], float(off[order].max(initial=0.0))
            held.states = np.zeros((len(h), len(order)))
            held.states[alive] = s[:, order]
            # a basis that the operator does not leave may lack copies of an eigenvalue: only a spanned space ends it then
            goes_on = np.sqrt(max(r.max(initial=0.0), 0.0)) > 1e-9 * max(np.abs(e).max(initial=0.0), 1e-300)
            enough = len(e) >= min(k + width, held.n) and held.residual <= tolerance * max(np.abs(e).max(initial=0.0), 1e-300)
            held.done = held.spanned >= held.n or (enough and goes_on)
        if all(held.done for held in graphs.values()) or len(found) * width >= most:
            break
        extended(q, live, len(found))
    freed(q)
    return graphs, found


def _powers(basis: list[DataFrame], graphs: dict, width: int, powers: tuple[int, ...]) -> dict:
    """Sums of powers of the components of each graph's eigenvectors, which are the basis times ``states``, block by block."""
    every = None
    for k, q in enumerate(basis):
        q = q.select("graph_id", "blk", F.lit(k).alias("k"), "x")
        every = q if every is None else every.unionByName(q)
    sent = every.sparkSession.sparkContext.broadcast({g: held.states for g, held in graphs.items()})

    def run(f: pd.DataFrame) -> pd.DataFrame:
        graph, states = f["graph_id"].iloc[0], sent.value[f["graph_id"].iloc[0]]
        v = sum(np.asarray(x).reshape(-1, width) @ states[k * width : (k + 1) * width] for k, x in zip(f["k"], f["x"]) if k * width < len(states))
        return pd.DataFrame([(graph, p, i, float(s)) for p in powers for i, s in enumerate((np.abs(v) ** p).sum(0))], columns=["graph_id", "p", "i", "s"])

    schema = f"graph_id {dict(every.dtypes)['graph_id']}, p int, i int, s double"
    out = {g: {p: np.zeros(held.states.shape[1]) for p in powers} for g, held in graphs.items()}
    for r in every.groupBy("graph_id", "blk").applyInPandas(run, schema).groupBy("graph_id", "p", "i").agg(F.sum("s").alias("s")).collect():
        out[r["graph_id"]][r["p"]][r["i"]] = r["s"]
    return out
