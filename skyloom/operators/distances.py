"""Distances of distributions, spectra and graphs.

Distributions are tables ``(id, value)``, or ``(id, value, n)`` with counts. Values are counted before anything is
ordered, so a hot value is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.quantiles import quantiles

EPS = 1e-10
#: Tasks at most that pairs of graphs are dealt to.
PAIR_TASKS = 4096


def counted(df: DataFrame) -> DataFrame:
    n = F.sum("n") if "n" in df.columns else F.count(F.lit(1))
    return df.filter(F.col("value").isNotNull()).groupBy("id", "value").agg(n.cast("double").alias("n"))


def all_pairs(ids: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """Pairs id_a < id_b of a table of few ids (graphs of a corpus); at most ``most``, those first by hash."""
    one, two = ids.select(F.col("id").alias("id_a")).distinct(), ids.select(F.col("id").alias("id_b")).distinct()
    pairs = one.join(two, F.col("id_a") < F.col("id_b"))
    return pairs if most is None else pairs.orderBy(F.xxhash64("id_a", "id_b", F.lit(seed)), "id_a", "id_b").limit(most)


def _steps(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair and value of either: both cumulated shares, and the next value."""
    c = counted(df)
    a = pairs.join(c.withColumnRenamed("id", "id_a"), "id_a").select("id_a", "id_b", "value", F.col("n").alias("x"), F.lit(0.0).alias("y"))
    b = pairs.join(c.withColumnRenamed("id", "id_b"), "id_b").select("id_a", "id_b", "value", F.lit(0.0).alias("x"), F.col("n").alias("y"))
    both = a.union(b).groupBy("id_a", "id_b", "value").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    w = Window.partitionBy("id_a", "id_b")
    upto = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return both.select(
        "id_a", "id_b", "value", F.lead("value").over(w.orderBy("value")).alias("next"),
        F.try_divide(F.sum("x").over(upto), F.sum("x").over(w)).alias("f"), F.try_divide(F.sum("y").over(upto), F.sum("y").over(w)).alias("g"),
    )


def wasserstein(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Integral of the gap of the two distribution functions; null where one side has no values."""
    gap = F.abs(F.col("f") - F.col("g")) * (F.col("next") - F.col("value"))
    both = F.bool_and(F.col("f").isNotNull() & F.col("g").isNotNull())
    return _steps(df, pairs).groupBy("id_a", "id_b").agg(F.when(both, F.coalesce(F.sum(gap), F.lit(0.0))).alias("d"))


def kolmogorov_smirnov(df: DataFrame, pairs: DataFrame) -> DataFrame:
    return _steps(df, pairs).groupBy("id_a", "id_b").agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("d"))


def histograms(df: DataFrame, bin_of: Column) -> DataFrame:
    """id, bin, share: parts of each id's total."""
    c = counted(df).withColumn("bin", bin_of).groupBy("id", "bin").agg(F.sum("n").alias("n"))
    return c.select("id", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("id"))).alias("share"))


def histogram_distance(hist: DataFrame, pairs: DataFrame, metric: str) -> DataFrame:
    """kl and js (nats, 1e-10 added to each share, not renormalised), chi2 (sum (o-e)^2/e) or l2 over all bins of either."""
    a = pairs.join(hist.withColumnRenamed("id", "id_a"), "id_a").select("id_a", "id_b", "bin", F.col("share").alias("p"))
    b = pairs.join(hist.withColumnRenamed("id", "id_b"), "id_b").select("id_a", "id_b", "bin", F.col("share").alias("q"))
    both = a.join(b, ["id_a", "id_b", "bin"], "full").na.fill(0.0, ["p", "q"])
    p, q = F.col("p") + EPS, F.col("q") + EPS
    m = (p + q) / 2
    term = {
        "kl": F.sum(p * F.log(p / q)),
        "js": F.sum(0.5 * p * F.log(p / m) + 0.5 * q * F.log(q / m)),
        "chi2": F.sum((F.col("p") - F.col("q")) ** 2 / q),
        "l2": F.sqrt(F.sum((F.col("p") - F.col("q")) ** 2)),
    }[metric]
    return both.groupBy("id_a", "id_b").agg(term.alias("d"))


def distribution_distance(df: DataFrame, pairs: DataFrame, metric: str = "wasserstein", bin_of: Column | None = None) -> DataFrame:
    if metric == "wasserstein":
        return wasserstein(df, pairs)
    if metric == "ks":
        return kolmogorov_smirnov(df, pairs)
    return histogram_distance(histograms(df, bin_of if bin_of is not None else F.floor("value")), pairs, metric)


def degree_distance(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, metric: str = "wasserstein") -> DataFrame:
    """Unit bins of degree; a graph without nodes is infinitely far."""
    from skyloom.operators.graphs import degrees

    values = degrees(nodes, edges).select(F.col("graph_id").alias("id"), F.col("degree").cast("double").alias("value"))
    found = distribution_distance(values, pairs, metric)
    return pairs.join(found, ["id_a", "id_b"], "left").na.fill(float("inf"), ["d"])


def clustering_distance(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, metric: str = "wasserstein") -> DataFrame:
    """20 bins on [0, 1]."""
    from skyloom.operators.topology import local_clustering

    values = local_clustering(nodes, edges).select(F.col("graph_id").alias("id"), F.col("clustering").alias("value"))
    return distribution_distance(values, pairs, metric, F.least(F.floor(F.col("value") * 20), F.lit(19)))


def path_length_distance(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, metric: str = "wasserstein", sample: int | None = None) -> DataFrame:
    """Hops from every node to all that it reaches; from ``sample`` nodes of each graph if that is given."""
    from skyloom.operators.paths import hop_lengths

    values = hop_lengths(nodes, edges, sample).withColumnRenamed("graph_id", "id")
    return distribution_distance(values, pairs, metric)


def combined_distance(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, weights: dict[str, float] | None = None, metric: str = "wasserstein") -> DataFrame:
    """Weighted sum of the degree, clustering and path-length distances; null where a graph lacks one, as it has no values."""
    weights = weights or {"degree": 1 / 3, "clustering": 1 / 3, "path": 1 / 3}
    made = {"degree": degree_distance, "clustering": clustering_distance, "path": path_length_distance}
    out = pairs
    for name in weights:
        out = out.join(made[name](nodes, edges, pairs, metric).withColumnRenamed("d", name), ["id_a", "id_b"], "left")
    total = sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0))
    return out.withColumn("d", total).select("id_a", "id_b", "d")


def _both(spectra: DataFrame, pairs: DataFrame) -> DataFrame:
    a = spectra.select(F.col("graph_id").alias("id_a"), F.col("eig").alias("x"))
    b = spectra.select(F.col("graph_id").alias("id_b"), F.col("eig").alias("y"))
    return pairs.join(a, "id_a").join(b, "id_b")


def spectral_distance(spectra: DataFrame, pairs: DataFrame, k: int | None = None, norm: str = "l2") -> DataFrame:
    """l1 or l2 of spectra of ``k`` values, zero-padded; without ``k`` both are cut to the shorter."""
    both = _both(spectra, pairs)
    size = F.lit(k) if k else F.least(F.size("x"), F.size("y"))
    fit = lambda c: F.slice(F.concat(F.col(c), F.array_repeat(F.lit(0.0), size)), F.lit(1), size)
    gap = F.zip_with(fit("x"), fit("y"), lambda a, b: F.abs(a - b) if norm == "l1" else (a - b) * (a - b))
    d = F.aggregate(gap, F.lit(0.0), lambda s, v: s + v)
    return both.select("id_a", "id_b", (d if norm == "l1" else F.sqrt(d)).alias("d"))


def spectral_divergence(spectra: DataFrame, pairs: DataFrame, metric: str = "js", bins: int = 50) -> DataFrame:
    """kl or js of histograms of both spectra over equal bins of their joint range."""
    both = _both(spectra, pairs).withColumns({"lo": F.least(F.array_min("x"), F.array_min("y")), "hi": F.greatest(F.array_max("x"), F.array_max("y"))})

    def shares(c: str) -> Column:
        at = lambda v: F.when(F.col("hi") > F.col("lo"), F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
        own = F.transform(c, at)
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.size(F.filter(own, lambda v: v == i)) / F.size(c) + EPS)

    terms = F.zip_with(
        shares("x"), shares("y"),
        lambda p, q: p * F.log(p / q) if metric == "kl" else 0.5 * p * F.log(2 * p / (p + q)) + 0.5 * q * F.log(2 * q / (p + q)),
    )
    return both.select("id_a", "id_b", F.aggregate(terms, F.lit(0.0), lambda s, v: s + v).alias("d"))


def symmetric(d: DataFrame) -> DataFrame:
    """id_a, id_b, d in both orders, and 0 of each graph to itself."""
    other = F.array(F.struct("id_a", "id_b"), F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    both = d.select(F.explode(other).alias("p"), "d").select("p.id_a", "p.id_b", "d")
    ids = both.select("id_a").distinct()
    return both.filter("id_a <> id_b").unionByName(ids.select("id_a", F.col("id_a").alias("id_b"), F.lit(0.0).alias("d"))).dropDuplicates(["id_a", "id_b"])


def matrix_rows(d: DataFrame) -> DataFrame:
    """id, row: the symmetric matrix of pairs, a row a graph, its cells in the order of the ids; null where no pair is."""
    every = symmetric(d)
    ids = every.select(F.col("id_a").alias("id")).distinct()
    names = ids.agg(F.sort_array(F.collect_list("id")).alias("ids"))  # as long as a row of the matrix
    cells = every.groupBy(F.col("id_a").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("id_b", "d"))).alias("m"))
    return cells.join(F.broadcast(names)).select("id", F.transform("ids", lambda x: F.try_element_at("m", x)).alias("row"))


def summarize_distances(d: DataFrame) -> DataFrame:
    """Mean, median, min, max and population std over pairs."""
    moments = d.agg(F.avg("d").alias("mean"), F.min("d").alias("least"), F.max("d").alias("most"), F.stddev_pop("d").alias("std"))
    middle = quantiles(d, ["d"], (0.5,)).select(F.get("q__d", F.lit(0)).alias("median"))
    return moments.join(middle).select("mean", "median", "least", "most", "std")


class Carrier:
    """The cheapest plans that carry integer ``supply`` of rows to ``demand`` of columns (equal sums), for one cost after another.

    Simplex on a spanning tree of rows and columns. The tree of one cost is where the next one starts, so similar costs take
    few exchanges. Each row's supply is raised by a small part, and the last demand by all of them, so that no exchange moves
    nothing; plans are rounded back to integers, so their marginals are exact.
    """

    def __init__(self, supply, demand):
        self.n, self.m = len(supply), len(demand)
        self.scale = 2 * self.n + 2
        self.supply, self.demand = [int(s) * self.scale + 1 for s in supply], [int(d) * self.scale for d in demand]
        self.demand[-1] += self.n
        self.up = None

    def _begin(self, cost):
        """A tree that carries row after row to what is cheapest of the columns that are left."""
        import numpy as np

        n, left, ends = self.n, list(self.demand), [[] for _ in range(self.n + self.m)]
        free = np.ones(self.m, bool)
        for i, amount in enumerate(self.supply):
            columns = np.flatnonzero(free)
            for j in columns[np.argsort(cost[i, columns], kind="stable")].tolist():
                moved = min(amount, left[j])
                ends[i].append((n + j, moved))
                ends[n + j].append((i, moved))
                amount, left[j] = amount - moved, left[j] - moved
                if not amount and i < n - 1:
                    break
                free[j] = False
        self.up, self.flow, self.size = [-1] * len(ends), [0] * len(ends), [1] * len(ends)
        todo, seq = [0], []
        while todo:
            x = todo.pop()
            seq.append(x)
            for y, moved in ends[x]:
                if y != self.up[x]:
                    self.up[y], self.flow[y] = x, moved
                    todo.append(y)
        for x in reversed(seq[1:]):
            self.size[self.up[x]] += self.size[x]
        self.seq, self.places = np.array(seq), np.arange(len(seq))
        self.pos = np.empty_like(self.seq)
        self.pos[self.seq] = self.places

    def _prices(self, cost):
        """Prices of rows, and those of columns with their sign turned, that make every edge of the tree free."""
        import numpy as np

        n, up, price, seq = self.n, self.up, [0.0] * (self.n + self.m), self.seq[1:]
        above = np.array(up)[seq]
        edge = np.where(seq < n, 1.0, -1.0) * cost[np.minimum(seq, above), np.maximum(seq, above) - n]
        for x, c in zip(seq.tolist(), edge.tolist()):
            price[x] = price[up[x]] + c
        return np.array(price)

    def _exchange(self, i: int, j: int, gap: float, price) -> None:
        """The edge of row ``i`` and column ``j`` enters the tree, and the one that its cycle empties first leaves.

        The tree is kept in an order in which whatever hangs on a node follows it, so what moves is a stretch of it.
        """
        import numpy as np

        up, flow, size, seq, pos = self.up, self.flow, self.size, self.seq, self.pos
        ways = ([], [])
        for way, x, other in ((ways[0], i, pos.item(j)), (ways[1], j, pos.item(i))):
            while not (at := pos.item(x)) <= other < at + size[x]:
                way.append(x)
                x = up[x]
        # on both ways up, every other edge gives
        given = [[flow[x] for x in way[::2]] for way in ways]
        moved, side = min((min(g), side) for side, g in enumerate(given) if g)
        last = 2 * given[side].index(moved)
        for way in ways:
            for x in way[::2]:
                flow[x] -= moved
            for x in way[1::2]:
                flow[x] += moved
        chain, before = ways[side][: last + 1], (j, i)[side]
        to, many = pos.item(before) + 1, size[chain[-1]]
        for x in ways[side][last + 1 :]:
            size[x] -= many
        for x in ways[1 - side]:
            size[x] += many
        parts, inner = [], 0
        low = high = pos.item(chain[0])
        for x in chain:  # turned round, this part hangs on the other end of the new edge
            at = pos.item(x)
            end = at + size[x]
            parts += [seq[at:low], seq[high:end]]
            low, high, inner, size[x] = at, end, size[x], many - inner
            before, up[x], (moved, flow[x]) = x, before, (flow[x], moved)
        part = np.concatenate(parts)
        if to <= low:
            seq[to:high] = np.concatenate([part, seq[to:low]])
            low = to
        else:
            seq[low:to] = np.concatenate([seq[high:to], part])
            high = to
        pos[seq[low:high]] = self.places[low:high]
        price[part] += (gap, -gap)[side]

    def plan(self, cost, start=None):
        """The plan of ``cost`` and its column prices; ``start`` may give the columns' prices of a similar problem.

        Rows are gone through in turn, and the edge enters that is the best of its row at the prices of that moment.
        """
        import numpy as np

        n, m = cost.shape
        if self.up is None:
            self._begin(cost - (cost.min(0) if start is None else start))
        off, i = 1e-13 * max(1.0, float(np.abs(cost).max())), 0
        while True:
            price = self._prices(cost)  # anew, for their rounding
            columns, gaps, made, quiet = price[n:], np.empty(m), 0, 0
            if not (cost - price[:n, None] + columns < -off).any():
                break
            while quiet < n and made < n + m:
                j = int(np.add(cost[i], columns, out=gaps).argmin())
                gap = gaps.item(j) - price.item(i)
                if gap < -off:
                    self._exchange(i, n + j, gap, price)
                    made, quiet = made + 1, 0
                else:
                    quiet += 1
                i = i + 1 if i < n - 1 else 0
        flow = np.zeros((n, m), np.int64)
        for x, y in enumerate(self.up):
            if y >= 0:
                flow[(x, y - n) if x < n else (y, x - n)] = (self.flow[x] + self.scale // 2) // self.scale
        return flow, -price[n:]


def transport(cost, supply, demand, start=None):
    """The cheapest plan that carries integer ``supply`` of rows to ``demand`` of columns (equal sums), and its column prices."""
    return Carrier(supply, demand).plan(cost, start)


def sides(n: int, m: int) -> tuple[list[int], list[int]]:
    """Equal integer masses of ``n`` rows, and of ``m`` columns."""
    return ([1] * n, [1] * n) if n == m else ([m] * n, [n] * m)


def conditional_gradient(x, y, t, const, weight, cost, iterations: int, tolerance: float, costs: list | None = None, carrier: Carrier | None = None):
    """A coupling that no linear step makes better than ``tolerance``, from ``t`` on, and its cost; ``costs`` gets each step's.

    The cost is ``weight`` times the squared Gromov-Wasserstein loss plus the rest of ``cost``, and quadratic along a step,
    so the best length of a step is known.
    """
    import numpy as np

    n, m = len(x), len(y)
    value = lambda t, product: weight * ((const - 2 * product) * t).sum() + (1 - weight) * (cost * t).sum()
    carrier = carrier or Carrier(*sides(n, m))
    mass, columns, product = n if n == m else n * m, np.ascontiguousarray(x.T), x @ t @ y.T

    seen = whole = 0

    def carried(flow):
        """x @ flow @ y.T, from that of the flow before; flows have few edges, and from step to step few of them change."""
        nonlocal seen, whole
        change = flow - seen
        j, i = np.nonzero(change.T)
        if len(j):
            used, first = np.unique(j, return_index=True)
            whole = whole + (y[:, used] @ np.add.reduceat(columns[i] * change[i, j][:, None], first)).T
        seen = flow
        return whole

    now = value(t, product)
    for _ in range(iterations):
        if costs is not None:
            costs.append(now)
        grad = weight * 2 * (const - 2 * product) + (1 - weight) * cost
        flow, _ = carrier.plan(grad)
        step, turn = flow / mass - t, carried(flow) / mass - product
        curve = -2 * weight * (turn * step).sum()
        slope = (grad * step).sum()
        tau = min(1.0, max(0.0, -slope / (2 * curve))) if curve > 0 else float(slope + curve < 0)
        new = value(t + tau * step, product + tau * turn)
        if now - new <= tolerance:
            break
        t, product, now = t + tau * step, product + tau * turn, new
    return t, now


def gromov_wasserstein(matrices: DataFrame, pairs: DataFrame, features: DataFrame | None = None, alpha: float = 1.0, iterations: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """id_a, id_b, d: (fused) Gromov-Wasserstein distance of graphs' distance matrices with uniform masses.

    Conditional gradient with squared loss, the best of a few starts: the product coupling, those in the order of nodes'
    distances, and the identity; the linear step is an exact transport, so no step makes the cost larger and couplings
    keep their marginals. Graphs of equal size are also matched node by node, and the matching is made better by swaps.
    The distance is a local minimum, so an upper bound. Infinite lengths count as twice the largest finite one.
    With ``features`` (graph_id, feats array<array<double>>) the cost is (1-alpha) * feature cost + alpha * structure.
    A pair of graphs is a task's unit.
    """
    tables = matrices.select("graph_id", "matrix")
    if features is not None:
        tables = tables.join(features.select("graph_id", "feats"), "graph_id")
    cols = [c for c in tables.columns if c != "graph_id"]
    a = tables.withColumnsRenamed({"graph_id": "id_a", **{c: f"{c}_a" for c in cols}})
    b = tables.withColumnsRenamed({"graph_id": "id_b", **{c: f"{c}_b" for c in cols}})
    # a task a pair, as far as that goes: dealt by a hash, some tasks would have several and others none
    both = pairs.join(a, "id_a").join(b, "id_b").repartition(min(max(1, pairs.count()), PAIR_TASKS))
    fused = features is not None
    weight = alpha if fused else 1.0

    def run(frames):
        import numpy as np
        import pandas as pd

        def finite(m):
            m = np.array([np.asarray(r, float) for r in m])
            ok = np.isfinite(m)
            return np.where(ok, m, 2 * (m[ok].max() if ok.any() else 0.0))

        def matched(x, y):
            """Couplings that carry nodes over in the order of their mean distance, and of their median distance."""
            for middle in (np.mean, np.median):
                a, b = np.argsort(middle(x, axis=1), kind="stable"), np.argsort(middle(y, axis=1), kind="stable")
                ends = np.unique(np.concatenate([np.arange(len(a) + 1) * len(b), np.arange(len(b) + 1) * len(a)]))
                t = np.zeros((len(a), len(b)))
                t[a[ends[:-1] // len(b)], b[ends[:-1] // len(a)]] = np.diff(ends) / (len(a) * len(b))
                yield t

        def swapped(x, y, cost, t):
            """The matching of equally many nodes that is nearest to ``t``, made better by the best swap until none is."""
            n, free = len(x), t.copy()
            to = np.zeros(n, int)
            for _ in range(n):
                i, j = np.unravel_index(np.argmax(free), free.shape)
                to[i] = j
                free[i, :], free[:, j] = -1.0, -1.0
            for at in range(4 * n):
                if at % 64 == 0:
                    z = y[np.ix_(to, to)]
                    a = x @ z.T
                gain = 4 * weight / n * (a + a.T - np.diag(a)[:, None] - np.diag(a)[None, :] + 2 * x * z)
                if np.ndim(cost):
                    c = cost[:, to]
                    gain = gain + (1 - weight) * (np.diag(c)[:, None] + np.diag(c)[None, :] - c - c.T)
                r, s = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[r, s] <= 1e-12:
                    break
                to[[r, s]] = to[[s, r]]
                # what the swap changes in the product, which is made anew now and then for its rounding
                a += np.outer(x[:, s] - x[:, r], z[:, r] - z[:, s])
                a[:, [r, s]] = a[:, [s, r]]
                z[[r, s]] = z[[s, r]]
                z[:, [r, s]] = z[:, [s, r]]
            found = np.zeros((n, n))
            found[np.arange(n), to] = 1 / n
            return found

        def distance(x, y, cost):
            p, q = np.full(len(x), 1 / len(x)), np.full(len(y), 1 / len(y))
            const = (x**2 @ p)[:, None] + (y**2 @ q)[None, :]
            value = lambda t: weight * ((const - 2 * x @ t @ y.T) * t).sum() + (1 - weight) * (cost * t).sum()
            starts = [np.outer(p, q), *matched(x, y)] + ([np.eye(len(x)) / len(x)] if len(x) == len(y) else [])
            best, carrier = np.inf, Carrier(*sides(len(x), len(y)))
            for t in starts:
                t, now = conditional_gradient(x, y, t, const, weight, cost, iterations, tolerance, carrier=carrier)
                best = min(best, now, value(swapped(x, y, cost, t)) if len(x) == len(y) else np.inf)
            return float(np.sqrt(max(best, 0.0)))

        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                cost = 0.0
                if fused:
                    fa, fb = (np.array([np.asarray(v, float) for v in m]) for m in (r.feats_a, r.feats_b))
                    cost = ((fa[:, None, :] - fb[None, :, :]) ** 2).sum(axis=2)
                out.append((r.id_a, r.id_b, distance(finite(r.matrix_a), finite(r.matrix_b), cost)))
            yield pd.DataFrame(out, columns=["id_a", "id_b", "d"])

    kind = dict(pairs.dtypes)["id_a"]
    return both.mapInPandas(run, f"id_a {kind}, id_b {kind}, d double")
