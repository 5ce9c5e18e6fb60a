"""Exact, repeatable sampling: fixed sizes, matched samples, windows, stratified splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Callable[[Column, int], Column]


def hash_order(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def lcg_order(key: Column, seed: int) -> Column:
    """An arithmetic order that any SQL engine can repeat."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(2147483648)) * F.lit(1103515245) + F.lit(seed), F.lit(2147483648))


#: Bits below those that deal an order's values into some 4096 bins.
_BELOW = {hash_order: 52, lcg_order: 19}


def _binned(df: DataFrame, key: str, seed: int, order: Order) -> DataFrame:
    """``df`` with _o, the order of ``key``, and _bin, a few thousand even parts of it."""
    return df.withColumn("_o", order(F.col(key), seed)).withColumn("_bin", F.shiftright("_o", _BELOW.get(order, 52)))


def _before(binned: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, _bin, _n and _before, the rows of the group in earlier bins: a row a bin, whatever the table's size."""
    sizes = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def _ends(binned: DataFrame, by: Sequence[str], n: Column) -> DataFrame:
    """``by``, _end, _left: the bin in which the first ``n`` rows of a group end, and how many rows of it they take.

    ``n`` is a column of _total, the group's rows.
    """
    bins = _before(binned, by).withColumn("_total", F.sum("_n").over(Window.partitionBy(*by))).withColumn("_wanted", n)
    last = F.max(
        F.when(F.col("_before") < F.col("_wanted"), F.struct("_bin", (F.col("_wanted") - F.col("_before")).alias("_left")))
    )
    return bins.groupBy(*by).agg(last.alias("_e")).select(*by, F.col("_e._bin").alias("_end"), F.coalesce("_e._left", F.lit(0)).alias("_left"))


def _with_ends(binned: DataFrame, ends: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return binned.join(F.broadcast(ends))
    held = ends.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return binned.join(held, same).drop(*[f"_by_{c}" for c in by])


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42, order: Order = hash_order) -> DataFrame:
    """``n`` rows without replacement, those first by a hash of ``key``; all of them if there are fewer.

    Rows are counted in some 4096 bins of the hash; only those of the bin in which the sample ends are ordered.
    """
    binned = _binned(df, key, seed, order)
    near = _with_ends(binned, _ends(binned, (), F.lit(n)), ())
    first = near.filter("_bin < _end").select(*df.columns)
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_o", key))
    last = near.filter("_bin = _end").withColumn("_r", rank).filter("_r <= _left").select(*df.columns)
    return first.union(last)


def sample_n_by(df: DataFrame, n: int | Column, by: Sequence[str], key: str, seed: int = 42, order: Order = hash_order) -> DataFrame:
    """``n`` rows of each group, or all: those first by a hash of ``key``. A null group is a group.

    A number ``n`` goes by bins as in ``sample_n``: only a group's bin in which its sample ends is ordered. A column ``n``
    of each row orders whole groups.
    """
    if not isinstance(n, Column):
        binned = _binned(df, key, seed, order)
        near = _with_ends(binned, _ends(binned, by, F.lit(n)), by)
        first = near.filter("_bin < _end").select(*df.columns)
        rank = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy("_o", key))
        return first.union(near.filter("_bin = _end").withColumn("_r", rank).filter("_r <= _left").select(*df.columns))
    w = Window.partitionBy(*by).orderBy(order(F.col(key), seed), key)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def downsample_matched(a: DataFrame, b: DataFrame, key: str, seed: int = 42, order: Order = hash_order) -> tuple[DataFrame, DataFrame]:
    """Samples of both, as large as the smaller; ValueError if one is empty."""
    n = min(a.count(), b.count())
    if not n:
        raise ValueError("nothing to match: one side is empty")
    return sample_n(a, n, key, seed, order), sample_n(b, n, key, seed, order)


def combined_sample(df: DataFrame, strata: Sequence[str], quota: int, key: str, seed: int = 42, order: Order = hash_order) -> DataFrame:
    """At most ``quota`` rows of each stratum, in one plan."""
    return sample_n_by(df, quota, strata, key, seed, order)


def sample_windows(
    points: DataFrame, n_graphs: int, side: float, key: str, axes: Sequence[str] = ("x_mpc", "y_mpc", "z_mpc"),
    least: int = 800, most: int = 4000, attempts: int = 30, seed: int = 42, order: Order = hash_order,
) -> DataFrame:
    """For each of ``n_graphs`` graphs the points of a cube about a random point: graph_id, the points, center_*.

    Every graph tries ``attempts`` centres and takes the first cube with ``least`` points, thinned to ``most``.
    Centres are few (graphs times attempts), so they are sent to the points; each point meets those in its own and
    the neighbouring cells of a grid of ``side``. A graph without such a cube is left out.
    """
    centers = sample_n(points, n_graphs * attempts, key, seed, order).select(
        *[F.col(a).alias(f"center_{a[0]}") for a in axes], F.col(key).alias("_center")
    )
    at = F.row_number().over(Window.orderBy(order(F.col("_center"), seed), "_center")) - 1
    centers = centers.withColumn("_at", at).withColumns(
        {"graph_id": (F.col("_at") % n_graphs).cast("long"), "_try": F.floor(F.col("_at") / n_graphs)}
    )
    cells = centers
    for a in axes:
        own = F.floor(F.col(f"center_{a[0]}") / side)
        cells = cells.withColumn(f"_c{a}", F.explode(F.sequence(own - 1, own + 1)))
    celled = points.withColumns({f"_c{a}": F.floor(F.col(a) / side) for a in axes})
    inside = celled.join(cells, [f"_c{a}" for a in axes])
    for a in axes:
        inside = inside.filter(F.abs(F.col(a) - F.col(f"center_{a[0]}")) <= side / 2)
    sizes = inside.groupBy("graph_id", "_try").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    first = sizes.groupBy("graph_id").agg(F.min("_try").alias("_try"))
    chosen = inside.join(first, ["graph_id", "_try"])
    thinned = sample_n_by(chosen, most, ["graph_id"], key, seed + 1, order)
    return thinned.select("graph_id", *points.columns, *[f"center_{a[0]}" for a in axes])


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42, order: Order = hash_order) -> DataFrame:
    """``is_test``: in each class the first ``round(count * test)`` rows by hash; ranks are taken within class and salt.

    A class of most of the rows is ranked in 32 salted parts, whose own shares are rounded.
    """
    salt = F.pmod(order(F.col(key), seed + 7), F.lit(32))
    w = Window.partitionBy(label, "_salt")
    ranked = df.withColumn("_salt", salt).withColumns(
        {"_r": F.row_number().over(w.orderBy(order(F.col(key), seed), key)), "_n": F.count(F.lit(1)).over(w)}
    )
    return ranked.withColumn("is_test", F.col("_r") <= F.round(F.col("_n") * test)).drop("_salt", "_r", "_n")


def exact_split(df: DataFrame, label: str | None, key: str, test: float = 0.2, seed: int = 42, order: Order = hash_order) -> DataFrame:
    """``is_test`` with exactly ``round(count * test)`` rows of each class, those first by a hash of ``key``.

    As in ``sample_n`` only the rows of the bin in which a class's part ends are ordered, and where it ends is sent to the
    rows, so a class of most of the rows is no single task's. A null label is a class.
    """
    by = [label] if label else []
    binned = _binned(df, key, seed, order)
    near = _with_ends(binned, F.broadcast(_ends(binned, by, F.round(F.col("_total") * test))), by)
    clear = near.filter("_bin <> coalesce(_end, _bin - 1)").withColumn("is_test", F.coalesce(F.col("_bin") < F.col("_end"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy("_o", key))
    last = near.filter("_bin = _end").withColumn("is_test", rank <= F.col("_left"))
    return clear.select(*df.columns, "is_test").union(last.select(*df.columns, "is_test"))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, order: Order = hash_order) -> DataFrame:
    return df.withColumn("fold", F.pmod(order(F.col(key), seed), F.lit(k)).cast("int"))


def shuffle_labels(df: DataFrame, label: str, key: str, seed: int = 42, order: Order = hash_order) -> DataFrame:
    """Labels permuted among the rows: the i-th row by one hash gets the i-th label by another."""

    def numbered(rows: DataFrame, s: int) -> DataFrame:
        binned = _binned(rows, key, s, order)
        bins = _before(binned, ()).select("_bin", "_before")
        rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_o", key))
        return binned.withColumn("_r", rank).join(bins, "_bin").withColumn("_i", F.col("_before") + F.col("_r"))

    a = numbered(df, seed).select(*[c for c in df.columns if c != label], "_i")
    b = numbered(df.select(label, key), seed + 1).select(label, "_i")
    return a.join(b, "_i").select(*df.columns)


def grid_stride(nodes: DataFrame, most: int, ix: str = "ix", iy: str = "iy", method: str = "grid") -> DataFrame:
    """Thin a lattice to at most ``most`` nodes: every ``ceil(sqrt(total / most))``-th of both axes, or evenly by id."""
    total = nodes.count()
    if total <= most:
        return nodes
    if method == "uniform":
        step = -(-total // most)
        return nodes.filter(F.col("node_id") % step == 0).orderBy("node_id").limit(most)
    step = int(-(-((total / most) ** 0.5) // 1))
    return nodes.filter((F.col(ix) % step == 0) & (F.col(iy) % step == 0)).orderBy(ix, iy).limit(most)
