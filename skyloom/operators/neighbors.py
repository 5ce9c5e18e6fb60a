"""Nearest neighbours, radius and sky joins: by grid cells on few axes, by cells about pivots on many."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.coords import angular_separation
from skyloom.operators.metric import metric_knn, metric_radius_pairs
from skyloom.staging import stored

#: Axes of a grid at most: a point meets 3 to the power of the axes cells.
GRID_AXES = 4

#: Parts of a group that a point which no cell has settled is compared with.
SALTS = 64


def euclidean(gaps: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [g * g for g in gaps]))


def manhattan(gaps: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.abs(g) for g in gaps])


def chebyshev(gaps: Sequence[Column]) -> Column:
    return F.greatest(*[F.abs(g) for g in gaps]) if len(gaps) > 1 else F.abs(gaps[0])


def minkowski(p: float) -> Callable:
    return lambda gaps: F.pow(reduce(lambda a, b: a + b, [F.pow(F.abs(g), F.lit(p)) for g in gaps]), F.lit(1 / p))


METRICS = {"euclidean": euclidean, "manhattan": manhattan, "chebyshev": chebyshev}


def _cells(df: DataFrame, axes: Sequence[str], size: Column, around: bool) -> DataFrame:
    """Grid cell of each row, or a row for each cell about it."""
    for a in axes:
        own = F.floor(F.col(a) / size)
        df = df.withColumn(f"_c_{a}", F.explode(F.sequence(own - 1, own + 1)) if around else own)
    return df


def radius_pairs(points: DataFrame, axes: Sequence[str], radius: float, metric: str = "euclidean", by: str = "graph_id", key: str = "node_id") -> DataFrame:
    """``(by, src, dst, d)``, src < dst, of points within ``radius`` of each other in a group.

    Each point meets the points of its own and the neighbouring cells of a grid of ``radius``, on up to ``GRID_AXES`` axes.
    On more, blocks of points about pivots meet that may be that near.
    """
    if len(axes) > GRID_AXES:
        return metric_radius_pairs(points, axes, radius, metric, by, key)
    cells = [f"_c_{a}" for a in axes]
    near = _cells(points.select(by, F.col(key).alias("src"), *axes), axes, F.lit(radius), True)
    own = _cells(points.select(by, F.col(key).alias("dst"), *axes), axes, F.lit(radius), False)
    own = own.withColumnsRenamed({a: f"{a}_b" for a in axes})
    d = METRICS[metric]([F.col(a) - F.col(f"{a}_b") for a in axes])
    return near.join(own, [by, *cells]).filter("src < dst").withColumn("d", d).filter(F.col("d") <= radius).select(by, "src", "dst", "d")


def knn(
    points: DataFrame, k: int, axes: Sequence[str] = ("x", "y", "z"), metric: str | Callable = "euclidean",
    by: str = "graph_id", key: str = "node_id", rounds: int = 8, small: int = 2000,
) -> DataFrame:
    """``(by, src, dst, d, rank)``: the ``k`` nearest others of each point in its group, ties by (d, dst).

    Groups of up to ``small`` points are compared in full, as an equi-join on the group. Larger ones go by blocks about
    pivots under a named metric. Under a metric of the caller's own a point
    meets the cells about its own, of a size that holds some k points in the mean; a point is done once its
    k-th distance is within the cell size, as nothing nearer lies farther out. The rest goes on with cells
    twice as large, so dense regions are settled by small cells; what ``rounds`` leave is compared in full, in parts.
    What a round has settled and left is written to the staging folder, so no round is computed twice.
    On more than ``GRID_AXES`` axes a named metric goes by blocks whatever the size of a group.
    """
    if len(axes) > GRID_AXES and isinstance(metric, str):
        return metric_knn(points, k, axes, metric, by, key)
    dist = METRICS[metric] if isinstance(metric, str) else metric
    base = points.select(by, F.col(key).alias("src"), *[F.col(a).cast("double").alias(a) for a in axes])
    others = base.withColumnsRenamed({"src": "dst", **{a: f"{a}_b" for a in axes}})
    rank = Window.partitionBy(by, "src").orderBy("d", "dst")

    def ranked(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
        pairs = a.join(b, list(on)).filter("src <> dst").withColumn("d", dist([F.col(x) - F.col(f"{x}_b") for x in axes]))
        return pairs.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)

    spans = [F.max(a) - F.min(a) for a in axes]
    volume = reduce(lambda a, b: a * b, [F.when(s > 0, s).otherwise(1.0) for s in spans])
    groups = base.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.pow(volume * (k + 1) / F.count(F.lit(1)), F.lit(1 / len(axes))).alias("_size"))
    sized = base.join(groups, by)
    wanted = ["src", "dst", "d", "rank"]
    done = ranked(sized.filter(F.col("_n") <= small), others, [by]).select(by, *wanted)
    if not groups.filter(F.col("_n") > small).limit(1).count():
        return done
    if isinstance(metric, str):
        # the cells of a grid hold too many where points are dense; blocks about pivots are of one size
        large = points.join(groups.filter(F.col("_n") > small).select(by), by, "left_semi")
        return done.unionByName(metric_knn(large, k, axes, metric, by, key))
    # a metric of the caller's own may have many axes: cells of the first ones bound d as well
    axes_cells = list(axes)[:GRID_AXES]
    cells = [f"_c_{a}" for a in axes_cells]
    todo = sized.filter(F.col("_n") > small)
    table = others.join(groups.filter(F.col("_n") > small), by)
    for i in range(rounds):
        size = F.col("_size") * (2.0**i)
        own = table.withColumns({f"_c_{a}": F.floor(F.col(f"{a}_b") / size) for a in axes_cells}).drop("_n", "_size")
        found = ranked(_cells(todo, axes_cells, size, True), own, [by, *cells])
        kth = F.max(F.when(F.col("rank") == k, F.col("d"))).over(Window.partitionBy(by, "src"))
        settled = stored(found.withColumn("_kth", kth).filter(F.col("_kth") <= size).select(by, *wanted), "settled")
        done = done.union(settled)
        todo = stored(todo.join(settled.select(by, "src").distinct(), [by, "src"], "left_anti"), "todo")
        if not todo.limit(1).count():
            return done
    # what is left meets the others in parts, so that no task compares all of a large group
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    far = table.drop("_n", "_size").withColumn("_s", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int"))
    met = todo.drop("_n", "_size").withColumn("_s", F.explode(salts)).join(far, [by, "_s"]).filter("src <> dst")
    met = met.withColumn("d", dist([F.col(x) - F.col(f"{x}_b") for x in axes]))
    own_rank = F.row_number().over(Window.partitionBy(by, "src", "_s").orderBy("d", "dst"))
    best = met.withColumn("_r", own_rank).filter(F.col("_r") <= k)
    return done.union(best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select(by, *wanted))


def knn_edges(points: DataFrame, k: int, axes: Sequence[str] = ("x", "y", "z"), metric: str = "euclidean", by: str = "graph_id", key: str = "node_id") -> DataFrame:
    """``(by, src, dst, weight)`` from the lower id only: (i, j) if j > i is among the k nearest of i."""
    return knn(points, k, axes, metric, by, key).filter("dst > src").select(by, "src", "dst", F.col("d").alias("weight"))


def knn_edges_symmetric(points: DataFrame, k: int, axes: Sequence[str] = ("x", "y", "z"), metric: str = "euclidean", by: str = "graph_id", key: str = "node_id") -> DataFrame:
    """Edges of either end's neighbours, each once with src < dst."""
    found = knn(points, k, axes, metric, by, key)
    return found.groupBy(by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("d").alias("weight"))


def cross_match(a: DataFrame, b: DataFrame, radius_deg: float) -> DataFrame:
    """Pairs (id_a, id_b, separation) of two catalogs (id, ra, dec) within ``radius_deg`` on the sky.

    Both are dealt into bands of declination as high as the radius, and each band into cells of right ascension about as
    wide as the radius at the band's end nearer to a pole. A point of ``a`` meets the cells that its circle may reach:
    half of its width in right ascension is asin(sin r / cos dec), or the whole way round where the circle holds a pole.
    """
    r = float(radius_deg)
    high = F.least(F.lit(90.0), F.greatest(F.abs(F.col("_band") * r), F.abs((F.col("_band") + 1) * r)))
    n = F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(high)) / r)).cast("long")
    band = F.floor(F.col("dec") / r)
    left = a.select(
        F.col("id").alias("id_a"), F.pmod(F.col("ra").cast("double"), F.lit(360.0)).alias("ra_a"), F.col("dec").alias("dec_a"),
        F.explode(F.sequence(band - 1, band + 1)).alias("_band"),
    ).withColumn("_n", n)
    polar = F.abs("dec_a") + r >= 90.0
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(r) * 3.141592653589793 / 180) / F.cos(F.radians("dec_a"))))) * (1 + 1e-9) + 1e-9
    cell = F.col("_n") / 360.0
    first, last = F.floor((F.col("ra_a") - wide) * cell), F.floor((F.col("ra_a") + wide) * cell)
    every = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    reached = F.when(polar | (last - first >= F.col("_n") - 1), every).otherwise(
        F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.pmod(i, F.col("_n")))
    )
    left = left.withColumn("_cell", F.explode(reached))
    right = b.select(F.col("id").alias("id_b"), F.pmod(F.col("ra").cast("double"), F.lit(360.0)).alias("ra_b"), F.col("dec").alias("dec_b"), F.floor(F.col("dec") / r).alias("_band"))
    right = right.withColumn("_n", n).withColumn("_cell", F.least(F.floor(F.col("ra_b") * cell), F.col("_n") - 1))
    d = angular_separation(F.col("ra_a"), F.col("dec_a"), F.col("ra_b"), F.col("dec_b"))
    # few bytes go in and many pairs come out, so a number of tasks that follows the bytes would be too small
    spark = a.sparkSession
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    left, right = (side.repartition(n_tasks, "_band", "_cell") for side in (left, right.drop("_n")))
    near = F.abs(F.col("dec_a") - F.col("dec_b")) <= r * (1 + 1e-9) + 1e-9
    return left.join(right, ["_band", "_cell"]).filter(near).withColumn("separation", d).filter(F.col("separation") <= r).select("id_a", "id_b", "separation")


def cone(df: DataFrame, ra: float, dec: float, radius_deg: float) -> DataFrame:
    """Rows within a circle on the sky; the declination bound reaches the scan."""
    inside = angular_separation(F.col("ra"), F.col("dec"), F.lit(ra), F.lit(dec)) <= radius_deg
    return df.filter(F.col("dec").between(dec - radius_deg, dec + radius_deg) & inside)
