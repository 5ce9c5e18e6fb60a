"""Degree, clustering and mixing features of graphs, by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.graphs import both_ways, connected_components, degrees


def degree_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, density and degree statistics of each graph; std is the population's, skew is corrected for bias."""
    deg = degrees(nodes, edges)
    n, m = F.col("n_nodes"), F.col("n_edges")
    stats = deg.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"),
        F.avg("degree").alias("degree_mean"), F.stddev_pop("degree").alias("degree_std"), F.median("degree").alias("degree_median"),
        F.min("degree").alias("degree_min"), F.max("degree").alias("degree_max"), F.skewness("degree").alias("_skew"),
    )
    corrected = F.when((n > 2) & (F.col("degree_std") > 0), F.col("_skew") * F.sqrt(n * (n - 1.0)) / (n - 2))
    return stats.withColumns(
        {"density": F.when(n > 1, 2.0 * m / (n * (n - 1))), "degree_skew": F.when(n > 2, F.coalesce(corrected, F.lit(0.0)))}
    ).drop("_skew")


def triangles(edges: DataFrame) -> DataFrame:
    """graph_id, a < b < c of every triangle. Edges point from the end of lower (degree, id) to the higher, so that
    a hub has few outgoing edges and its wedges stay few."""
    deg = both_ways(edges).groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("d"))
    side = lambda c, d: deg.select("graph_id", F.col("node_id").alias(c), F.col("d").alias(d))
    e = edges.select("graph_id", "src", "dst").join(side("src", "ds"), ["graph_id", "src"]).join(side("dst", "dd"), ["graph_id", "dst"])
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    e = e.select("graph_id", F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedge = e.select("graph_id", "u", F.col("v").alias("p")).join(e.select("graph_id", "u", F.col("v").alias("q")), ["graph_id", "u"]).filter("p < q")
    closed = edges.select("graph_id", F.col("src").alias("p"), F.col("dst").alias("q"))
    return wedge.join(closed, ["graph_id", "p", "q"]).select(
        "graph_id", F.least("u", "p").alias("a"), F.least(F.greatest("u", "p"), F.col("q")).alias("b"), F.greatest("u", "q").alias("c")
    )


def local_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Triangles over pairs of neighbours of each node, 0 below degree 2."""
    per_node = triangles(edges).select("graph_id", F.explode(F.array("a", "b", "c")).alias("node_id")).groupBy("graph_id", "node_id").agg(F.count(F.lit(1)).alias("t"))
    deg = degrees(nodes, edges).join(per_node, ["graph_id", "node_id"], "left")
    d = F.col("degree")
    c = F.when(d >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (d * (d - 1))).otherwise(0.0)
    return deg.select("graph_id", "node_id", c.alias("clustering"))


def clustering_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return local_clustering(nodes, edges).groupBy("graph_id").agg(F.avg("clustering").alias("clustering_mean"), F.stddev_pop("clustering").alias("clustering_std"))


def assortativity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pearson correlation of the degrees of edges' ends, both directions; null where undefined."""
    deg = degrees(nodes, edges).select("graph_id", "node_id", F.col("degree").cast("double").alias("d"))
    ends = both_ways(edges).join(deg, ["graph_id", "node_id"]).join(deg.withColumnsRenamed({"node_id": "other", "d": "o"}), ["graph_id", "other"])
    n, x, y = F.count(F.lit(1)), F.avg("d"), F.avg("o")
    cov, vx, vy = F.avg(F.col("d") * F.col("o")) - x * y, F.var_pop("d"), F.var_pop("o")
    return ends.groupBy("graph_id").agg(F.when((n > 1) & (vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy)).alias("assortativity"))


def component_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of components and the share of nodes in the largest."""
    sizes = connected_components(nodes, edges).groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_components"), (F.max("n") / F.sum("n")).alias("giant_fraction"))


def compact_features(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """A short row a graph: counts, degree mean and std, mean clustering, assortativity (0 without edges), ``k`` eigenvalues."""
    from skyloom.operators.spectral import expand, spectrum

    own = degree_features(nodes, edges).select("graph_id", F.col("n_nodes").alias("nodes"), F.col("n_edges").alias("edges"), "degree_mean", "degree_std")
    local = clustering_features(nodes, edges).select("graph_id", F.col("clustering_mean").alias("clustering"))
    mixing = assortativity(nodes, edges)
    out = own.join(local, "graph_id", "left").join(mixing, "graph_id", "left")
    out = out.withColumn("assortativity", F.when(F.col("edges") > 0, F.col("assortativity")).otherwise(0.0))
    return out.join(expand(spectrum(nodes, edges, k, weighted=False), "eig", k, "eig"), "graph_id", "left")


def topology_features(nodes: DataFrame, edges: DataFrame, clustering: bool = True, mixing: bool = True, components: bool = True) -> DataFrame:
    out = degree_features(nodes, edges)
    for on, f in ((clustering, clustering_features), (mixing, assortativity), (components, component_features)):
        out = out.join(f(nodes, edges), "graph_id", "left") if on else out
    return out
