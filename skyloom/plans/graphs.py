"""Queries of the graph, distance and learning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import distances as D
from skyloom.operators import embeddings as E
from skyloom.operators import graphs as G
from skyloom.operators import learning as M
from skyloom.operators import neighbors as N
from skyloom.operators import paths as P
from skyloom.operators import sampling as S
from skyloom.operators import scaling as X
from skyloom.operators import spectral as Q
from skyloom.operators import topology as T
from skyloom.staging import stored

QUERIES: dict = {}
AXES = ("x", "y", "z")
K = 4


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def points(spark: SparkSession, d: str, one_graph: bool = False) -> DataFrame:
    """Vectors as points of the graph of their label, or of one graph."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    graph = F.lit("all") if one_graph else F.concat(F.lit("g"), F.col("label").cast("string"))
    return e.select(graph.alias("graph_id"), F.col("vec_id").alias("node_id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(AXES)])


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = points(spark, d)
    return nodes, stored(N.knn_edges(nodes, K), "edges")


POINTS = """points AS (SELECT 'g' || label AS graph_id, vec_id AS node_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"""
KNN = f"""{POINTS}, pairs AS (
  SELECT a.graph_id, a.node_id AS src, b.node_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
  FROM points a JOIN points b ON a.graph_id = b.graph_id AND a.node_id <> b.node_id),
knn AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY graph_id, src ORDER BY d, dst) <= {K}),
edges AS (SELECT graph_id, src, dst, d AS weight FROM knn WHERE dst > src),
both_ways AS (SELECT graph_id, src AS node_id, dst AS other, weight FROM edges UNION ALL SELECT graph_id, dst, src, weight FROM edges),
degrees AS (SELECT graph_id, node_id, count(other) AS degree FROM points LEFT JOIN both_ways USING (graph_id, node_id) GROUP BY 1, 2)"""


@query("j03_knn_edges", f"WITH {KNN} SELECT graph_id, src, dst, round(weight, 6) AS weight FROM edges")
def _(spark, d):
    return graph(spark, d)[1].withColumn("weight", F.round("weight", 6))


@query("j03_knn_edges_one_graph", f"WITH {KNN.replace(chr(39) + 'g' + chr(39) + ' || label', chr(39) + 'all' + chr(39))} SELECT src, dst, round(weight, 6) AS weight FROM edges")
def _(spark, d):
    """The bucketed plan: the group is above the size that is compared in full."""
    found = N.knn(points(spark, d, True), K, small=100).filter("dst > src")
    return found.select("src", "dst", F.round("d", 6).alias("weight"))


@query("j04_knn_symmetric", f"WITH {KNN} SELECT graph_id, least(src, dst) AS src, greatest(src, dst) AS dst, round(min(d), 6) AS weight FROM knn GROUP BY ALL")
def _(spark, d):
    return N.knn_edges_symmetric(points(spark, d), K).withColumn("weight", F.round("weight", 6))


@query("g13_radius_edges", f"WITH {KNN} SELECT graph_id, src, dst, round(d, 6) AS d FROM pairs WHERE src < dst AND d <= 0.1")
def _(spark, d):
    return N.radius_pairs(points(spark, d), AXES, 0.1).withColumn("d", F.round("d", 6))


@query("j07_induced_subgraph", f"WITH {KNN} SELECT graph_id, src, dst FROM edges WHERE src % 3 <> 0 AND dst % 3 <> 0")
def _(spark, d):
    nodes, edges = graph(spark, d)
    return G.induced(edges, nodes.filter("node_id % 3 <> 0")).select("graph_id", "src", "dst")


@query("j09_pairs", f"WITH {POINTS}, ids AS (SELECT DISTINCT graph_id FROM points) SELECT a.graph_id AS id_a, b.graph_id AS id_b FROM ids a JOIN ids b ON a.graph_id < b.graph_id")
def _(spark, d):
    return D.all_pairs(points(spark, d).select(F.col("graph_id").alias("id")))


@query("g01_windows")
def _(spark, d):
    """Cubes about random points of one catalog, each a graph, all in one plan."""
    p = points(spark, d, True).select(F.col("node_id").alias("obj_id"), *[F.col(c).alias(f"{c}_mpc") for c in AXES])
    found = S.sample_windows(p, 4, 0.25, "obj_id", least=5, most=50)
    nodes = found.select(F.concat(F.lit("w"), F.col("graph_id").cast("string")).alias("graph_id"), F.col("obj_id").alias("node_id"), *[F.col(f"{c}_mpc").alias(c) for c in AXES])
    return T.degree_features(nodes, N.knn_edges(nodes, K))


@query(
    "g02_catalog_graph",
    f"""WITH {POINTS}, b AS (SELECT graph_id, min(x) AS x0, max(x) - min(x) AS xs, min(y) AS y0, max(y) - min(y) AS ys, min(z) AS z0, max(z) - min(z) AS zs FROM points GROUP BY 1),
    u AS (SELECT graph_id, node_id, (x - x0) / xs AS x, (y - y0) / ys AS y, (z - z0) / zs AS z FROM points JOIN b USING (graph_id)),
    pairs AS (SELECT p.graph_id, p.node_id AS src, q.node_id AS dst, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)) AS d FROM u p JOIN u q ON p.graph_id = q.graph_id AND p.node_id <> q.node_id),
    edges AS (SELECT * FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY graph_id, src ORDER BY d, dst) <= {K}) WHERE dst > src)
    SELECT graph_id, src, dst, round((d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w), 6) AS weight FROM edges WINDOW w AS (PARTITION BY graph_id)""",
)
def _(spark, d):
    return G.catalog_graph(points(spark, d), K)[1].withColumn("weight", F.round("weight", 6))


@query("g03_matrix_graph", "SELECT l_orderkey AS src, l_partkey + 10000000 AS dst, max(abs(l_tax - 0.04)) AS weight FROM lineitem GROUP BY 1, 2 HAVING max(abs(l_tax - 0.04)) > 0.02")
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    m = li.groupBy(F.col("l_orderkey").alias("i"), (F.col("l_partkey") + 10000000).alias("j")).agg(F.max(F.abs(F.col("l_tax") - 0.04)).alias("value")).withColumn("graph_id", F.lit("m"))
    return G.matrix_graph(m, 0.02).select("src", "dst", "weight")


NX = NY = 12
STEP = 6.0 / (NX - 1)
GRID = f"grid AS (SELECT i AS node_id, i // {NY} AS ix, i % {NY} AS iy, -3.0::DOUBLE + (i // {NY}) * {STEP!r}::DOUBLE AS x, -3.0::DOUBLE + (i % {NY}) * {STEP!r}::DOUBLE AS y FROM range({NX * NY}) t(i))"


@query("g05_grid_potential", f"WITH {GRID} SELECT node_id, ix, iy, round(x, 6) AS x, round(y, 6) AS y, round(0.5 * x * x + 2.0 * y * y, 6) AS v FROM grid")
def _(spark, d):
    g = G.grid_2d(spark, NX, NY, (-3.0, 3.0), (-3.0, 3.0))
    return g.select("node_id", "ix", "iy", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(G.oscillator_potential(1.0, 2.0), 6).alias("v"))


@query(
    "g05_hamiltonian",
    f"""WITH {GRID}, h AS (SELECT node_id AS i, node_id AS j, {2 / STEP**2!r} + 0.5 * x * x + 0.5 * y * y AS value FROM grid
    UNION ALL SELECT a.node_id, b.node_id, {-0.5 / STEP**2!r} FROM grid a JOIN grid b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1) SELECT i, j, round(value, 5) AS value FROM h""",
)
def _(spark, d):
    g = G.grid_2d(spark, NX, NY, (-3.0, 3.0), (-3.0, 3.0))
    return G.hamiltonian(g, G.oscillator_potential(), NX, NY, STEP, STEP).select("i", "j", F.round("value", 5).alias("value"))


@query("g06_well_states")
def _(spark, d):
    g = G.grid_2d(spark, NX, NY, (-2.5, 2.5), (-2.5, 2.5), "well")
    h = G.hamiltonian(g, G.well_potential(10.0, 1.0, 1.0, 0.0, [(1.0, 0.5, 0.5, 0.3)]), NX, NY, 5 / (NX - 1), 5 / (NY - 1))
    return Q.state_features(Q.matrix_spectrum(h))


@query("g07_ring", "SELECT least(i, (i + 1) % 50) AS src, greatest(i, (i + 1) % 50) AS dst FROM range(50) t(i)")
def _(spark, d):
    return G.ring(spark, 50).select("src", "dst")


@query("g07_torus", "SELECT least(i, o) AS src, greatest(i, o) AS dst FROM (SELECT i, unnest([(i // 8 + 1) % 8 * 8 + i % 8, i // 8 * 8 + (i % 8 + 1) % 8]) AS o FROM range(64) t(i))")
def _(spark, d):
    return G.torus_2d(spark, 8).select("src", "dst")


@query("g09_ensemble")
def _(spark, d):
    """Rewired lattices with disorder: states of each member's tight-binding operator."""
    out = None
    for family, n in (("ring", 36), ("torus", 36), ("regular", 36)):
        edges = G.random_members(spark, family, n, 4, 0.1)
        ids = edges.select("graph_id").distinct()
        nodes = G.onsite_potential(ids.select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("node_id")), 1.0)
        found = Q.state_features(Q.matrix_spectrum(G.tight_binding(nodes, edges)))
        out = found if out is None else out.union(found)
    return out


@query(
    "g10_components",
    f"""WITH RECURSIVE {KNN}, reach AS (SELECT graph_id, node_id, node_id AS seen FROM points UNION SELECT r.graph_id, r.node_id, b.other FROM reach r JOIN both_ways b ON r.graph_id = b.graph_id AND r.seen = b.node_id)
    SELECT graph_id, node_id, min(seen) AS component FROM reach GROUP BY 1, 2""",
)
def _(spark, d):
    return G.connected_components(*graph(spark, d))


@query("g11_relabel", f"WITH {KNN}, ids AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS n FROM points) SELECT e.graph_id, a.n AS src, b.n AS dst FROM edges e JOIN ids a ON e.graph_id = a.graph_id AND e.src = a.node_id JOIN ids b ON e.graph_id = b.graph_id AND e.dst = b.node_id")
def _(spark, d):
    return G.relabel(*graph(spark, d))[1].select("graph_id", "src", "dst")


@query(
    "g12_statistics",
    f"""WITH {KNN}, g AS (SELECT graph_id, count(*) AS n_nodes, avg(degree) AS m, stddev_pop(degree) AS s FROM degrees GROUP BY 1), e AS (SELECT graph_id, count(*) AS n_edges, avg(weight) AS w FROM edges GROUP BY 1)
    SELECT graph_id, n_nodes, n_edges, round(m, 6) AS degree_mean, round(s, 6) AS degree_std, round(w, 6) AS weight_mean, round(2.0::DOUBLE * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density FROM g JOIN e USING (graph_id)""",
)
def _(spark, d):
    s = G.graph_statistics(*graph(spark, d))
    return s.select("graph_id", "n_nodes", "n_edges", *[F.round(c, 6).alias(c) for c in ("degree_mean", "degree_std", "weight_mean", "density")])


@query("g12_compare")
def _(spark, d):
    return G.compare_graphs(G.graph_statistics(*graph(spark, d)), "g0", "g1")


@query("f22_exact_size")
def _(spark, d):
    return G.exact_size(*graph(spark, d), 20)[1]


@query("l07_downsample_degree", f"WITH {KNN} SELECT graph_id, node_id FROM degrees QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, node_id) <= 10")
def _(spark, d):
    return G.downsample(*graph(spark, d), 10)[0].select("graph_id", "node_id")


@query("l08_match_sizes", f"WITH {POINTS}, c AS (SELECT graph_id, count(*) AS n FROM points GROUP BY 1) SELECT graph_id, (SELECT min(n) FROM c) AS n FROM c")
def _(spark, d):
    return G.match_sizes(*graph(spark, d))[0].groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))


@query("l11_grid_stride", f"WITH {GRID} SELECT node_id FROM grid WHERE ix % 3 = 0 AND iy % 3 = 0")
def _(spark, d):
    return S.grid_stride(G.grid_2d(spark, NX, NY, (-3.0, 3.0), (-3.0, 3.0)), 20).select("node_id")


@query("x09_unit_sphere", f"WITH {POINTS}, c AS (SELECT graph_id, node_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM points WINDOW w AS (PARTITION BY graph_id)) SELECT graph_id, node_id, round(x / max(sqrt(x * x + y * y + z * z)) OVER (PARTITION BY graph_id), 6) AS x FROM c")
def _(spark, d):
    return X.normalize_coordinates(points(spark, d), AXES, "unit_sphere").select("graph_id", "node_id", F.round("x", 6).alias("x"))


@query("x11_weights_to_range", f"WITH {KNN} SELECT graph_id, src, dst, round(1 + (weight - min(weight) OVER w) / (max(weight) OVER w - min(weight) OVER w) * 2, 6) AS weight FROM edges WINDOW w AS (PARTITION BY graph_id)")
def _(spark, d):
    return X.scale_weights(graph(spark, d)[1], "range", low=1.0, high=3.0).withColumn("weight", F.round("weight", 6)).select("graph_id", "src", "dst", "weight")


@query(
    "t01_degree_features",
    f"WITH {KNN} SELECT graph_id, count(*) AS n_nodes, (sum(degree) / 2)::BIGINT AS n_edges, round(avg(degree), 6) AS degree_mean, round(stddev_pop(degree), 6) AS degree_std, median(degree) AS degree_median, min(degree) AS degree_min, max(degree) AS degree_max, round(skewness(degree), 6) AS degree_skew, round(sum(degree)::DOUBLE / (count(*) * (count(*) - 1)), 6) AS density FROM degrees GROUP BY 1",
)
def _(spark, d):
    f = T.degree_features(*graph(spark, d))
    return f.withColumns({c: F.round(c, 6) for c in ("degree_mean", "degree_std", "degree_skew", "density")})


TRI = f"""{KNN}, tri AS (SELECT e.graph_id, e.src AS a, e.dst AS b, f.dst AS c FROM edges e JOIN edges f ON e.graph_id = f.graph_id AND e.dst = f.src JOIN edges h ON h.graph_id = e.graph_id AND h.src = e.src AND h.dst = f.dst),
corner AS (SELECT graph_id, unnest([a, b, c]) AS node_id FROM tri), t AS (SELECT graph_id, node_id, count(*) AS t FROM corner GROUP BY 1, 2),
cc AS (SELECT graph_id, node_id, CASE WHEN degree >= 2 THEN 2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END AS c FROM degrees LEFT JOIN t USING (graph_id, node_id))"""


@query("t03_clustering", f"WITH {TRI} SELECT graph_id, round(avg(c), 6) AS clustering_mean, round(stddev_pop(c), 6) AS clustering_std FROM cc GROUP BY 1")
def _(spark, d):
    return T.clustering_features(*graph(spark, d)).withColumns({c: F.round(c, 6) for c in ("clustering_mean", "clustering_std")})


@query("t04_assortativity", f"WITH {KNN} SELECT b.graph_id, round(corr(p.degree, q.degree), 6) AS assortativity FROM both_ways b JOIN degrees p ON p.graph_id = b.graph_id AND p.node_id = b.node_id JOIN degrees q ON q.graph_id = b.graph_id AND q.node_id = b.other GROUP BY 1")
def _(spark, d):
    return T.assortativity(*graph(spark, d)).withColumn("assortativity", F.round("assortativity", 6))


@query("t02_component_features")
def _(spark, d):
    return T.component_features(*graph(spark, d))


for _name, _f in {
    "t05_path_features": P.path_features, "t06_weighted_paths": P.weighted_path_mean, "t07_centrality": P.centrality_features, "t08_topology": T.topology_features,
    "p06_positional_encoding": Q.positional_encoding, "d12_distance_matrices": P.distance_rows,
}.items():
    QUERIES[_name] = (lambda spark, d, f=_f: f(*graph(spark, d)), None)


@query("p01_laplacian_spectrum")
def _(spark, d):
    return Q.expand(Q.spectral_features(Q.spectrum(*graph(spark, d), 30)), "eig", 30, "eig")


@query("p02_adjacency_spectrum")
def _(spark, d):
    return Q.spectrum(*graph(spark, d), 10, "adjacency", weighted=False, largest=True)


@query("e01_random_walks")
def _(spark, d):
    return E.random_walks(*graph(spark, d))


@query("e03_embedding_features")
def _(spark, d):
    return E.embedding_features(*graph(spark, d), method="concat")


@query("a18_aggregate_embeddings", "SELECT label, [round(x, 5) for x in list(m ORDER BY i)] AS embedding FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    # the SQL's round keeps the sign of what becomes zero
    rounded = lambda x: F.when((x < 0) & (F.round(x, 5) == 0), F.lit(-0.0)).otherwise(F.round(x, 5))
    return E.aggregate_embeddings(e, "mean", "label").withColumn("embedding", F.transform("embedding", rounded))


@query("e04_feature_table")
def _(spark, d):
    nodes, edges = graph(spark, d)
    relational = T.topology_features(nodes, edges)
    return relational.join(P.weighted_path_mean(nodes, edges), "graph_id").join(Q.spectral_features(Q.spectrum(nodes, edges, 16)).drop("eig"), "graph_id")


# distances

VALUES = "v AS (SELECT event_type AS id, round(value) AS value, count(*) AS n FROM events GROUP BY 1, 2), ids AS (SELECT DISTINCT id FROM v), pr AS (SELECT a.id AS id_a, b.id AS id_b FROM ids a JOIN ids b ON a.id < b.id)"
STEPS = f"""{VALUES}, u AS (SELECT id_a, id_b, value, n AS x, 0 AS y FROM pr JOIN v ON id = id_a UNION ALL SELECT id_a, id_b, value, 0, n FROM pr JOIN v ON id = id_b),
s AS (SELECT id_a, id_b, value, sum(x) AS x, sum(y) AS y FROM u GROUP BY 1, 2, 3),
c AS (SELECT id_a, id_b, value, lead(value) OVER w AS nxt, sum(x) OVER w / sum(x) OVER p AS f, sum(y) OVER w / sum(y) OVER p AS g FROM s WINDOW w AS (PARTITION BY id_a, id_b ORDER BY value), p AS (PARTITION BY id_a, id_b))"""
SHARES = f"{VALUES}, h AS (SELECT id, floor(value / 100)::BIGINT AS bin, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY id) AS share FROM v GROUP BY id, bin), b AS (SELECT DISTINCT bin FROM h), j AS (SELECT id_a, id_b, coalesce(p.share, 0) AS p, coalesce(q.share, 0) AS q FROM pr CROSS JOIN b LEFT JOIN h p ON p.id = id_a AND p.bin = b.bin LEFT JOIN h q ON q.id = id_b AND q.bin = b.bin)"


def values(spark, d) -> tuple[DataFrame, DataFrame]:
    v = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("id"), F.round("value").alias("value"))
    return v, D.all_pairs(v)


for _metric, _sql in {
    "wasserstein": f"WITH {STEPS} SELECT id_a, id_b, round(sum(abs(f - g) * (nxt - value)), 5) AS d FROM c GROUP BY 1, 2",
    "ks": f"WITH {STEPS} SELECT id_a, id_b, round(max(abs(f - g)), 5) AS d FROM c GROUP BY 1, 2",
    "kl": f"WITH {SHARES} SELECT id_a, id_b, round(sum((p + 1e-10) * ln((p + 1e-10) / (q + 1e-10))), 5) AS d FROM j GROUP BY 1, 2",
    "js": f"WITH {SHARES} SELECT id_a, id_b, round(sum(0.5 * (p + 1e-10) * ln(2 * (p + 1e-10) / (p + q + 2e-10)) + 0.5 * (q + 1e-10) * ln(2 * (q + 1e-10) / (p + q + 2e-10))), 5) AS d FROM j GROUP BY 1, 2",
    "l2": f"WITH {SHARES} SELECT id_a, id_b, round(sqrt(sum((p - q) * (p - q))), 5) AS d FROM j GROUP BY 1, 2",
    "chi2": f"WITH {SHARES} SELECT id_a, id_b, round(sum((p - q) * (p - q) / (q + 1e-10)), 3) AS d FROM j GROUP BY 1, 2",
}.items():

    def _distance(spark, d, metric=_metric):
        v, pairs = values(spark, d)
        found = D.distribution_distance(v, pairs, metric, F.floor(F.col("value") / 100))
        return found.withColumn("d", F.round("d", 3 if metric == "chi2" else 5))

    QUERIES[f"d03_{_metric}"] = (_distance, _sql)


for _name, _f in {"d04_degree": D.degree_distance, "d05_clustering": D.clustering_distance, "d06_paths": D.path_length_distance, "d07_combined": D.combined_distance}.items():

    def _graph_distance(spark, d, f=_f):
        nodes, edges = graph(spark, d)
        return f(nodes, edges, D.all_pairs(nodes.select(F.col("graph_id").alias("id"))))

    QUERIES[_name] = (_graph_distance, None)


def _spectra(spark, d):
    nodes, edges = graph(spark, d)
    return Q.spectrum(nodes, edges, 16), D.all_pairs(nodes.select(F.col("graph_id").alias("id")))


QUERIES["d09_spectral"] = (lambda spark, d: D.spectral_distance(*_spectra(spark, d), 16), None)
QUERIES["d10_spectral_divergence"] = (lambda spark, d: D.spectral_divergence(*_spectra(spark, d)), None)
QUERIES["a15_distance_summary"] = (lambda spark, d: D.summarize_distances(D.spectral_distance(*_spectra(spark, d), 16)), None)


@query("d13_gromov_wasserstein")
def _(spark, d):
    """Whole graphs, every pair."""
    nodes, edges = graph(spark, d)
    return D.gromov_wasserstein(P.distance_matrices(nodes, edges), D.all_pairs(nodes.select(F.col("graph_id").alias("id"))))


# learning


def table(spark, d) -> tuple[DataFrame, list[str]]:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    names = [f"f{i}" for i in range(6)]
    return e.select(F.col("vec_id").alias("id"), (F.col("label") < 5).cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query("m01_prepared", "SELECT vec_id AS id, round((embedding[1]::DOUBLE - avg(embedding[1]::DOUBLE) OVER ()) / stddev_pop(embedding[1]::DOUBLE) OVER (), 5) AS f0 FROM embeddings")
def _(spark, d):
    df, names = table(spark, d)
    return M.prepare(df, "id", "label", names, scaled=True)[0].select("id", F.round("f0", 5).alias("f0"))


FIXED = "p AS (SELECT event_id, (value > 50)::INT AS label, (event_id % 3 <> 0)::INT AS prediction, event_id % 17 AS score FROM events)"


def fixed(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", (F.col("value") > 50).cast("double").alias("label"), (F.col("event_id") % 3 != 0).cast("double").alias("prediction"), (F.col("event_id") % 17).alias("score"), "value")


@query(
    "m05_classification_metrics",
    f"""WITH {FIXED}, a AS (SELECT avg((label = prediction)::INT) AS accuracy, count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM p),
    s AS (SELECT score, count(*) FILTER (label = 1) AS x, count(*) FILTER (label = 0) AS y FROM p GROUP BY 1), w AS (SELECT x, y, x * (sum(y) OVER (ORDER BY score) - y + y / 2.0::DOUBLE) AS w FROM s)
    SELECT round(accuracy, 6) AS accuracy, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, (SELECT round(sum(w) / (sum(x) * sum(y)), 6) FROM w) AS roc_auc FROM a""",
)
def _(spark, d):
    out = M.classification_metrics(fixed(spark, d), proba="score")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("m06_class_report", f"""WITH {FIXED} SELECT label::DOUBLE AS "class", count(*) AS support, round(avg((label = prediction)::INT), 6) AS recall FROM p GROUP BY 1""")
def _(spark, d):
    return M.class_report(fixed(spark, d)).select("class", "support", F.round("recall", 6).alias("recall"))


@query("m10_regression_metrics", f"WITH {FIXED} SELECT round(avg(pow(value - score, 2)), 4) AS mse, round(sqrt(avg(pow(value - score, 2))), 5) AS rmse, round(avg(abs(value - score)), 5) AS mae, round(1 - avg(pow(value - score, 2)) / var_pop(value), 6) AS r2 FROM (SELECT value, event_id % 17 AS score FROM events)")
def _(spark, d):
    out = M.regression_metrics(fixed(spark, d), "value", "score")
    return out.select(F.round("mse", 4).alias("mse"), F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae"), F.round("r2", 6).alias("r2"))


@query("m02_logistic")
def _(spark, d):
    df, names = table(spark, d)
    data, _ = M.prepare(df, "id", "label", names, scaled=True)
    model = M.train(data, names, {"lr": M.logistic(data.count())})["lr"]
    return M.classification_metrics(M.predict(model, data, True), proba="proba")


@query("m06_train_and_evaluate")
def _(spark, d):
    df, names = table(spark, d)
    return M.train_and_evaluate(df, "id", "label", names, kinds=["logistic_regression", "random_forest"])[1]


@query(
    "m08_pairwise_features",
    "WITH g AS (SELECT label, avg(embedding[1]::DOUBLE) AS a, avg(embedding[2]::DOUBLE) AS b FROM embeddings GROUP BY 1) SELECT p.label AS id_a, q.label AS id_b, round(1 / (1 + sqrt(pow(p.a - q.a, 2) + pow(p.b - q.b, 2))), 6) AS similarity FROM g p JOIN g q ON p.label < q.label",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    g = e.groupBy("label").agg(F.avg(F.col("embedding")[0].cast("double")).alias("a"), F.avg(F.col("embedding")[1].cast("double")).alias("b"))
    found = M.pairwise_features(g, D.all_pairs(g.select(F.col("label").alias("id"))), ["a", "b"], "label")
    return found.select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query("m09_ridge")
def _(spark, d):
    df, names = table(spark, d)
    n, std = df.agg(F.count(F.lit(1)), F.stddev_samp("f5")).first()
    data = df.withColumn("label", F.col("f5"))
    model = M.train(data, names[:5], {"ridge": M.ridge(n, std)})["ridge"]
    return M.regression_metrics(M.predict(model, data))


@query("m11_kmeans")
def _(spark, d):
    df, names = table(spark, d)
    return M.cluster_statistics(M.kmeans(df, names, 3), "cluster", names[:2])


@query(
    "m12_dbscan",
    """WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), n AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02),
    core AS (SELECT id FROM p WHERE (SELECT count(*) FROM n WHERE a = id) + 1 >= 5), link AS (SELECT a, b FROM n WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach AS (SELECT id, id AS s FROM core UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.s = l.a), comp AS (SELECT id, min(s) AS c FROM reach GROUP BY 1),
    num AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM (SELECT DISTINCT c FROM comp)), every AS (SELECT id, c FROM comp UNION ALL SELECT a, min(c) FROM n JOIN comp ON b = id WHERE a NOT IN (SELECT id FROM core) GROUP BY a)
    SELECT p.id, coalesce(k, -1)::INT AS cluster FROM p LEFT JOIN every USING (id) LEFT JOIN num USING (c)""",
)
def _(spark, d):
    df, _ = table(spark, d)
    return M.dbscan(df, ["f0", "f1"], "id", 0.02, 5).select("id", F.col("cluster").cast("int").alias("cluster"))


@query("m13_clustering_metrics")
def _(spark, d):
    df, names = table(spark, d)
    return M.clustering_metrics(df.withColumn("cluster", F.col("label").cast("int")), names, "id")


@query("d16_cross_domain")
def _(spark, d):
    df, names = table(spark, d)
    return M.cross_domain_distances(df.filter("label = 0"), df.filter("label = 1"), names, "id")


@query("d17_principal_components")
def _(spark, d):
    df, names = table(spark, d)
    return M.principal_components(df, names).select("id", "pc_1", "pc_2")


# runs


@query("a03_cluster_statistics", "SELECT label AS cluster, count(*)::BIGINT AS count, round(avg(embedding[1]::DOUBLE), 6) AS f0_mean, round(stddev_samp(embedding[1]::DOUBLE), 6) AS f0_std FROM embeddings GROUP BY 1")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("cluster"), F.col("embedding")[0].cast("double").alias("f0"))
    return M.cluster_statistics(e, "cluster", ["f0"]).withColumns({c: F.round(c, 6) for c in ("f0_mean", "f0_std")})


@query("a14_corpus_statistics", f"WITH {TRI}, g AS (SELECT graph_id, count(*) AS n, sum(degree) / 2 AS m FROM degrees GROUP BY 1), k AS (SELECT graph_id, avg(c) AS c FROM cc GROUP BY 1) SELECT count(*)::BIGINT AS n_graphs, round(avg(n), 6) AS n_nodes_mean, round(avg(m), 6) AS n_edges_mean, round(avg(2.0::DOUBLE * m / (n * (n - 1))), 6) AS density_mean, round(avg(c), 6) AS clustering_mean_mean FROM g JOIN k USING (graph_id)")
def _(spark, d):
    from skyloom.plans.experiment import corpus_statistics

    out = corpus_statistics(*graph(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "n_graphs"})


@query("r01_experiment")
def _(spark, d):
    """Two sources of one table through ingest, graphs, features and distances."""
    from skyloom.plans import experiment as X2
    from skyloom.plans.tables import catalog

    c = catalog(spark, d)
    names = {"obj_id": ("object_id",), "ra_deg": ("ra",), "dec_deg": ("dec",), "z": ("redshift",)}
    preset = X2.Preset("demo", (0.0, 360.0), (-60.0, 60.0), (0.01, 2.0), 1500, 1500.0, 3, 6, 20, 200)
    points, _ = X2.ingest({"one": c.filter("catalog_source = 'A'"), "two": c.filter("catalog_source = 'R'")}, preset, names)
    nodes, edges, _ = X2.build_graphs(stored(points, "points"), preset)
    return X2.feature_table(nodes, edges, X2.Experiment(eigenvalues=8))
