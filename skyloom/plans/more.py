"""Queries of preparation, stored systems, models and their life cycle, and distances beside closed forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.coords import add_proxy_cartesian
from skyloom.operators import columns as C
from skyloom.operators import distances as D
from skyloom.operators import graphs as G
from skyloom.operators import kernels as K
from skyloom.operators import learning as M
from skyloom.operators import neighbors as N
from skyloom.operators import paths as P
from skyloom.operators import relational as R
from skyloom.operators import sampling as S
from skyloom.operators import scaling as X
from skyloom.operators import topology as T
from skyloom.plans.experiment import plan_grid, run_grid
from skyloom.plans.graphs import QUERIES as LEARNING
from skyloom.plans.graphs import GRID, KNN, NX, NY, STEP, TRI, graph, points
from skyloom.plans.graphs import table as learning_table
from skyloom.plans.tables import CATALOG, catalog, table
from skyloom.sources import readers, sinks
from skyloom.sources.store import Store
from skyloom.staging import staging_folder

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    return f"{staging_folder(spark)}/skyloom/{name}-{uuid.uuid4().hex}"


# preparation


@query("x04_proxy_cartesian", f"SELECT object_id, round(redshift * 1000 * cos(radians(dec)) * cos(radians(ra)), 6) AS x, round(redshift * 1000 * sin(radians(dec)), 6) AS z FROM {CATALOG}")
def _(spark, d):
    out = add_proxy_cartesian(catalog(spark, d))
    return out.select("object_id", F.round("X", 6).alias("x"), F.round("Z", 6).alias("z"))


@query("x06_preprocess", f"SELECT object_id, round(redshift * 299792.458 / 70 * cos(radians(dec)) * sin(radians(ra)), 4) AS y FROM {CATALOG} WHERE ra BETWEEN 20 AND 300 AND dec BETWEEN -45 AND 45 AND redshift BETWEEN 0.1 AND 0.9")
def _(spark, d):
    out = C.preprocess_catalog(catalog(spark, d), (20, 300), (-45, 45), (0.1, 0.9))
    return out.select("object_id", F.round("y", 4).alias("y"))


@query("x22_downcast", "SELECT o_orderkey, o_totalprice::FLOAT AS o_totalprice FROM orders")
def _(spark, d):
    return C.downcast(table(spark, d, "orders").select("o_orderkey", "o_totalprice"))


@query("x13_interpolate", """WITH h AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
    n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, first_value(v IGNORE NULLS) OVER f AS c, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER b AS xa, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER f AS xc FROM h
    WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(v, a + (c - a) * (event_id - xa) / (xc - xa)::DOUBLE), 6) AS v FROM n""")
def _(spark, d):
    holes = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return C.fill_missing(holes, ["v"], "interpolate", "event_id", ["user_id"]).select("event_id", F.round("v", 6).alias("v"))


@query("x13_mode", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN (SELECT s FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1 ORDER BY n DESC, s LIMIT 1)) ELSE o_orderstatus END AS s FROM orders")
def _(spark, d):
    holes = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("s"))
    return C.fill_missing(holes, ["s"], "mode")


@query("x14_health_score_of_holes", """WITH t AS (SELECT p_size AS a, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS b FROM part), s AS (SELECT count(*) AS n, (count(a) + count(b)) / (2.0::DOUBLE * count(*)) AS p, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) / count(*)::DOUBLE AS q FROM t)
    SELECT n, round(p, 6) AS present, round(q, 6) AS distinct_share, round(100 * p * (0.5::DOUBLE + 0.5::DOUBLE * q), 6) AS score FROM s""")
def _(spark, d):
    t = table(spark, d, "part").select(F.col("p_size").alias("a"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("b"))
    return C.health_score(t).select("n", *[F.round(c, 6).alias(c) for c in ("present", "distinct_share", "score")])


@query("f18_document_struct", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END, 'PENDING') AS status, coalesce(o_totalprice, 0) AS progress, 'none' AS note FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").alias("progress"))
    out = C.document_struct(o, {"status": ("string", "PENDING"), "progress": ("double", 0.0), "note": ("string", "none")})
    return out.select("o_orderkey", "document.*")


@query("f03_ids_made_up", "SELECT count(*)::BIGINT AS n, count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_quantity))::BIGINT AS texts FROM lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.lit(None).cast("string").alias("oid"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    out = C.normalize_catalog(li, "demo", {"object_id": ("oid",), "ra": ("l_quantity",), "dec": ("l_quantity",)}, {})
    plain = F.regexp_extract("object_id", "^DEMO_([0-9a-f]{32})", 1)
    return out.agg(F.count_distinct("object_id").alias("n"), F.count_distinct(plain).alias("texts"))


@query("j12_broadcast_row", "SELECT r_regionkey, r_name, (SELECT count(*) FROM nation) AS n, (SELECT max(n_nationkey) FROM nation) AS last FROM region")
def _(spark, d):
    row = table(spark, d, "nation").agg(F.count(F.lit(1)).alias("n"), F.max("n_nationkey").alias("last"))
    return C.broadcast_row(table(spark, d, "region").select("r_regionkey", "r_name"), row)


@query("s11_survey", f"SELECT object_id FROM {CATALOG} WHERE redshift BETWEEN 0.2 AND 0.5 ORDER BY (object_id % 2147483648 * 1103515245 + 42) % 2147483648, object_id LIMIT 300")
def _(spark, d):
    """The first source is away, the second is empty, the third is cached, and the cache is read."""
    def gone():
        raise OSError("away")

    made = [gone, lambda: catalog(spark, d).limit(0), lambda: catalog(spark, d)]
    found = readers.load_survey(spark, scratch(spark, "survey"), made, (0.2, 0.5), None, "redshift")
    return S.sample_n(found, 300, "object_id", 42, S.lcg_order).select("object_id")


@query("s13_survey_summary", "SELECT * FROM (VALUES ('BGS', NULL::DOUBLE, 0.6::DOUBLE), ('LRG', 0.4, 1.1), ('ELG', 0.8, 1.6), ('QSO', 0.8, 3.5)) t(tracer, z_min, z_max)")
def _(spark, d):
    return readers.survey_summary(spark).drop("description")


# systems and graphs


@query("k05_grid_system", f"WITH {GRID} SELECT node_id AS i, round(0.5 * x * x + 0.5 * y * y + {2 / STEP**2!r}, 5) AS value FROM grid")
def _(spark, d):
    """A system saved and loaded: the diagonal of its operator."""
    g = G.grid_2d(spark, NX, NY, (-3.0, 3.0), (-3.0, 3.0))
    path = scratch(spark, "system")
    sinks.save_grid_system(g, G.hamiltonian(g, G.oscillator_potential(), NX, NY, STEP, STEP), {"nx": NX, "ny": NY}, path)
    grid, matrix, about = readers.load_grid_system(spark, path)
    assert about == {"nx": NX, "ny": NY} and grid.count() == NX * NY
    return matrix.filter("i = j").select("i", F.round("value", 5).alias("value"))


@query(
    "g04_reduced_graph",
    f"WITH {GRID}, k AS (SELECT * FROM grid WHERE ix % 2 = 0 AND iy % 2 = 0) SELECT a.node_id AS src, b.node_id AS dst FROM k a JOIN k b ON a.node_id < b.node_id AND ((b.ix - a.ix = 2 AND a.iy = b.iy) OR (a.ix = b.ix AND b.iy - a.iy = 2))",
)
def _(spark, d):
    """A full operator by distance, reduced to every second point of both axes."""
    g = G.grid_2d(spark, NX, NY, (-3.0, 3.0), (-3.0, 3.0))
    a, b = (g.select("graph_id", F.col("node_id").alias(n), F.col("ix").alias(f"{n}x"), F.col("iy").alias(f"{n}y")) for n in ("i", "j"))
    near = F.abs(F.col("ix") - F.col("jx")) + F.abs(F.col("iy") - F.col("jy")) == 2
    matrix = a.join(b, "graph_id").filter(near).select("graph_id", "i", "j", F.lit(-1.0).alias("value"))
    return G.reduced_quantum_graph(g, matrix, 40, G.oscillator_potential())[1].select("src", "dst")


@query(
    "g12_connected_statistics",
    f"""WITH RECURSIVE {TRI}, reach AS (SELECT graph_id, node_id, node_id AS seen FROM points UNION SELECT r.graph_id, r.node_id, b.other FROM reach r JOIN both_ways b ON r.graph_id = b.graph_id AND r.seen = b.node_id),
    comp AS (SELECT graph_id, node_id, min(seen) AS component FROM reach GROUP BY 1, 2), n AS (SELECT graph_id, count(DISTINCT component) AS n_components, count(*) AS k FROM comp GROUP BY 1), m AS (SELECT graph_id, avg(c) AS c FROM cc GROUP BY 1)
    SELECT graph_id, n_components, CASE WHEN n_components = 1 AND k > 2 THEN round(c, 6) END AS clustering FROM n JOIN m USING (graph_id)""",
)
def _(spark, d):
    return G.graph_statistics(*graph(spark, d), connected=True).select("graph_id", "n_components", F.round("clustering", 6).alias("clustering"))


@query(
    "g12_compare_all",
    f"WITH {KNN}, g AS (SELECT graph_id, avg(degree) AS m, min(degree) AS a, max(degree) AS b FROM degrees GROUP BY 1) SELECT round(abs(p.m - q.m), 6) AS degree_mean_diff, abs(p.a - q.a) AS degree_min_diff, abs(p.b - q.b) AS degree_max_diff FROM g p, g q WHERE p.graph_id = 'g0' AND q.graph_id = 'g1'",
)
def _(spark, d):
    out = G.compare_graphs(G.graph_statistics(*graph(spark, d)), "g0", "g1")
    return out.select(F.round("degree_mean_diff", 6).alias("degree_mean_diff"), "degree_min_diff", "degree_max_diff")


@query(
    "t02_components_and_giant",
    f"""WITH RECURSIVE {KNN}, reach AS (SELECT graph_id, node_id, node_id AS seen FROM points UNION SELECT r.graph_id, r.node_id, b.other FROM reach r JOIN both_ways b ON r.graph_id = b.graph_id AND r.seen = b.node_id),
    comp AS (SELECT graph_id, node_id, min(seen) AS component FROM reach GROUP BY 1, 2), sizes AS (SELECT graph_id, component, count(*) AS n FROM comp GROUP BY 1, 2)
    SELECT graph_id, count(*) AS n_components, round(max(n) / sum(n)::DOUBLE, 6) AS giant_fraction FROM sizes GROUP BY 1""",
)
def _(spark, d):
    return T.component_features(*graph(spark, d)).withColumn("giant_fraction", F.round("giant_fraction", 6))


@query("f22_exact_size_lcg", f"WITH {KNN}, k AS (SELECT graph_id, node_id FROM points QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY (node_id % 2147483648 * 1103515245 + 42) % 2147483648, node_id) <= 20), r AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS n FROM k) SELECT e.graph_id, a.n AS src, b.n AS dst FROM edges e JOIN r a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN r b ON b.graph_id = e.graph_id AND b.node_id = e.dst")
def _(spark, d):
    return G.exact_size(*graph(spark, d), 20, 42, S.lcg_order)[1].select("graph_id", "src", "dst")


@query("e05_compact_features")
def _(spark, d):
    return T.compact_features(*graph(spark, d))


@query("j03_knn_all_components", """WITH p AS (SELECT a.label, a.vec_id AS src, b.vec_id AS dst, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT src, dst, round(d, 5) AS d FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) <= 3""")
def _(spark, d):
    """Nearest neighbours in all 64 components."""
    e = table(spark, d, "embeddings")
    axes = [f"c{i}" for i in range(64)]
    p = e.select(F.col("label").cast("string").alias("graph_id"), F.col("vec_id").alias("node_id"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate(axes)])
    return N.knn(p, 3, axes).select("src", "dst", F.round("d", 5).alias("d"))


@query("j03_knn_one_group", """WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT src, dst, round(d, 5) AS d FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) <= 3""")
def _(spark, d):
    """Nearest neighbours in all 64 components, all rows in one group."""
    e = table(spark, d, "embeddings")
    axes = [f"c{i}" for i in range(64)]
    p = e.select(F.lit("all").alias("graph_id"), F.col("vec_id").alias("node_id"), *[F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate(axes)])
    return N.knn(p, 3, axes).select("src", "dst", F.round("d", 5).alias("d"))


_ON_TWO = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02"


@query("m12_dbscan_six", LEARNING["m12_dbscan"][1].replace("embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y", "embedding[1:6]::DOUBLE[] AS v").replace(_ON_TWO, "list_distance(a.v, b.v) <= 0.25"))
def _(spark, d):
    """On six features, where a grid has too many cells."""
    df, names = learning_table(spark, d)
    return M.dbscan(df, names, "id", 0.25, 5).select("id", F.col("cluster").cast("int").alias("cluster"))


@query("m13_metrics_given", """WITH p AS (SELECT vec_id AS id, label AS c, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS v FROM embeddings),
    m AS (SELECT a.id, a.c, b.c AS c2, sum(list_distance(a.v, b.v)) AS s, count(*) AS k FROM p a JOIN p b ON a.id <> b.id GROUP BY ALL),
    w AS (SELECT id, max(CASE WHEN c = c2 THEN s / k END) AS a, min(CASE WHEN c <> c2 THEN s / k END) AS b FROM m GROUP BY 1)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 8) AS silhouette FROM w""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    p = e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(3)])
    return M.clustering_metrics(p, ["c0", "c1", "c2"], "vec_id", "label").select(F.round("silhouette", 8).alias("silhouette"))


@query("x08_shells", f"""WITH c AS (SELECT object_id, ra, dec, sqrt(mag_g ** 2 + mag_r ** 2 + redshift ** 2) AS s FROM {CATALOG})
    SELECT object_id, least(floor((ra - min(ra) OVER ()) / (max(ra) OVER () - min(ra) OVER ()) * 36), 35)::BIGINT AS sky_region_ra_bin,
    least(floor((dec - min(dec) OVER ()) / (max(dec) OVER () - min(dec) OVER ()) * 18), 17)::BIGINT AS sky_region_dec_bin,
    least(floor((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) * 20), 19)::BIGINT AS volume_shell_bin FROM c""")
def _(spark, d):
    """Cells of the sky and shells of distance, magnitudes and redshift standing in for coordinates."""
    c = catalog(spark, d).withColumns({"X": F.col("mag_g"), "Y": F.col("mag_r"), "Z": F.col("redshift")})
    return X.engineer_features(c).select("object_id", "sky_region_ra_bin", "sky_region_dec_bin", "volume_shell_bin")


def _stored_customers(spark, d) -> Store:
    """A store that takes two upserts: customers not divisible by 5, then all divisible by 3 with a balance of 1."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    store = Store(spark, scratch(spark, "store"), "c_custkey", 16)
    store.upsert(c.filter("c_custkey % 5 <> 0"))
    store.upsert(c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(1.0)))
    return store


_STORED = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE c_acctbal::DOUBLE END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0"


@query("k07_stored_objects", _STORED)
def _(spark, d):
    return _stored_customers(spark, d).read()


@query("k17_deleted_by_age", f"WITH s AS ({_STORED}) SELECT c_custkey, c_acctbal FROM s WHERE c_custkey % 7 <> 0")
def _(spark, d):
    """Rows of an age are deleted from a store, and what nothing names is cleaned up."""
    store = _stored_customers(spark, d)
    seen = F.when(F.col("c_custkey") % 7 == 0, F.expr("timestamp '2024-01-01 00:00:00'")).otherwise(F.expr("timestamp '2024-02-01 00:00:00'"))
    store.upsert(store.read().withColumn("seen_at", seen))
    store.expire("seen_at", F.expr("timestamp '2024-02-02 00:00:00'"), 7)
    store.vacuum()
    return store.read().select("c_custkey", "c_acctbal")


# distances


PAIRS = "pr AS (SELECT a.graph_id AS id_a, b.graph_id AS id_b FROM (SELECT DISTINCT graph_id FROM points) a JOIN (SELECT DISTINCT graph_id FROM points) b ON a.graph_id < b.graph_id)"
_MOVED = """u AS (SELECT id_a, id_b, value, n AS x, 0 AS y FROM pr JOIN v ON id = id_a UNION ALL SELECT id_a, id_b, value, 0, n FROM pr JOIN v ON id = id_b),
s AS (SELECT id_a, id_b, value, sum(x) AS x, sum(y) AS y FROM u GROUP BY 1, 2, 3),
c AS (SELECT id_a, id_b, value, lead(value) OVER w AS nxt, sum(x) OVER w / sum(x) OVER p AS f, sum(y) OVER w / sum(y) OVER p AS g FROM s WINDOW w AS (PARTITION BY id_a, id_b ORDER BY value), p AS (PARTITION BY id_a, id_b))
SELECT id_a, id_b, round(coalesce(sum(abs(f - g) * (nxt - value)), 0), 5) AS d FROM c GROUP BY 1, 2"""


def _pairs(nodes: DataFrame) -> DataFrame:
    return D.all_pairs(nodes.select(F.col("graph_id").alias("id")))


@query("d04_degree_wasserstein", f"WITH {KNN}, {PAIRS}, v AS (SELECT graph_id AS id, degree AS value, count(*) AS n FROM degrees GROUP BY 1, 2), {_MOVED}")
def _(spark, d):
    nodes, edges = graph(spark, d)
    return D.degree_distance(nodes, edges, _pairs(nodes)).withColumn("d", F.round("d", 5))


@query("d05_clustering_wasserstein", f"WITH {TRI}, {PAIRS}, v AS (SELECT graph_id AS id, c AS value, count(*) AS n FROM cc GROUP BY 1, 2), {_MOVED}")
def _(spark, d):
    nodes, edges = graph(spark, d)
    return D.clustering_distance(nodes, edges, _pairs(nodes)).withColumn("d", F.round("d", 5))


SPECTRA = "e AS (SELECT label AS id, list_sort(list_transform(embedding[1:16], lambda x: round(x::DOUBLE, 6))) AS eig FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)"


def spectra(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    first = R.first_by_key(e.select("label", "vec_id", "embedding"), ["label"], ["vec_id"])
    return first.select(F.col("label").alias("graph_id"), F.array_sort(F.transform(F.slice("embedding", 1, 16), lambda x: F.round(x.cast("double"), 6))).alias("eig"))


@query("d09_spectral_given", f"WITH {SPECTRA} SELECT a.id AS id_a, b.id AS id_b, round(sqrt(list_sum(list_transform(range(1, 17), lambda i: pow(a.eig[i] - b.eig[i], 2)))), 5) AS d FROM e a JOIN e b ON a.id < b.id")
def _(spark, d):
    s = spectra(spark, d)
    return D.spectral_distance(s, _pairs(s), 16).withColumn("d", F.round("d", 5))


@query("a15_distance_summary_given", f"WITH {SPECTRA}, x AS (SELECT sqrt(list_sum(list_transform(range(1, 17), lambda i: pow(a.eig[i] - b.eig[i], 2)))) AS d FROM e a JOIN e b ON a.id < b.id) SELECT round(avg(d), 5) AS mean, round(median(d), 5) AS median, round(min(d), 5) AS least, round(max(d), 5) AS most, round(stddev_pop(d), 5) AS std FROM x")
def _(spark, d):
    s = spectra(spark, d)
    out = D.summarize_distances(D.spectral_distance(s, _pairs(s), 16))
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


@query("d14_fused_gromov_wasserstein")
def _(spark, d):
    """Whole graphs, with the points as features; every pair."""
    nodes, edges = graph(spark, d)
    feats = nodes.groupBy("graph_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("node_id", F.array("x", "y", "z").alias("f")))), lambda s: s["f"]).alias("feats"))
    return D.gromov_wasserstein(P.distance_matrices(nodes, edges), _pairs(nodes), feats, 0.5, iterations=20)


# models


def _prepared(spark, d) -> tuple[DataFrame, list[str]]:
    df, names = learning_table(spark, d)
    return M.prepare(df, "id", "label", names, scaled=True)


@query("m01_prepared_with_holes", "WITH h AS (SELECT vec_id AS id, CASE WHEN vec_id % 4 <> 0 THEN embedding[1]::DOUBLE END AS f FROM embeddings), m AS (SELECT id, coalesce(f, (SELECT avg(f) FROM h)) AS f FROM h) SELECT id, round((f - avg(f) OVER ()) / stddev_pop(f) OVER (), 5) AS f0 FROM m")
def _(spark, d):
    df, _ = learning_table(spark, d)
    holes = df.withColumn("f0", F.when(F.col("id") % 4 != 0, F.col("f0")))
    return M.prepare(holes, "id", "label", ["f0"], scaled=True)[0].select("id", F.round("f0", 5).alias("f0"))


@query("m09_ridge_closed_form", "WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), z AS (SELECT (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, y, avg(y) OVER () AS m FROM p), w AS (SELECT sum(x * (y - m)) / (sum(x * x) + 1) AS w FROM z) SELECT round(avg(pow(y - m - w * x, 2)), 6) AS mse FROM z, w")
def _(spark, d):
    df, _ = learning_table(spark, d)
    data = X.scale(df.select("id", "f0", F.col("f1").alias("label")), ["f0"], "standardize")
    n, std = data.agg(F.count(F.lit(1)), F.stddev_samp("label")).first()
    model = M.train(data, ["f0"], {"ridge": M.ridge(n, std)})["ridge"]
    return M.regression_metrics(M.predict(model, data)).select(F.round("mse", 6).alias("mse"))


@query("m06_saved_model")
def _(spark, d):
    """Models of a split compared; the best saved, loaded, and asked again: it must say the same."""
    df, names = learning_table(spark, d)
    models, scores = M.train_and_evaluate(df, "id", "label", names, kinds=["logistic_regression", "random_forest"])
    best = R.best_by(scores, "model", "f1").first()["model"]
    path = scratch(spark, "model")
    sinks.save_model(models[best], path, names, {"f1": scores.filter(F.col("model") == best).first()["f1"]})
    loaded, features, _ = sinks.load_model(spark, path)
    data = X.scale(M.prepare(df, "id", "label", features)[0], features, "standardize").withColumn("label", F.col("label").cast("double"))
    a, b = M.predict(models[best], data), M.predict(loaded, data).select("id", F.col("prediction").alias("again"))
    return a.join(b, "id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("again")).alias("same"))


@query("m04_boosting")
def _(spark, d):
    data, names = _prepared(spark, d)
    n, std = data.agg(F.count(F.lit(1)), F.stddev_samp("label")).first()
    model = M.train(data, names, {"m": M.classifiers(n)["gradient_boosting"].setMaxIter(10)})["m"]
    return M.classification_metrics(M.predict(model, data, True), proba="proba")


@query("m10_regressors")
def _(spark, d):
    data, names = _prepared(spark, d)
    data = data.withColumn("label", F.col("f5"))
    n, std = data.agg(F.count(F.lit(1)), F.stddev_samp("label")).first()
    made = M.regressors(n, std)
    made["gradient_boosting"].setMaxIter(10)
    made["random_forest"].setNumTrees(20)
    return M.compare_models(M.train(data, names[:5], made), data, M.regression_metrics)


@query("m05_cross_validation")
def _(spark, d):
    data, names = _prepared(spark, d)
    return M.cross_validate(data, names, M.logistic(data.count()), "id", lambda p: M.classification_metrics(p).select("f1"))


@query("m16_named_models")
def _(spark, d):
    """All named kinds; those with a kernel on its random features."""
    data, names = _prepared(spark, d)
    data, kernel = M.fourier_features(data, names, 32)
    n = data.count()
    rows = []
    for kind in M.MODEL_KINDS:
        est = M.named_model(kind, n)
        est = est.setNumTrees(10) if kind.startswith("random") else est.setMaxIter(20)
        model = M.train(data, kernel if kind.startswith("sv") else names, {kind: est})[kind]
        rows.append(M.regression_metrics(M.predict(model, data)).withColumn("kind", F.lit(kind)))
    return R.union_all(*rows)


@query("m16_kernel_machines")
def _(spark, d):
    """Machines with a radial kernel over all rows: their metrics on the rows they were fitted on."""
    data, names = learning_table(spark, d)
    rows = []
    for kind in ("svr", "svc"):
        model = K.fit_kernel(data, names, "label", "id", kind)
        rows.append(M.regression_metrics(model.transform(data)).withColumn("kind", F.lit(kind)))
    return R.union_all(*rows)


@query("d15_matrix_rows", f"""WITH {SPECTRA}, x AS (SELECT a.id AS id, b.id AS other, round(sqrt(list_sum(list_transform(range(1, 17), lambda i: pow(a.eig[i] - b.eig[i], 2)))), 5) AS d FROM e a, e b)
    SELECT id, list(d ORDER BY other) AS "row" FROM x GROUP BY id""")
def _(spark, d):
    s = spectra(spark, d)
    return D.matrix_rows(D.spectral_distance(s, _pairs(s), 16).withColumn("d", F.round("d", 5)))


@query("m17_experiment_grid")
def _(spark, d):
    """Nodes of graphs of low labels told from others, with and without their graphs' spectra."""
    nodes = points(spark, d)
    extra = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), (F.col("label") < 5).cast("double").alias("low"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in (3, 4)])
    config = {
        "features": {"include_spectral": True, "spectral_k": 8}, "cosmology": {"graph": {"k_neighbors": 6}},
        "experiments": {"ablations": [{"name": "no_spectral", "features": {"include_spectral": False}}], "sensitivity": {"k_neighbors": [4], "spectral_k": [4]}},
    }
    return run_grid(nodes.join(extra, "node_id"), "low", ["x", "y", "z", "f3", "f4"], plan_grid(config))


@query("m14_assigned_labels", "SELECT vec_id AS id, CASE WHEN vec_id % 3 <> 0 THEN label END AS cluster_label FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return M.assign_labels(e.select("id"), e.filter("id % 3 <> 0").orderBy(F.desc("id")), "id")


@query("d16_cross_domain_sql", """WITH p AS (SELECT vec_id AS id, label < 5 AS one, (embedding[1]::DOUBLE - avg(embedding[1]::DOUBLE) OVER ()) / stddev_pop(embedding[1]::DOUBLE) OVER () AS x, (embedding[2]::DOUBLE - avg(embedding[2]::DOUBLE) OVER ()) / stddev_pop(embedding[2]::DOUBLE) OVER () AS y FROM embeddings)
    SELECT a.id AS id_a, b.id AS id_b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 5) AS d FROM p a JOIN p b ON NOT a.one AND b.one""")
def _(spark, d):
    df, names = learning_table(spark, d)
    return M.cross_domain_distances(df.filter("label = 0"), df.filter("label = 1"), names[:2], "id").withColumn("d", F.round("d", 5))


# whole values of aggregates and stores


@query("a05_overview_breakdown", f"SELECT key AS catalog_source, value::BIGINT AS n FROM (SELECT unnest(map_entries(map_from_entries(list((catalog_source, n)))), recursive := true) FROM (SELECT catalog_source, count(*) AS n FROM {CATALOG} GROUP BY 1))")
def _(spark, d):
    return R.overview(catalog(spark, d), "redshift", "catalog_source").select(F.explode("breakdown").alias("catalog_source", "n"))


@query("a08_key_value_entries", "SELECT event_type, count(*)::BIGINT AS n, max(ts) AS at FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("at"))
    return R.key_value_map(e, "event_type", "n", "at").select(F.explode("statistics").alias("event_type", "v")).select("event_type", "v.n", "v.at")


@query("a09_describe_quartiles", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, count(DISTINCT {c}) AS \"unique\", round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS q2, round(quantile_cont({c}, 0.75), 6) AS q3 FROM part" for c in ("p_partkey", "p_size", "p_retailprice")))
def _(spark, d):
    out = R.describe_all(table(spark, d, "part")).filter("quartiles is not null")
    return out.select("column", "count", "unique", *[F.round(F.get("quartiles", F.lit(i)), 6).alias(f"q{i + 1}") for i in range(3)])


@query("l06_best_by", "SELECT max(o_totalprice) AS o_totalprice, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS o_orderkey FROM orders")
def _(spark, d):
    return R.best_by(table(spark, d, "orders"), "o_orderkey", "o_totalprice")


@query("l08_matched_nodes", f"WITH {KNN}, c AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM points GROUP BY graph_id)), k AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY (node_id % 2147483648 * 1103515245 + 42) % 2147483648, node_id) AS r FROM points) SELECT graph_id, node_id FROM k, c WHERE r <= c.n")
def _(spark, d):
    """Which nodes each graph keeps, before they are numbered anew."""
    nodes, edges = graph(spark, d)
    marked = nodes.withColumn("old", F.col("node_id"))
    return G.match_sizes(marked, edges, 42, S.lcg_order)[0].select("graph_id", F.col("old").alias("node_id"))


@query(
    "l12_shuffled_labels_by_hash",
    """WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY (c_custkey % 2147483648 * 1103515245 + 42) % 2147483648, c_custkey) AS i FROM customer),
    b AS (SELECT c_mktsegment, row_number() OVER (ORDER BY (c_custkey % 2147483648 * 1103515245 + 43) % 2147483648, c_custkey) AS i FROM customer) SELECT c_custkey, c_mktsegment FROM a JOIN b USING (i)""",
)
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return S.shuffle_labels(c, "c_mktsegment", "c_custkey", 42, S.lcg_order)


@query("j05_replace_by_key", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 10 = 0 AND c_nationkey < 5) UNION ALL SELECT c_custkey, c_nationkey, 0.0 FROM customer WHERE c_custkey % 10 = 0 AND c_nationkey < 5")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    new = c.filter("c_custkey % 10 = 0 and c_nationkey < 5").withColumn("c_acctbal", F.lit(0.0))
    return R.replace_keys(c, new, ["c_nationkey"])


@query("k08_cache_of_old_and_new", "SELECT c_custkey::VARCHAR AS cache_key, CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE c_acctbal END AS cache_value FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 = 0")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cache_key"), F.col("c_acctbal").alias("cache_value"), "c_custkey")
    now = F.expr("timestamp '2024-01-15 00:00:00'")
    old = R.with_expiry(c.filter("c_custkey % 3 <> 0").drop("c_custkey"), now, 1)
    new = R.with_expiry(c.filter("c_custkey % 4 = 0").drop("c_custkey").withColumn("cache_value", F.lit(1.0)), now, 24)
    return R.upsert(old, new, "cache_key").select("cache_key", "cache_value")


@query("j08_attached_cell_counts", "SELECT p_partkey, count(*) OVER (PARTITION BY p_size // 5) AS n FROM part")
def _(spark, d):
    p = table(spark, d, "part").withColumn("cell", F.floor(F.col("p_size") / 5))
    return X.attach_cell_counts(p, "cell", "n").select("p_partkey", "n")


@query("f23_valid_redshift", f"SELECT bool_and(redshift BETWEEN 0 AND 20) AS valid FROM {CATALOG}")
def _(spark, d):
    return C.valid_redshift(catalog(spark, d))


@query("k07_packed_json", "SELECT c_custkey, json_extract_string(j, '$.c_name') AS c_name, json_extract_string(j, '$.c_acctbal')::DOUBLE AS c_acctbal FROM (SELECT c_custkey, json_object('c_name', c_name, 'c_acctbal', c_acctbal) AS j FROM customer)")
def _(spark, d):
    packed = R.pack_json(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_name", "c_acctbal"], "data")
    return packed.select("c_custkey", F.get_json_object("data", "$.c_name").alias("c_name"), F.get_json_object("data", "$.c_acctbal").cast("double").alias("c_acctbal"))
