"""Files, stored systems, models and spectra: what is written comes back, and what has a closed form agrees with it."""

import itertools
import math
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions.coords import add_proxy_cartesian
from skyloom.operators import distances as D
from skyloom.operators import embeddings as E
from skyloom.operators import graphs as G
from skyloom.operators import learning as M
from skyloom.operators import paths as P
from skyloom.operators import relational as R
from skyloom.operators import spectral as Q
from skyloom.plans import experiment as X
from skyloom.session import get_session
from skyloom.sources import readers, sinks
from skyloom.streaming.tiles import new_objects


@pytest.fixture
def two(spark):
    nodes = spark.createDataFrame([("a<1>", i) for i in range(4)] + [("b", 0)], "graph_id string, node_id long")
    edges = spark.createDataFrame([("a<1>", 0, 1, 0.5), ("a<1>", 1, 2, 2.0), ("a<1>", 2, 3, 1.0)], "graph_id string, src long, dst long, weight double")
    return nodes, edges


@pytest.mark.parametrize("kind", ["graphml", "gexf"])
def test_graph_documents_are_xml(two, kind):
    found = {r["graph_id"]: ET.fromstring(r["value"].encode()) for r in sinks.graph_documents(*two, kind).collect()}
    assert set(found) == {"a<1>", "b"}
    tags = lambda g, t: [e for e in g.iter() if e.tag.endswith("}" + t)]
    assert [e.attrib["id"] for e in tags(found["a<1>"], "node")] == ["0", "1", "2", "3"] and len(tags(found["b"], "edge")) == 0
    assert [(e.attrib["source"], e.attrib["target"]) for e in tags(found["a<1>"], "edge")] == [("0", "1"), ("1", "2"), ("2", "3")]


def test_graphs_saved_and_loaded(spark, two, tmp_path):
    sinks.save_graph(*two, str(tmp_path / "g"))
    nodes, edges = sinks.load_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == 5 and sorted(r["weight"] for r in edges.collect()) == [0.5, 1.0, 2.0]
    sinks.save_graph(*two, str(tmp_path / "x"), "graphml")
    got = readers.read_graphml(spark, str(tmp_path / "x/graphml/*"))
    assert sorted((r["source"], r["target"]) for r in got.collect()) == [("0", "1"), ("1", "2"), ("2", "3")]
    sinks.save_distances(spark.createDataFrame([("m", 1, 2, 0.5)], "method string, id_a long, id_b long, d double"), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).first()["d"] == 0.5


def test_grid_system_without_operator(spark, tmp_path):
    g = G.grid_2d(spark, 3, 3, (0.0, 1.0), (0.0, 1.0))
    sinks.save_grid_system(g, None, {"kind": "well"}, str(tmp_path / "s"))
    grid, matrix, about = readers.load_grid_system(spark, str(tmp_path / "s"))
    assert grid.count() == 9 and matrix is None and about == {"kind": "well"}


def test_records_reports_presets_and_logs(spark, tmp_path):
    record = sinks.manifest({"n": 3}, {"points": "p"}, "demo", "note", "abc")
    sinks.write_json(spark, record, str(tmp_path / "m"))
    assert '"preset": "demo"' in spark.read.text(str(tmp_path / "m")).first()[0]
    report = R.markdown_report(spark.createDataFrame([(1, "x")], "a long, b string"), "T")
    assert report.startswith("# T") and "Rows: 1" in report and "| a | bigint |" in report
    for i in range(2):
        sinks.append_log(spark.createDataFrame([(i,)], "query long"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    (tmp_path / "p.yaml").write_text("presets:\n  small:\n    ra: [0, 10]\n    k: 3\n    unknown: 1\n")
    preset = X.Preset.of("small", readers.load_preset(str(tmp_path / "p.yaml"), "small"))
    assert preset.ra == (0, 10) and preset.k == 3
    with pytest.raises(ValueError):
        readers.load_preset(str(tmp_path / "p.yaml"), "large")
    assert list(X.expand_experiments(X.Experiment(), True, (4,))) == ["baseline", "without_topology", "without_spectral", "without_paths", "eigenvalues_4"]
    assert readers.storage_paths("/r/")["graphs"] == "/r/graphs"
    assert get_session() is not None


def test_catalogs_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.0, 5.0, 0.2), (2, 20.0, 6.0, 0.9)], "TARGETID long, RA double, DEC double, Z double")
    df.write.parquet(str(tmp_path / "c.parquet"))
    names = {k: v for k, v in readers.SURVEY_COLUMNS.items() if k != "weight"}
    got = readers.load_catalog(spark, readers.CatalogSource("c", str(tmp_path / "c.parquet"), None, names), 1)
    assert got.count() == 1 and set(got.columns) == {"obj_id", "ra_deg", "dec_deg", "z"}
    with pytest.raises(ValueError, match="no rows"):
        readers.load_first([lambda: df.limit(0)])
    (tmp_path / "x.xml").write_text("<all><row><a>1</a></row><row><a>2</a></row></all>")
    assert readers.read_any(spark, str(tmp_path / "x.xml"), row_tag="row").count() == 2
    assert {r["X"] for r in add_proxy_cartesian(df.select(F.col("RA").alias("ra"))).collect()} == {None}


def test_new_objects_come_once(spark, tmp_path):
    schema = "id long, at timestamp"
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:00")], "id long, at string").selectExpr("id", "cast(at as timestamp) at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = new_objects(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "id", "at")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_models_saved_loaded_and_named(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 2))
    rows = [(i, float(a), float(b), float(a * a + b * b > 1.2)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    kernel, names = M.fourier_features(df, ["a", "b"], 100, 0.5)
    flat, round_ = (M.train(t, f, {"m": M.named_model("svc", 150)})["m"] for t, f in ((df, ["a", "b"]), (kernel, names)))
    right = [M.classification_metrics(M.predict(m, t)).first()["accuracy"] for m, t in ((flat, df), (round_, kernel))]
    assert right[1] > 0.93 > right[0]
    sinks.save_model(flat, str(tmp_path / "m"), ["a", "b"], {"accuracy": right[0]})
    loaded, features, metrics = sinks.load_model(spark, str(tmp_path / "m"))
    assert features == ["a", "b"] and metrics["accuracy"] == right[0]
    assert M.predict(loaded, df).select("prediction").collect() == M.predict(flat, df).select("prediction").collect()
    with pytest.raises(ValueError):
        M.predict(flat, df, True)
    with pytest.raises(ValueError):
        M.named_model("oracle", 3)
    cells = {(r["label"], r["prediction"]): r["n"] for r in M.confusion(M.predict(flat, df)).collect()}
    assert sum(cells.values()) == 150
    cv = M.cross_validate(df, ["a", "b"], M.logistic(150), "id", lambda p: M.classification_metrics(p).select("accuracy"), 3).first()
    assert 0 <= cv["cv_mean"] <= 1 and cv["cv_std"] >= 0
    assert df.select(M.binary_label(F.lit("A Quantum well"))).first()[0] == 1.0


def test_spectral_numbers_of_a_complete_graph(spark):
    n = 5
    nodes = spark.createDataFrame([("k", i) for i in range(n)], "graph_id string, node_id long")
    edges = spark.createDataFrame([("k", i, j, 1.0) for i, j in itertools.combinations(range(n), 2)], "graph_id string, src long, dst long, weight double")
    r = Q.spectral_features(Q.spectrum(nodes, edges, None)).first().asDict()
    values = [0.0] + [n / (n - 1)] * (n - 1)
    assert r["eig"] == pytest.approx(values, abs=1e-9)
    shares = [v / sum(values) for v in values if v > 0]
    assert any(isinstance(v, float) and v == pytest.approx(-sum(p * math.log(p) for p in shares), abs=1e-6) for v in r.values())
    enc = Q.positional_encoding(nodes, edges, 2).collect()
    assert len(enc) == 1 and len(enc[0]["pe"]) == 2
    flat = Q.matrix_spectrum(spark.createDataFrame([("m", i, i, float(i)) for i in range(4)], "graph_id string, i long, j long, value double"), 4)
    assert Q.state_features(flat).count() == 1


def test_distances_with_closed_forms(spark):
    s = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 3.0, 4.0])], "graph_id string, eig array<double>")
    pairs = spark.createDataFrame([("a", "b")], "id_a string, id_b string")
    assert D.spectral_distance(s, pairs).first()["d"] == pytest.approx(2.0)
    assert D.spectral_distance(s, pairs, 3).first()["d"] == pytest.approx(math.sqrt(20))
    assert D.spectral_distance(s, pairs, 3, "l1").first()["d"] == pytest.approx(6.0)
    same = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 1.0])], "graph_id string, eig array<double>")
    assert D.spectral_divergence(same, pairs).first()["d"] == pytest.approx(0.0, abs=1e-9)
    assert D.spectral_divergence(s, pairs).first()["d"] > 0.1


def brute_gromov(x, y):
    n = len(x)
    best = min(((x - y[np.ix_(p, p)]) ** 2).sum() for p in map(list, itertools.permutations(range(n))))
    return math.sqrt(best) / n


def test_gromov_wasserstein_is_near_the_best_permutation(spark):
    """Graphs of five nodes against every matching of their nodes."""
    rng = np.random.default_rng(3)
    mats, rows = {}, []
    for g in "abcd":
        p = rng.uniform(0, 1, (5, 2))
        mats[g] = np.linalg.norm(p[:, None] - p[None, :], axis=2)
        rows.append((g, mats[g].tolist()))
    tables = spark.createDataFrame(rows, "graph_id string, matrix array<array<double>>")
    pairs = spark.createDataFrame(list(itertools.combinations("abcd", 2)), "id_a string, id_b string")
    for r in D.gromov_wasserstein(tables, pairs).collect():
        assert r["d"] <= brute_gromov(mats[r["id_a"]], mats[r["id_b"]]) * 1.1 + 1e-6
    feats = spark.createDataFrame([(g, [[float(ord(g))]] * 5) for g in "abcd"], "graph_id string, feats array<array<double>>")
    fused = {(r["id_a"], r["id_b"]): r["d"] for r in D.gromov_wasserstein(tables, pairs, feats, 0.0).collect()}
    assert fused["a", "c"] == pytest.approx(2.0) and fused["a", "b"] == pytest.approx(1.0)


def test_embeddings_and_features_by_graph(spark, two):
    nodes, edges = two[0].filter("graph_id = 'a<1>'"), two[1]
    vectors = E.node_embeddings(nodes, edges, dim=3, walks=3, length=6, window=2)
    assert vectors.count() == 4
    found = E.embedding_features(nodes, edges, dim=3, walks=3, length=6, window=2)
    assert found.count() == 1
    stats = G.graph_statistics(nodes, edges, connected=True).first()
    assert stats["n_components"] == 1 and stats["clustering"] == 0.0
    d = D.combined_distance(*two, D.all_pairs(two[0].select(F.col("graph_id").alias("id")))).collect()
    assert len(d) == 1 and d[0]["d"] is None and P.distance_matrices(nodes, edges).count() == 1


def test_scaled_fits_columns(spark, tmp_path):
    import struct

    from skyloom.sources.fits import BLOCK
    from tests.test_sources import card

    fields = [("A", "I", {"TZERO": "32768"}), ("B", "J", {"TSCAL": "0.5", "TZERO": "10", "TNULL": "-1"}), ("C", "J", {"TNULL": "-9"})]
    heads = [card("XTENSION", "'BINTABLE'"), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", "10"), card("NAXIS2", "2"), card("PCOUNT", "0"), card("GCOUNT", "1"), card("TFIELDS", "3")]
    for i, (name, form, more) in enumerate(fields, 1):
        heads += [card(f"TTYPE{i}", f"'{name}'"), card(f"TFORM{i}", f"'{form}'"), *(card(f"{k}{i}", v) for k, v in more.items())]
    head = "".join([*heads, "END".ljust(80)]).encode()
    head = head.ljust(-(-len(head) // BLOCK) * BLOCK)
    primary = "".join([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), "END".ljust(80)]).ljust(BLOCK).encode()
    body = struct.pack(">hii", -32768, 4, 7) + struct.pack(">hii", 32767, -1, -9)
    (tmp_path / "s.fits").write_bytes(primary + head + body.ljust(BLOCK, b"\0"))
    assert [tuple(r) for r in readers.read_any(spark, str(tmp_path / "s.fits")).collect()] == [(0, 12.0, 7), (65535, None, None)]
