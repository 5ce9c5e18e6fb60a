"""Machines with a radial kernel against a dual solved whole; graph, matrix and document readers; matrices of distances."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import distances as D
from skyloom.operators import kernels as K
from skyloom.sources import readers, sinks


def rows_of(spark, x, y):
    names = [f"f{i}" for i in range(x.shape[1])]
    data = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, " + ", ".join(f"{n} double" for n in names) + ", y double"), names


def whole_dual(x, y, gamma, c, epsilon):
    """Decision values of one dense problem, by projected coordinate pairs to a tight tolerance; the objective is checked by its gap."""
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    n = len(x)
    if epsilon is None:
        a, bias = K.solve_dual(kernel, y, -np.ones(n), c, np.zeros(n), 1e-10)
        w = a * y
    else:
        sign = np.r_[np.ones(n), -np.ones(n)]
        a, bias = K.solve_dual(np.tile(kernel, (2, 2)), sign, np.r_[epsilon - y, epsilon + y], c, np.zeros(2 * n), 1e-10)
        w = a[:n] - a[n:]
    f = kernel @ w + bias
    loss = np.maximum(0, 1 - y * f).sum() if epsilon is None else np.maximum(0, np.abs(y - f) - epsilon).sum()
    primal = 0.5 * w @ kernel @ w + c * loss
    dual = (a.sum() if epsilon is None else (y * w).sum() - epsilon * np.abs(w).sum()) - 0.5 * w @ kernel @ w
    assert abs(w.sum()) < 1e-9 and a.min() >= 0 and a.max() <= c and primal - dual < 1e-6 * max(1, primal)
    return f


def problem(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + 0.1 * rng.normal(size=n)


@pytest.mark.parametrize("block", [1000, 30])
@pytest.mark.parametrize("kind", ["svr", "svc"])
def test_machines_are_those_of_one_problem(spark, monkeypatch, kind, block):
    monkeypatch.setattr(K, "BLOCK", block)
    x, t = problem(160, 1)
    y = t if kind == "svr" else np.where(t > 0, 1.0, -1.0)
    df, names = rows_of(spark, x, y)
    model = K.fit_kernel(df, names, "y", "id", kind, c=2.0, tolerance=1e-6)
    gamma = 1 / (3 * x.var())
    got = {r["id"]: r for r in model.transform(df, decision="f").collect()}
    want = whole_dual(x, y, gamma, 2.0, 0.1 if kind == "svr" else None)
    assert max(abs(got[i]["f"][0] - want[i]) for i in got) < 1e-3
    for i, r in got.items():
        assert r["prediction"] == (r["f"][0] if kind == "svr" else 1.0 if r["f"][0] > 0 else -1.0)


def test_several_classes_vote(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [4, 0], [0, 4], [4, 4]])
    y = rng.integers(0, 4, 120)
    df, names = rows_of(spark, centres[y] + rng.normal(size=(120, 2)) * 0.4, y)
    model = K.fit_kernel(df, names, "y", "id")
    assert len(model.machines) == 6
    assert model.transform(df).filter("prediction <> y").count() == 0


def test_odd_rows_of_machines(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 2.0), (3, None, 3.0), (4, float("nan"), 1.0), (5, 0.5, None)], "id long, a double, y double")
    model = K.fit_kernel(df, ["a"], "y", "id", "svr")
    got = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert got[3] is None and got[4] is None and got[5] == pytest.approx(1.5, abs=0.2)
    one = K.fit_kernel(df.filter("id = 1"), ["a"], "y", "id", "svc")
    assert [r["prediction"] for r in one.transform(df.filter("id < 3")).collect()] == [1.0, 1.0]
    with pytest.raises(ValueError):
        K.fit_kernel(df.limit(0), ["a"], "y", "id")
    with pytest.raises(ValueError):
        K.fit_kernel(df, ["a"], "y", "id", "poly")


def test_too_many_support_vectors_are_refused(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST", 5)
    df, names = rows_of(spark, *problem(40, 3))
    with pytest.raises(ValueError, match="fourier_features"):
        K.fit_kernel(df, names, "y", "id", "svr")


def test_gexf_is_read_as_written(spark, tmp_path):
    nodes = spark.createDataFrame([("g", i) for i in range(3)], "graph_id string, node_id long")
    edges = spark.createDataFrame([("g", 0, 1, 0.5), ("g", 1, 2, 2.0)], "graph_id string, src long, dst long, weight double")
    text = sinks.graph_documents(nodes, edges, "gexf").first()["value"]
    (tmp_path / "g.gexf").write_text(text)
    got = sorted(tuple(r) for r in readers.read_gexf(spark, str(tmp_path / "g.gexf")).collect())
    assert got == [("g", "0", "1", 0.5), ("g", "1", "2", 2.0)]
    assert sorted(r["id"] for r in readers.read_gexf(spark, str(tmp_path / "g.gexf"), "node").collect()) == ["0", "1", "2"]


def test_distances_as_pairs_matrices_and_back(spark, tmp_path):
    d = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 3.0)], "id_a string, id_b string, d double")
    every = sorted(tuple(r) for r in D.symmetric(d).collect())
    assert every == [("a", "a", 0.0), ("a", "b", 1.0), ("a", "c", 2.0), ("b", "a", 1.0), ("b", "b", 0.0), ("b", "c", 3.0), ("c", "a", 2.0), ("c", "b", 3.0), ("c", "c", 0.0)]
    rows = sorted(tuple(r) for r in D.matrix_rows(d).collect())
    assert rows == [("a", [0.0, 1.0, 2.0]), ("b", [1.0, 0.0, 3.0]), ("c", [2.0, 3.0, 0.0])]
    sinks.save_distances(d, str(tmp_path / "pairs"))
    assert readers.read_distances(spark, str(tmp_path / "pairs")).count() == 3
    (tmp_path / "m.csv").write_text("id,x,y,z\n" + "".join(f"{n},{','.join(map(str, v))}\n" for n, v in rows))
    assert sorted(tuple(r) for r in readers.read_distances(spark, str(tmp_path / "m.csv"), "csv").collect()) == every
    (tmp_path / "n.csv").write_text("x,y,z\n" + "".join(f"{','.join(map(str, v))}\n" for _, v in rows))
    got = sorted(tuple(r) for r in readers.read_distances(spark, str(tmp_path / "n.csv"), "csv").collect())
    assert got == [tuple(f"graph_{'abc'.index(x)}" if isinstance(x, str) else x for x in r) for r in every]


def test_datasets_by_suffix(spark, tmp_path):
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(body.getvalue())
    assert [(r["paragraph"], r["text"]) for r in readers.read_dataset(spark, str(tmp_path / "d.docx")).orderBy("paragraph").collect()] == [(0, "One line"), (1, "")]
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,x\n")
    assert readers.read_dataset(spark, str(tmp_path / "t.csv")).count() == 2
    about = {r["column"]: r for r in readers.read_dataset(spark, str(tmp_path / "t.csv"), describe=True).collect()}
    assert about["b"]["top"] == "x" and about["a"]["unique"] == 2
    with pytest.raises(ValueError):
        readers.read_dataset(spark, str(tmp_path / "t.pdf"))


def test_links_of_papers_and_boxes_across_zero(spark):
    json = ['{"paperId": "p", "citations": [{"paperId": "q", "title": "Q", "year": 1}, {"title": "gone"}], "references": []}', "{}", None, "broken"]
    got = [tuple(r) for r in readers.paper_links(spark.createDataFrame([(j,) for j in json], "json string")).orderBy("place").collect()]
    assert got == [("p", "citation", 0, "q", "Q", 1), ("p", "citation", 1, None, "gone", None)]
    sky = spark.createDataFrame([(359.0, 0.0), (1.0, 0.0), (5.0, 0.0), (180.0, 0.0), (359.0, 9.0)], "ra double, dec double")
    assert sorted(r["ra"] for r in readers.coordinate_box(sky, 0.5, 0.0, 2.0).collect()) == [1.0, 359.0]
    assert readers.coordinate_box(sky.select(F.col("ra"), F.lit(None).cast("double").alias("dec")), 0, 0, 5).count() == 0
