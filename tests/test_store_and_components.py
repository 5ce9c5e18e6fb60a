"""The keyed store, contracted components, sampling by bins, descriptions by counts, distance sums by blocks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import columns as C
from skyloom.operators import graphs as G
from skyloom.operators import learning as M
from skyloom.operators import relational as R
from skyloom.operators import sampling as S
from skyloom.operators import scaling as X
from skyloom.sources.store import Conflict, Store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), "id", 8)


def frame(spark, ids, value, schema="id long, value string"):
    return spark.createDataFrame([(i, value) for i in ids], schema)


def test_upserts_replace_and_add(spark, store):
    assert store.read() is None and store.versions() == []
    assert store.upsert(frame(spark, range(40), "a")) == {"inserted": 40, "updated": 0}
    assert store.upsert(frame(spark, [*range(30, 50), None], "b")) == {"inserted": 10, "updated": 10}
    assert rows(store.read()) == [(i, "b" if i >= 30 else "a") for i in range(50)]
    assert rows(store.read(1)) == [(i, "a") for i in range(40)]
    assert store.upsert(frame(spark, [], "c")) == {"inserted": 0, "updated": 0}


def test_only_touched_buckets_are_written(spark, store):
    store.upsert(frame(spark, range(100), "a"))
    store.upsert(frame(spark, [7], "b"))
    named = store._manifest()["folders"]
    assert len(named) == 8 and len([f for f in named.values() if f.startswith("000000000002")]) == 1


def test_a_failure_between_write_and_switch_changes_nothing(spark, store, monkeypatch):
    store.upsert(frame(spark, range(20), "a"))
    store.upsert(frame(spark, range(10), "b"))
    before = rows(store.read())

    def fails(*_):
        raise OSError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_switch", fails)
        with pytest.raises(OSError):
            store.upsert(frame(spark, range(15, 30), "c"))
    assert rows(store.read()) == before and store.versions() == [1, 2]
    again = Store(spark, store.path, "id", 99)
    assert again.buckets == 8 and again.delete(F.col("id") < 5) == 5
    assert rows(again.read()) == [r for r in before if r[0] >= 5]
    left = len(os.listdir(f"{store.path}/data"))
    assert again.vacuum() >= 1 and len(os.listdir(f"{store.path}/data")) < left
    assert set(os.listdir(f"{store.path}/data")) == set(again._manifest()["folders"].values())
    assert rows(again.read()) == [r for r in before if r[0] >= 5] and again.versions() == [3]


def test_two_writers_do_not_both_win(spark, store, monkeypatch):
    store.upsert(frame(spark, range(5), "a"))
    seen = store._manifest()
    store.upsert(frame(spark, range(5), "b"))
    monkeypatch.setattr(Store, "_manifest", lambda self, version=None: seen)
    with pytest.raises(Conflict):
        store.upsert(frame(spark, range(5), "c"))
    monkeypatch.undo()
    assert {r[1] for r in rows(store.read())} == {"b"}


def test_expiry_deletes_and_new_columns_are_null_before(spark, store):
    store.upsert(frame(spark, range(6), "a"))
    at = F.when(F.col("id") < 8, F.expr("timestamp '2024-01-01 00:00:00'"))
    store.upsert(frame(spark, range(4, 10), "b").withColumn("at", at))
    assert store.expire("at", F.expr("timestamp '2024-01-09 00:00:00'"), 7) == 4
    assert [(r["id"], r["value"], r["at"]) for r in sorted(store.read().collect())] == [(i, "a", None) for i in range(4)] + [(8, "b", None), (9, "b", None)]
    assert store.expire("at", F.expr("timestamp '2024-01-09 00:00:00'"), 7) == 0
    assert store.delete(F.lit(True)) == 6 and store.read().count() == 0 and store.upsert(frame(spark, [1], "z"))["inserted"] == 1


@pytest.mark.parametrize("bound", [0, 10**6])
def test_components_of_every_shape(spark, monkeypatch, bound):
    monkeypatch.setattr(G, "COMPONENT_EDGES", bound)
    rng = np.random.default_rng(1)
    nodes, edges, want = [], [], {}
    for g, n, m in (("sparse", 300, 200), ("dense", 60, 400), ("none", 5, 0)):
        nodes += [(g, 2 * i) for i in range(n)]
        label = np.arange(n)
        for a, b in rng.integers(0, n, (m, 2)):
            edges.append((g, int(2 * a), int(2 * b), 1.0))
            label[label == max(label[a], label[b])] = min(label[a], label[b])
        want |= {(g, 2 * i): 2 * int(label[i]) for i in range(n)}
    n = spark.createDataFrame(nodes, "graph_id string, node_id long")
    e = spark.createDataFrame(edges, "graph_id string, src long, dst long, weight double")
    got = {(r["graph_id"], r["node_id"]): r["component"] for r in G.connected_components(n, e).collect()}
    assert got == want


def test_a_long_path_contracts_in_few_rounds(spark, monkeypatch):
    n = 100_000
    monkeypatch.setattr(G, "COMPONENT_EDGES", 0)
    nodes = spark.range(n).select(F.lit("p").alias("graph_id"), F.col("id").alias("node_id"))
    edges = spark.range(n - 1).select(F.lit("p").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/skyloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    labels = G.connected_components(nodes, edges, rounds=20)
    assert labels.agg(F.min("component"), F.max("component"), F.count("*")).first()[:] == (0, 0, n)
    assert len(set(os.listdir(folder)) - before) <= 2  # the sizes and the last labels


def test_samples_by_group_go_by_bins(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 10 == 0, "few").when(F.col("id") % 2 == 0, "many").alias("g"))
    for order in (S.hash_order, S.lcg_order):
        got = S.sample_n_by(df, 700, ["g"], "id", 3, order).withColumn("o", order(F.col("id"), 3)).collect()
        every = df.withColumn("o", order(F.col("id"), 3)).collect()
        for g in ("few", "many", None):
            want = sorted((r["o"], r["id"]) for r in every if r["g"] == g)[:700]
            assert sorted((r["o"], r["id"]) for r in got if r["g"] == g) == want


def test_gaps_are_filled_across_ranges(spark):
    rng = np.random.default_rng(2)
    known = rng.random(3000) < 0.02
    y = rng.normal(size=3000)
    rows = [(int(i), float(y[i]) if known[i] else None, float(i) if i in (700, 2100) else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "t long, x double, z double").repartition(7)
    got = {r["t"]: (r["x"], r["z"]) for r in C.fill_missing(df, ["x", "z"], "interpolate", "t").collect()}
    at = np.flatnonzero(known)
    want = np.interp(np.arange(3000), at, y[at])
    for t in range(3000):
        assert got[t][0] == (None if t < at[0] or t > at[-1] else pytest.approx(want[t])) and got[t][1] == (pytest.approx(t) if 700 <= t <= 2100 else None)
    assert C.fill_missing(df.limit(0), ["x"], "interpolate", "t").count() == 0


def test_labels_are_numbered_in_order(spark):
    df = spark.createDataFrame([(f"v{i % 300:03d}" if i % 7 else None,) for i in range(2000)], "c string")
    for r in X.encode_labels(df, "c", "code").collect():
        assert r["code"] == (None if r["c"] is None else int(r["c"][1:]))


def test_relabel_counts_on_within_graphs(spark):
    nodes = spark.createDataFrame([(g, 7 * i + len(g)) for g in ("a", "bb", "c") for i in range(25)], "graph_id string, node_id long")
    edges = nodes.select("graph_id", F.col("node_id").alias("src"), (F.col("node_id") + 7).alias("dst"), F.lit(1.0).alias("weight"))
    edges = G.induced(edges, nodes)
    new, moved = G.relabel(nodes, edges)
    assert rows(new.select("graph_id", "node_id")) == [(g, i) for g in ("a", "bb", "c") for i in range(25)]
    assert rows(moved.select("graph_id", "src", "dst")) == [(g, i, i + 1) for g in ("a", "bb", "c") for i in range(24)]


def test_descriptions_count_values_first(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (2, "a"), (None, "b"), (3, None)], "x int, y string")
    got = {r["column"]: r for r in R.describe_all(df).collect()}
    assert (got["x"]["count"], got["x"]["unique"], got["x"]["top"], got["x"]["mean"], list(got["x"]["quartiles"])) == (4, 3, "2", 2.0, [1.75, 2.0, 2.25])
    assert (got["y"]["count"], got["y"]["unique"], got["y"]["top"], got["y"]["mean"]) == (4, 2, "a", None)
    empty = {r["column"]: r for r in R.describe_all(df.limit(0)).collect()}
    assert empty["x"]["count"] == empty["x"]["unique"] == 0 and empty["y"]["top"] is None
    medians = R.summarize(spark.createDataFrame([("a", 1.0), ("a", 4.0), (None, 2.0), (None, None)], "g string, v double"), ["g"], ["v"], ["median", "count"])
    assert {r["g"]: (r["v__median"], r["v__count"]) for r in medians.collect()} == {"a": (2.5, 2), None: (2.0, 1)}


@pytest.mark.parametrize("block", [7, 1024])
def test_silhouette_by_blocks_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(M, "PAIR_BLOCK", block)
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(60, 3)), np.array([*rng.integers(0, 3, 58), 3, -1])
    x[:20] += 3 * c[:20, None]
    df = spark.createDataFrame([(i, *map(float, x[i]), int(c[i])) for i in range(60)], "id long, a double, b double, d double, cluster int")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    scores = []
    for i in range(59):
        mean = {k: d[i, [j for j in range(59) if c[j] == k and j != i]].mean() for k in set(c[:59]) if k != c[i] or (c[:59] == k).sum() > 1}
        a, b = mean.get(c[i]), min(v for k, v in mean.items() if k != c[i])
        scores.append(0.0 if a is None else (b - a) / max(a, b))
    got = M.clustering_metrics(df, ["a", "b", "d"], "id").first()
    assert abs(got["silhouette"] - np.mean(scores)) < 1e-12
