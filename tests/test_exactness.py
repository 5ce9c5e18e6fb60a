"""Distributed selection, sky joins and catalog rules against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import staging
from skyloom.operators import columns as C
from skyloom.operators import learning as M
from skyloom.operators import neighbors as N
from skyloom.operators import quantiles as Q
from skyloom.operators import sampling as S
from skyloom.operators import scaling as X


def separation(a, b):
    (ra, dec), (rb, deb) = np.radians(a), np.radians(b)
    h = np.sin((deb - dec) / 2) ** 2 + np.cos(dec) * np.cos(deb) * np.sin((rb - ra) / 2) ** 2
    return np.degrees(2 * np.arcsin(min(1.0, np.sqrt(h))))


@pytest.mark.parametrize("low, high, radius", [(89.99, 90, 0.001), (89.9, 90, 0.01), (88, 90, 0.5), (-90, -88, 0.5), (-30, 90, 5), (-90, 90, 2), (84, 86, 0.3), (-90, 90, 70)])
def test_cross_match_is_exact_to_the_poles(spark, low, high, radius):
    rng = np.random.default_rng(1)
    points = [(i, float(ra), float(dec)) for i, (ra, dec) in enumerate(zip(rng.uniform(0, 360, 150), rng.uniform(low, high, 150)))]
    points += [(900, 0.0, (low + high) / 2), (901, 359.9999, (low + high) / 2), (902, 0.0001, (low + high) / 2), (903, 12.0, float(high)), (904, 200.0, float(low))]
    df = spark.createDataFrame(points, "id long, ra double, dec double")
    got = {(r["id_a"], r["id_b"]) for r in N.cross_match(df, df, radius).collect()}
    found = N.cross_match(df, df, radius).count()
    want = {}
    for a, b in itertools.product(points, points):
        want[a[0], b[0]] = separation(a[1:], b[1:])
    edge = {k for k, d in want.items() if abs(d - radius) < 1e-9}
    assert got - edge == {k for k, d in want.items() if d <= radius} - edge and found == len(got)


@pytest.mark.parametrize("rounds, salts", [(8, 64), (0, 3), (1, 2)])
def test_knn_of_a_large_group_with_outliers(spark, rounds, salts, monkeypatch):
    monkeypatch.setattr(N, "SALTS", salts)
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(0, 1, (6, 2)) * 400])
    df = spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate(p)], "graph_id string, node_id long, x double, y double")
    got = {(r["src"], r["dst"], r["rank"]) for r in N.knn(df, 3, ("x", "y"), small=10, rounds=rounds).collect()}
    want = set()
    for i in range(len(p)):
        d = sorted((float(np.hypot(*(p[i] - p[j]))), j) for j in range(len(p)) if j != i)
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(d[:3])}
    assert got == want


@pytest.mark.parametrize("direct", [10**6, 50])
def test_quantiles_are_exact(spark, direct, monkeypatch):
    monkeypatch.setattr(Q, "DIRECT", direct)
    rng = np.random.default_rng(3)
    rows = [(int(i % 3), float(x), float(t), None if i % 5 else float(x)) for i, (x, t) in enumerate(zip(rng.normal(0, 1, 700), rng.integers(0, 4, 700)))]
    df = spark.createDataFrame(rows, "g int, x double, ties double, holes double").repartition(3)
    qs = (0.0, 0.01, 0.25, 0.5, 0.995, 1.0)
    row = Q.row_of(df, ["x", "ties", "holes"], qs)
    for c, k in (("x", 1), ("ties", 2), ("holes", 3)):
        assert row[c] == pytest.approx(list(np.quantile([r[k] for r in rows if r[k] is not None], qs)))
    for r in Q.quantiles(df, ["x", "ties"], qs, ["g"]).collect():
        mine = [v for v in rows if v[0] == r["g"]]
        assert r["q__x"] == pytest.approx(list(np.quantile([v[1] for v in mine], qs)))
        assert r["q__ties"] == pytest.approx(list(np.quantile([v[2] for v in mine], qs)))


def test_quantiles_of_many_equal_values_and_none(spark, monkeypatch):
    monkeypatch.setattr(Q, "DIRECT", 5)
    df = spark.createDataFrame([(1.0,)] * 40 + [(2.0,)], "x double")
    assert Q.row_of(df, ["x"], (0.5, 1.0))["x"] == [1.0, 2.0]
    assert Q.row_of(df.limit(0), ["x"], (0.5,))["x"] is None
    assert Q.row_of(df.withColumn("x", F.lit(None).cast("double")), ["x"], (0.5,))["x"] is None


def lcg(k, seed):
    return (k % 2147483648 * 1103515245 + seed) % 2147483648


@pytest.mark.parametrize("n", [0, 1, 37, 500, 900])
def test_sample_n_takes_the_first_by_hash(spark, n):
    df = spark.range(500).withColumnRenamed("id", "k").repartition(3)
    want = sorted(range(500), key=lambda k: (lcg(k, 42), k))[:n]
    assert sorted(r["k"] for r in S.sample_n(df, n, "k", 42, S.lcg_order).collect()) == sorted(want)
    assert S.sample_n(df, n, "k").count() == min(n, 500) and S.sample_n(df.limit(0), n, "k").count() == 0


def test_exact_split_of_skewed_and_null_classes(spark):
    rows = [(i, "a" if i % 10 else ("b" if i % 20 else None)) for i in range(1000)]
    out = S.exact_split(spark.createDataFrame(rows, "k long, c string").repartition(4), "c", "k", 0.3, 42, S.lcg_order).collect()
    for c in ("a", "b", None):
        mine = sorted((k for k, x in rows if x == c), key=lambda k: (lcg(k, 42), k))
        test = {r["k"] for r in out if r["c"] == c and r["is_test"]}
        assert test == set(mine[: round(len(mine) * 0.3)]) and sum(r["c"] == c for r in out) == len(mine)
    whole = S.exact_split(spark.range(50), None, "id", 0.2).filter("is_test").count()
    assert whole == 10


def test_shuffled_labels_are_a_permutation_and_move(spark):
    df = spark.range(300).withColumn("label", F.col("id") * 2)
    out = S.shuffle_labels(df, "label", "id").collect()
    assert sorted(r["id"] for r in out) == list(range(300)) and sorted(r["label"] for r in out) == list(range(0, 600, 2))
    assert sum(r["label"] != 2 * r["id"] for r in out) > 250 and out[0].asDict().keys() == {"id", "label"}


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), int(n)) for x, n in zip(rng.permutation(200), rng.integers(0, 9, 200))]
    out = staging.running_sum(spark.createDataFrame(rows, "x double, n long").repartition(3), ["x"], F.col("n"), "below").collect()
    assert {r["x"]: r["below"] for r in out} == {x: sum(m for y, m in rows if y < x) for x, n in rows}


def test_roc_auc_with_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(float(rng.integers(0, 2)), float(rng.integers(0, 12))) for _ in range(150)]
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert M.roc_auc(spark.createDataFrame(rows, "label double, score double"), "label", "score").first()[0] == pytest.approx(want)


def test_ids_are_made_only_if_all_are_null(spark):
    vital, optional = {"object_id": ("oid",), "ra": ("ra",), "dec": ("dec",)}, {"redshift": ("z",)}
    rows = [(None, 1.0, 2.0), (None, 3.0, 4.0), (None, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "oid string, ra double, dec double")
    one = {r["object_id"] for r in C.normalize_catalog(df, "demo", vital, optional).collect()}
    two = {r["object_id"] for r in C.normalize_catalog(df.repartition(3), "demo", vital, optional).collect()}
    assert one == two and len(one) == 3 and all(i.startswith("DEMO_") for i in one)
    some = spark.createDataFrame([("a", 1.0, 2.0), (None, 3.0, 4.0)], "oid string, ra double, dec double")
    assert {r["object_id"] for r in C.normalize_catalog(some, "demo", vital, optional).collect()} == {"a", None}
    assert C.normalize_catalog(df.limit(0), "demo", vital, optional).count() == 0
    with pytest.raises(ValueError):
        C.normalize_catalog(df.drop("oid"), "demo", vital, optional)


def test_interpolation_and_other_fills(spark):
    rows = [(1, None, "a"), (2, 4.0, "a"), (4, None, None), (5, 10.0, "b"), (6, None, "b"), (7, 10.0, "b")]
    df = spark.createDataFrame(rows, "t long, x double, s string")
    got = {r["t"]: r["x"] for r in C.fill_missing(df, ["x"], "interpolate", "t").collect()}
    assert got == {1: None, 2: 4.0, 4: 8.0, 5: 10.0, 6: 10.0, 7: 10.0}
    assert {r["t"]: r["x"] for r in C.fill_missing(df, ["x"], "mode").collect()}[1] == 10.0
    assert C.fill_missing(df, ["x"], "drop").count() == 3
    assert C.fill_missing(df, ["s"], "unknown").filter("s = 'unknown'").count() == 1
    with pytest.raises(ValueError):
        C.fill_missing(df, ["x"], "guess")


def test_health_score_of_a_table_with_holes_and_copies(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (3, "y")], "a long, b string")
    r = C.health_score(df).first()
    assert (r["n"], r["present"], r["distinct_share"]) == (4, 0.75, 0.75) and r["score"] == pytest.approx(65.625) and r["band"] == "fair"


def test_engineered_grid_features(spark):
    rng = np.random.default_rng(7)
    p = rng.uniform(0, 10, (60, 3))
    df = spark.createDataFrame([(i, *map(float, x), float(x[0]) / 5) for i, x in enumerate(p)], "id long, X double, Y double, Z double, redshift double")
    low, high = p.min(axis=0), p.max(axis=0)
    cell = np.minimum(((p - low) / (high - low) * 10).astype(int), 9) @ [100, 10, 1]
    for r in X.engineer_features(df).collect():
        assert r["grid_cell_id"] == cell[r["id"]] and r["local_density_grid_approx"] == (cell == cell[r["id"]]).sum()
        assert r["distance_3d"] == pytest.approx(np.linalg.norm(p[r["id"]])) == r["angular_diameter_distance_mpc"]


def test_cross_match_keeps_its_tasks(spark):
    """Few bytes of many pairs: the plan does not join them all in one task."""
    df = spark.range(400).select("id", (F.col("id") * 0.7).alias("ra"), (F.col("id") % 17 - 8.0).alias("dec"))
    found = N.cross_match(df, df, 3.0)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert found.filter("id_a = id_b").count() == 400
