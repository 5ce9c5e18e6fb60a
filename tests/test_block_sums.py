"""Sums of distances between blocks of points."""

import numpy as np

from skyloom.operators import learning as M


def test_blocks_meet_once_and_copies_are_at_no_distance(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) + 1e4  # products lose digits far from zero
    x[200:] = x[:100]
    c = rng.integers(0, 4, 300)
    data = spark.createDataFrame([(i, int(c[i]), x[i].tolist()) for i in range(300)], "id long, c int, v array<double>")
    monkeypatch.setattr(M, "PAIR_BLOCK", 40)
    met = []
    explode = M.F.explode
    monkeypatch.setattr(M.F, "explode", lambda e: met.append(e) or explode(e))
    rows = M._distance_sums(data).collect()
    assert len(met) == 2 and "sequence(0, _b)" in str(met[1]), "each block meets only those up to itself"
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {(r["id"], r["c2"]): (r["s"], r["k"]) for r in rows}
    for i in range(300):
        for g in range(4):
            n = int((c == g).sum()) - (c[i] == g)
            assert got[i, g][1] == n and abs(got[i, g][0] - d[i, c == g].sum()) < 1e-7
