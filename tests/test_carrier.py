"""Transport plans that go on from the tree of the cost before, and matchings made better by swaps."""

import numpy as np

from skyloom.operators import distances as D


def test_a_similar_cost_takes_few_exchanges(monkeypatch):
    rng, made, whole = np.random.default_rng(7), [], D.Carrier._exchange
    monkeypatch.setattr(D.Carrier, "_exchange", lambda self, *a: (made.append(1), whole(self, *a))[1])
    n, m = 90, 110
    carrier, cost, took = D.Carrier(*D.sides(n, m)), rng.normal(size=(n, m)), []
    for _ in range(4):
        made.clear()
        flow, prices = carrier.plan(cost)
        took.append(len(made))
        assert (flow.sum(1) == m).all() and (flow.sum(0) == n).all() and (flow >= 0).all()
        rows = (cost - prices).min(1)  # prices that fit prove that nothing is cheaper
        assert abs((flow * cost).sum() - m * rows.sum() - n * prices.sum()) < 1e-8
        cost = cost + rng.normal(size=(n, m)) * 1e-4
    assert took[0] > 100 and max(took[1:]) < took[0] / 10


def test_masses_of_nothing_and_equal_sums():
    cost = np.random.default_rng(1).normal(size=(5, 4))
    for supply, demand in (([2, 0, 3, 1, 2], [0, 4, 4, 0]), ([1, 1, 1, 1, 0], [1, 1, 1, 1]), ([0, 0, 0, 0, 4], [4, 0, 0, 0])):
        flow, prices = D.transport(cost, supply, demand)
        assert flow.sum(1).tolist() == supply and flow.sum(0).tolist() == demand and (flow >= 0).all()
        rows = (cost - prices).min(1)
        assert abs((flow * cost).sum() - rows @ supply - prices @ demand) < 1e-9


def test_each_pair_of_graphs_is_a_task(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in "abcdef":
        p = rng.uniform(0, 1, (9 + (g > "c"), 2))
        rows.append((g, np.linalg.norm(p[:, None] - p[None, :], axis=2).tolist()))
    tables = spark.createDataFrame(rows, "graph_id string, matrix array<array<double>>")
    pairs = spark.createDataFrame([(a, b) for a in "abcdef" for b in "abcdef" if a < b], "id_a string, id_b string")
    found = D.gromov_wasserstein(tables, pairs)
    assert found.rdd.getNumPartitions() == 15
    assert sum(r["d"] >= 0 for r in found.collect()) == 15


def test_an_exchange_moves_a_stretch_of_the_tree(monkeypatch):
    """What hangs on a node follows it in the order of the tree, prices stay those of its edges, and each price is looked at anew."""
    rng, whole, n, m = np.random.default_rng(11), D.Carrier._exchange, 23, 31
    cost = rng.normal(size=(n, m))

    def exchanged(self, i, j, gap, price):
        assert abs(gap - (cost[i, j - n] - price[i] + price[j])) < 1e-12  # not a price from before the last exchange
        whole(self, i, j, gap, price)
        assert np.allclose(price - price[0], self._prices(cost), atol=1e-12)
        assert (self.seq[self.pos] == np.arange(n + m)).all()
        for x, y in enumerate(self.up):
            assert y < 0 or self.pos[y] < self.pos[x] and self.pos[x] + self.size[x] <= self.pos[y] + self.size[y]

    monkeypatch.setattr(D.Carrier, "_exchange", exchanged)
    carrier = D.Carrier(*D.sides(n, m))
    for _ in range(3):
        flow, prices = carrier.plan(cost)
        assert (flow.sum(1) == m).all() and (flow.sum(0) == n).all() and (flow >= 0).all()
        assert abs((flow * cost).sum() - m * (cost - prices).min(1).sum() - n * prices.sum()) < 1e-8
        cost = rng.normal(size=(n, m))


def test_products_go_on_from_the_flow_before():
    rng, n, m = np.random.default_rng(12), 17, 20
    x, y = (np.abs(a - a.T) for a in (rng.uniform(size=(n, n)), rng.uniform(size=(m, m))))
    const = (x**2).mean(1)[:, None] + (y**2).mean(1)[None, :]
    costs = []
    t, now = D.conditional_gradient(x, y, np.full((n, m), 1 / (n * m)), const, 1.0, 0.0, 50, 1e-12, costs)
    assert len(costs) > 2 and (np.diff(costs) < 0).all()
    assert abs(now - ((const - 2 * x @ t @ y.T) * t).sum()) < 1e-12
    assert np.allclose(t.sum(1), 1 / n) and np.allclose(t.sum(0), 1 / m)
