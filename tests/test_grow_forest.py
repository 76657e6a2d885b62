"""Grown forests against sorting every node in one place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import grow_forest as gf

FEATURES = ("a", "b", "c", "d")
SCHEMA = "id long, label int, a double, b double, c double, d double"


def customers(n, seed=1):
    draw = np.random.default_rng(seed)
    a, b = draw.normal(size=n), np.floor(draw.exponential(5, n))
    c, d = np.exp(draw.normal(0, 6, n)) * draw.choice([-1, 1], n), np.full(n, 2.5)
    label = (a + 0.3 * b + 0.2 * np.sign(c) * np.log1p(np.abs(c)) + draw.normal(size=n) > 1.5).astype(int)
    return np.arange(n) * 7 - 50, label, np.column_stack([a, b, c, d])


def table(spark, keys, label, x):
    return spark.createDataFrame([(int(k), int(y), *map(float, v)) for k, y, v in zip(keys, label, x, strict=True)], SCHEMA)


def by_hand(keys, label, x, trees, depth, looked_at, seed):
    lines = []
    for t in range(trees):
        weight = gf.sample_weights(keys, t, seed)
        some = weight > 0
        lines += gf.grow_below(x[some], label[some], weight[some], t, 1, depth, looked_at, seed)
    return sorted(lines)


def told(forest):
    return sorted(tuple(r) for r in forest.nodes.collect())


def plain_split(x, label, weight, order, looked_at):
    """The best split by trying every pair of neighbouring values."""
    def gini(rows):
        w = weight[rows].sum()
        p = (weight * label)[rows].sum() / w
        return 2 * p * (1 - p), w

    every = np.ones(len(x), bool)
    best, tried = None, 0
    for f in order:
        tried += 1
        values = np.unique(x[:, f])
        for low, high in zip(values[:-1], values[1:], strict=True):
            left = x[:, f] <= low
            (gl, wl), (gr, wr), (g, w) = gini(left), gini(~left), gini(every)
            gain = g - wl / w * gl - wr / w * gr
            if best is None or gain > best[0] + 1e-12:
                best = gain, f, (low + high) / 2
        if tried >= looked_at and best is not None:
            break
    return best


def test_best_split_of_a_node():
    draw = np.random.default_rng(2)
    for _ in range(40):
        n = int(draw.integers(2, 40))
        x = np.floor(draw.normal(0, 3, (n, 4)))
        x[:, 3] = 1.0
        label, weight, order = draw.integers(0, 2, n), draw.integers(1, 4, n), draw.permutation(4)
        found, wanted = gf.best_split(x, label, weight, order, 2), plain_split(x, label, weight, order, 2)
        assert (found is None) == (wanted is None)
        if found:
            assert found[1:] == wanted[1:] and found[0] == pytest.approx(wanted[0], abs=1e-12)


@pytest.mark.parametrize("local", [1 << 17, 200, 1])
def test_scans_split_as_sorting_does(spark, monkeypatch, local):
    """Whether nodes are split by scans or in one task makes no difference."""
    monkeypatch.setattr(gf, "LOCAL_WEIGHT", local)
    monkeypatch.setattr(gf, "BINS", 8)
    keys, label, x = customers(900)
    rows = table(spark, keys, label, x).repartition(3)
    forest = gf.grow_forest(rows, "id", "label", FEATURES, 3, 4, 42, looked_at=2)
    assert told(forest) == by_hand(keys, label, x, 3, 4, 2, 42)


def test_rounds_do_not_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(gf, "LOCAL_WEIGHT", 1)
    rounds = []
    scan = gf._Growing._scan
    monkeypatch.setattr(gf._Growing, "_scan", lambda self, *a: rounds.append(1) or scan(self, *a))
    counts = []
    for n in (500, 4000):
        rounds.clear()
        gf.grow_forest(table(spark, *customers(n)), "id", "label", FEATURES, 2, 2, 1)
        counts.append(len(rounds))
    assert max(counts) <= 2 * 8 and counts[1] <= counts[0] + 4


def test_the_same_forest_whatever_the_partitions(spark):
    rows = table(spark, *customers(400))
    one, two = (gf.grow_forest(r, "id", "label", FEATURES, 4, 5, 3) for r in (rows.coalesce(1), rows.repartition(5)))
    assert told(one) == told(two)
    assert told(gf.grow_forest(rows, "id", "label", FEATURES, 4, 5, 4)) != told(one)


def test_rows_of_small_nodes_travel_packed(spark, monkeypatch):
    """A row of the shuffle per node and block of rows, not one per row and tree."""
    rows = table(spark, *customers(900)).coalesce(1)
    sent = []
    plain = type(rows).repartition

    def counted(self, *a):
        if a[-2:] == ("tree", "node"):
            sent.append(self.count())
        return plain(self, *a)

    monkeypatch.setattr(type(rows), "repartition", counted)
    gf.grow_forest(rows, "id", "label", FEATURES, 3, 4, 42)
    assert sent == [3]


def test_constant_features_are_passed_over(spark, monkeypatch):
    """A node whose first features are constant looks at the others, by scans as by sorting."""
    monkeypatch.setattr(gf, "LOCAL_WEIGHT", 1)
    keys, label, x = customers(300)
    x[:, 1:] = 2.5
    forest = gf.grow_forest(table(spark, keys, label, x), "id", "label", FEATURES, 4, 2, 42, looked_at=1)
    assert told(forest) == by_hand(keys, label, x, 4, 2, 1, 42)


def test_samples_are_like_drawing_with_replacement():
    weight = np.stack([gf.sample_weights(np.arange(20000), t, 42) for t in range(5)])
    assert weight.mean() == pytest.approx(1, abs=0.01) and weight.var() == pytest.approx(1, abs=0.03)
    assert (weight == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert abs(np.corrcoef(weight)[0, 1]) < 0.03
    order = np.stack([gf.feature_order(1, t, n, 6) for t in range(50) for n in range(1, 50)])
    assert np.abs((order == 0).mean(axis=0) - 1 / 6).max() < 0.03


def test_small_tables(spark):
    rows = table(spark, *customers(50))
    none = gf.grow_forest(rows.where("false"), "id", "label", FEATURES, 2, 3, 1)
    assert [(r["tree"], r["node"], r["feature"], r["n0"]) for r in none.nodes.orderBy("tree").collect()] == [(0, 1, None, 0.0), (1, 1, None, 0.0)]
    pure = gf.grow_forest(rows.withColumn("label", F.lit(1)), "id", "label", FEATURES, 2, 3, 1)
    assert pure.nodes.count() == 2 and pure.nodes.where("feature IS NOT NULL OR n0 > 0").isEmpty()
    flat = gf.grow_forest(rows.withColumns({f: F.lit(1.0) for f in FEATURES}), "id", "label", FEATURES, 2, 3, 1)
    assert flat.nodes.where("feature IS NOT NULL").isEmpty()
    stump = gf.grow_forest(rows, "id", "label", FEATURES, 2, 0, 1)
    assert stump.nodes.count() == 2
    with pytest.raises(ValueError):
        gf.grow_forest(rows, "id", "label", FEATURES, 2, 17, 1)
