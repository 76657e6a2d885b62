"""The tree silhouette against all distances, and its bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_segments import COLUMNS, brute_silhouette

from ledgerloom.functions import distance_sums as ds
from ledgerloom.operators import segments

SCHEMA = "customer_id long, z_recency double, z_frequency double, z_monetary double, two int, five int"


def points(n, seed=1):
    draw = np.random.default_rng(seed)
    at = np.concatenate([draw.normal(c, s, (n // 3, 3)) for c, s in ((-2, 0.3), (0, 1.0), (3, 0.6))])
    at[: n // 10] = at[n // 10 : 2 * (n // 10)]  # copies
    five = np.abs(at[:, :1] - np.array([-3.0, -1, 0, 1, 90])[None]).argmin(axis=1)
    return at, (at[:, 2] > 0.5).astype(int), five


def table(spark, at, *labels):
    rows = [(i, *map(float, x), *map(int, own)) for i, (x, *own) in enumerate(zip(at, *labels, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("pieces, epsilon, bound", [(1 << 15, 1e-3, 0.01), (1 << 15, 0.0, 1e-9), (300, 1e-3, 0.3), (40, 1e-2, 1.5)])
def test_error_is_within_its_bound(spark, monkeypatch, pieces, epsilon, bound):
    monkeypatch.setattr(ds, "MOST_PIECES", pieces)
    at, two, five = points(900)
    got = segments.silhouette_with_error(table(spark, at, two, five), {2: "two", 5: "five"}, epsilon=epsilon)
    for row, labels in zip(got.orderBy("k").collect(), (two, five), strict=True):
        assert abs(row["silhouette"] - brute_silhouette(at, labels)) <= row["error"] + 1e-6
        assert row["error"] <= bound


def test_sums_of_a_block_are_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(ds, "MOST_PIECES", 200)
    at, two, _ = points(1200, seed=2)
    df = table(spark, at, two, two).withColumnRenamed("two", "label")
    belongs = np.eye(2)
    tree = ds.tree_of(*ds.pieces_of(df, COLUMNS, "label"), COLUMNS, "label", belongs, 1e-2)
    assert len(tree.levels) > 2 and sum(tree.levels[0].n) == sum(tree.levels[-1].n) == len(at)
    for some in (at[:5], at[500:540], np.array([[9.0, 9, 9]])):
        sums, error = ds.block_sums(tree, some)
        exact = np.sqrt(((some[:, None] - at[None]) ** 2).sum(axis=2)) @ belongs[two]
        assert (np.abs(sums - exact) <= error + 1e-6).all()
        assert (np.abs(sums - exact) <= 0.05 * exact + 1e-6).all()


def test_far_groups_are_taken_as_a_whole(spark):
    draw = np.random.default_rng(4)
    at = np.concatenate([draw.normal(c, 0.05, (500, 3)) for c in (0, 5)])
    label = np.repeat([0, 1], 500)
    df = table(spark, at, label, label).withColumnRenamed("two", "label")
    tree = ds.tree_of(*ds.pieces_of(df, COLUMNS, "label"), COLUMNS, "label", np.eye(2), 1e-3)
    widest = max(tree.levels, key=lambda level: len(level.n))
    assert len(tree.levels[0].n) < 20 < len(widest.n)
    sums, error = ds.block_sums(tree, at[:50])
    assert 0 < error[1] <= 1e-3 * sums[:, 1].max() * 1.1


def test_small_tables(spark):
    labels = {2: "two"}
    same = table(spark, np.zeros((6, 3)), [0, 1] * 3, [0] * 6)
    assert segments.silhouette_with_error(same, labels).collect() == [(2, 0.0, 0.0)]
    one = table(spark, np.arange(12.0).reshape(4, 3), [0] * 4, [0] * 4)
    assert segments.silhouette(one, labels, method="tree").first()["silhouette"] == 0.0
    assert segments.silhouette_with_error(same.where("false"), labels).count() == 0
    alone = table(spark, np.array([[0.0, 0, 0], [1, 0, 0], [1.5, 0, 0]]), [0, 1, 1], [0] * 3)
    wanted = brute_silhouette([[0.0, 0, 0], [1, 0, 0], [1.5, 0, 0]], [0, 1, 1])
    assert segments.silhouette_with_error(alone, labels).first()["silhouette"] == pytest.approx(wanted)
    line = segments.silhouette_with_error(alone.withColumn("z_recency", F.col("z_recency") * 1e6), labels, ["z_recency"])
    assert line.first()["silhouette"] == pytest.approx(wanted)
