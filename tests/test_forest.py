"""The forest as a table against the fitted model, and against trees walked by hand."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerloom.constants import CHURN_FEATURES
from ledgerloom.functions import forest as fo
from ledgerloom.operators import churn
from ledgerloom.plans.log import TransactionLog
from ledgerloom.plans.pins import ruled_forest
from ledgerloom.session import stage
from ledgerloom.sources import order_lines


@pytest.fixture(scope="module")
def customers(spark, folder):
    return TransactionLog(order_lines(spark, folder)).staged_split


def test_table_says_what_the_model_says(spark, customers):
    train = customers.where(~F.col("is_test"))
    model = churn.fit_model(train, trees=12, depth=7)
    forest = fo.forest_of(model, spark)
    assert forest.nodes.groupBy("tree").count().count() == forest.trees == 12
    ours = {r["customer_id"]: r for r in churn.predict(forest, customers).collect()}
    theirs = model.transform(churn._assembled(customers, CHURN_FEATURES)).select(
        "customer_id", "prediction", vector_to_array("probability")[1].alias("chance")
    )
    rows = theirs.collect()
    assert len(rows) == len(ours) == customers.count()
    for r in rows:
        assert ours[r["customer_id"]]["churn_probability"] == pytest.approx(r["chance"], abs=1e-12)
        assert ours[r["customer_id"]]["prediction"] == int(r["prediction"])
    told = {r["feature"]: r["importance"] for r in churn.feature_importance(forest).collect()}
    assert [told[f] for f in CHURN_FEATURES] == pytest.approx(list(model.featureImportances.toArray()), abs=1e-9)


def test_walk_by_hand(spark):
    draw = np.random.default_rng(3)
    features = ("a", "b")
    nodes, trees = [], 4
    for t in range(trees):
        # A chain: node i splits into leaf 100 + i and node i + 1, of another length in each tree.
        for i in range(t + 1):
            nodes.append((t, i, i % 2, float(draw.normal()), 100 + i, i + 1, float(draw.random()), 10.0, 10.0))
            nodes.append((t, 100 + i, None, None, None, None, None, float(i + 1), float(t + 1)))
        nodes.append((t, t + 1, None, None, None, None, None, 1.0, 3.0))
    forest = fo.Forest(spark.createDataFrame(nodes, fo.NODE_SCHEMA), trees, trees)
    rows = [(i, *map(float, draw.normal(size=2))) for i in range(50)] + [(50, None, 0.0), (51, 1e300, -1e300)]
    table = {(n[0], n[1]): n for n in nodes}
    wanted = {}
    for i, *x in rows:
        chances = []
        for t in range(trees):
            n = table[t, 0]
            while n[2] is not None:
                low = x[n[2]] is not None and x[n[2]] <= n[3]
                n = table[t, n[4] if low else n[5]]
            chances.append(n[8] / (n[7] + n[8]))
        wanted[i] = sum(chances) / trees
    found = fo.churn_chances(forest, spark.createDataFrame(rows, "id long, a double, b double"), features)
    assert {r["id"]: r["churn_probability"] for r in found.collect()} == pytest.approx(wanted)


def test_forest_without_splits(spark):
    forest = fo.Forest(spark.createDataFrame([(0, 0, None, None, None, None, None, 1.0, 3.0)], fo.NODE_SCHEMA), 1, 0)
    rows = spark.createDataFrame([(1, 0.5)], "id long, a double")
    assert fo.churn_chances(forest, rows, ["a"]).first()["churn_probability"] == 0.75
    assert fo.importances(forest, ["a"]).collect() == [("a", 0.0)]
    assert fo.churn_chances(forest, rows.where("false"), ["a"]).count() == 0


def test_walk_shuffles_a_row_per_customer(spark, customers):
    """Steps are joins with a broadcast table, and trees are averaged before the shuffle."""
    plan = churn.predict(ruled_forest(spark), stage(customers, "walked"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0 and "partial_avg" in plan


def test_walk_takes_rows_as_they_are(spark):
    """Rows are not multiplied by trees; nodes without weight or that are not there count for nothing."""
    nodes = [
        (0, 0, 0, 1.5, 1, 2, 0.5, 4.0, 4.0),
        (0, 1, None, None, None, None, None, 1.0, 3.0),
        (0, 2, None, None, None, None, None, 0.0, 0.0),
        (1, 0, 1, 0.0, 7, 8, 0.5, 4.0, 4.0),  # its child 7 is not there
        (1, 8, None, None, None, None, None, 3.0, 1.0),
    ]
    forest = fo.Forest(spark.createDataFrame(nodes, fo.NODE_SCHEMA), 2, 1)
    rows = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, -1.0), (3, 2.0, 1.0), (4, 9.0, -1.0), (5, 1.0, None)], "id int, a double, b double")
    scored = fo.churn_chances(forest, rows.union(rows), ["a", "b"])
    assert {r["id"]: r["churn_probability"] for r in scored.collect()} == {1: 0.5, 2: 0.75, 3: 0.25, 4: None, 5: 0.5}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Join" not in plan
