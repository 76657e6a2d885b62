import hashlib
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.constants import CHURN_FEATURES
from ledgerloom.operators import actions, churn
from ledgerloom.plans.log import TransactionLog
from ledgerloom.plans.report import score_churn
from ledgerloom.session import stage
from ledgerloom.sources import order_lines


def sales_log(tx):
    return TransactionLog(
        tx(
            [
                ("1", "a", 1, "2010-01-01 13:00", 10, 1),
                ("2", "b", 1, "2010-06-30 12:00", 10, 1),
                ("3", "a", 1, "2010-02-01 00:00", 10, 2),
                ("4", "a", 1, "2010-12-01 00:00", 10, 2),
                ("5", "a", 1, "2010-07-01 00:00", 10, 3),
                ("6", "a", 1, "2010-12-30 12:00", 10, 4),
                ("C7", "a", -1, "2010-03-01 00:00", 10, 1),
                ("C8", "a", -1, "2010-03-01 00:00", 10, 5),
            ]
        )
    )


def test_reference_moment_and_boundary(tx):
    log = sales_log(tx)
    assert churn.reference_date(log.lines).first()[0] == datetime(2010, 6, 30, 12, 0)
    early, late = churn.window_split(log.lines, log.reference)
    assert sorted(r["invoice"] for r in early.collect()) == ["1", "2", "3"]
    assert early.count() + late.count() == log.lines.count()


def test_labels(tx):
    log = sales_log(tx)
    labels = {r["customer_id"]: r["is_churn"] for r in churn.churn_labels(log.lines, log.reference).collect()}
    assert labels == {1: 1, 2: 0}
    early, late = churn.window_split(log.lines, log.reference)
    eligible = churn.eligible_customers(early)
    active = {r["customer_id"] for r in churn.active_after(late, eligible).collect()}
    assert active == {c for c, label in labels.items() if label == 0}
    assert {r["customer_id"] for r in eligible.collect()} == set(labels)


def test_features(tx):
    log = sales_log(tx)
    rows = {r["customer_id"]: r.asDict() for r in log.churn_features.collect()}
    assert set(rows) == {1, 2}
    one = rows[1]
    assert (one["recency"], one["frequency"], one["unique_products"], one["is_churn"]) == (0, 2, 2, 1)
    assert one["avg_order_gap"] == pytest.approx(179 / 2)
    assert one["return_rate"] == pytest.approx(1 / 3)
    assert rows[2]["avg_order_gap"] == 0.0 and rows[2]["return_rate"] == 0.0
    assert rows[2]["monetary"] == 10.0


def test_return_only_customers_have_a_rate_but_no_features(tx):
    log = sales_log(tx)
    rates = {r["customer_id"]: r["return_rate"] for r in churn.observed_return_rate(log.tx, log.reference).collect()}
    assert rates[5] == 1.0
    assert log.churn_features.where("customer_id = 5").isEmpty()


def test_features_need_no_python_and_one_pass_over_sales(tx):
    plan = sales_log(tx).churn_features._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("share", [0.25, 0.1, 1.0])
def test_split_is_exact_per_class_and_repeatable(spark, share):
    df = stage(
        spark.range(1003).select(
            F.col("id").alias("customer_id"), (F.col("id") % 3 == 0).cast("int").alias("is_churn")
        ),
        "labels",
    )
    split = churn.stratified_split(df, share)
    again = churn.stratified_split(df.repartition(5), share)
    assert split.exceptAll(again).isEmpty()
    for label in (0, 1):
        ids = [i for i in range(1003) if int(i % 3 == 0) == label]
        ids.sort(key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())
        expected = set(ids[: math.ceil(share * len(ids))])
        got = {r[0] for r in split.where((F.col("is_churn") == label) & F.col("is_test")).select("customer_id").collect()}
        assert got == expected
    assert split.count() == 1003


def test_report_follows_the_counts(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 1)] * 2 + [(0, 0)] * 4
    report = churn.classification_report(spark.createDataFrame(rows, "is_churn int, prediction int"))
    got = {r["label"]: r.asDict() for r in report.collect()}
    assert list(got) == ["Active", "Churned", "accuracy", "macro avg", "weighted avg"]
    assert got["Churned"]["precision"] == pytest.approx(3 / 5)
    assert got["Churned"]["recall"] == pytest.approx(3 / 4)
    assert got["Churned"]["f1"] == pytest.approx(2 / 3)
    assert got["accuracy"]["f1"] == pytest.approx(0.7) and got["accuracy"]["precision"] is None
    assert got["macro avg"]["recall"] == pytest.approx((3 / 4 + 4 / 6) / 2)
    assert got["weighted avg"]["precision"] == pytest.approx(0.6 * 4 / 5 + 0.4 * 3 / 5)
    assert got["weighted avg"]["support"] == 10


def test_a_class_never_predicted_has_precision_zero(spark):
    rows = spark.createDataFrame([(1, 0), (0, 0)], "is_churn int, prediction int")
    report = {r["label"]: r for r in churn.classification_report(rows).collect()}
    assert report["Churned"]["precision"] == 0.0 and report["Churned"]["f1"] == 0.0


@pytest.fixture(scope="module")
def forest(spark):
    """Customers whose churn follows from their recency."""
    df = spark.range(400).select(
        F.col("id").alias("customer_id"),
        (F.col("id") % 200).alias("recency"),
        (F.col("id") % 7).alias("frequency"),
        (F.col("id") % 13).cast("double").alias("monetary"),
        (F.col("id") % 5).cast("double").alias("avg_order_gap"),
        (F.col("id") % 11).alias("unique_products"),
        F.lit(0.1).alias("return_rate"),
        (F.col("id") % 200 > 100).cast("int").alias("is_churn"),
    )
    split = churn.stratified_split(stage(df, "forest"))
    return split, churn.fit_forest(split.where(~F.col("is_test")), trees=15, depth=5)


def test_forest_learns_and_scores_every_row(forest):
    split, model = forest
    scored = churn.predict(model, split.where("is_test"))
    assert scored.count() == split.where("is_test").count()
    assert scored.where("churn_probability < 0 OR churn_probability > 1").isEmpty()
    right = scored.agg(F.avg((F.col("prediction") == F.col("is_churn")).cast("int"))).first()[0]
    assert right > 0.9


def test_the_same_forest_whatever_the_partitions(spark, forest):
    split, model = forest
    other = churn.fit_forest(split.where(~F.col("is_test")).repartition(7), trees=15, depth=5)
    one, two = (churn.predict(m, split).select("customer_id", "churn_probability") for m in (model, other))
    assert one.exceptAll(two).isEmpty()


def test_importances_sum_to_one(forest):
    split, model = forest
    table = churn.feature_importance(model).collect()
    assert {r["feature"] for r in table} == set(CHURN_FEATURES)
    assert sum(r["importance"] for r in table) == pytest.approx(1.0)
    assert table[0]["feature"] == "recency"


def matrix(spark, rows):
    return spark.createDataFrame(rows, "customer_id long, churn_probability double, monetary double")


def test_quadrants_count_the_median_as_high(spark):
    rows = matrix(spark, [(1, 0.5, 10.0), (2, 0.9, 5.0), (3, 0.1, 20.0), (4, 0.5, 10.0), (5, 0.2, 1.0)])
    medians = actions.action_medians(rows)
    assert (medians.probability, medians.monetary) == (0.5, 10.0)
    got = {r["customer_id"]: r["segment"] for r in actions.assign_segment(rows, medians).collect()}
    assert got == {
        1: "Top Priority Customer",
        2: "Low Value Churner",
        3: "Loyal Customer",
        4: "Top Priority Customer",
        5: "Loyal Low Value Customer",
    }


def test_medians_interpolate_and_summary_adds_up(spark):
    rows = matrix(spark, [(1, 0.1, 1.0), (2, 0.2, 2.0), (3, 0.3, 30.0), (4, 0.8, 40.0)])
    medians = actions.action_medians(rows)
    assert (medians.probability, medians.monetary) == pytest.approx((0.25, 16.0))
    segmented = actions.assign_segment(rows, medians)
    summary = actions.segment_summary(segmented).collect()
    assert sum(r["customer_count"] for r in summary) == 4
    assert sum(r["total_monetary"] for r in summary) == 73.0
    assert actions.revenue_at_risk(segmented).first()[0] == 70.0
    chart = actions.quadrant_chart_data(segmented, medians).orderBy("customer_id").collect()
    assert chart[3]["log_monetary"] == pytest.approx(math.log10(40.0))
    assert chart[0]["median_monetary"] == 16.0


def test_no_top_priority_customers_put_nothing_at_risk(spark):
    rows = matrix(spark, [(1, 0.9, 1.0), (2, 0.1, 9.0)])
    segmented = actions.assign_segment(rows, actions.action_medians(rows))
    assert actions.revenue_at_risk(segmented).first()[0] == 0.0


def test_score_all_covers_every_customer_in_scope(spark, folder):
    log = TransactionLog(order_lines(spark, folder))
    everyone = score_churn(log, score="all", trees=5, depth=3)
    tested = score_churn(log, trees=5, depth=3)
    assert everyone.segmented.count() == log.staged_split.count()
    assert tested.segmented.count() == log.staged_split.where("is_test").count()
    assert {r["label"] for r in tested.report.collect()} >= {"Active", "Churned"}
    with pytest.raises(ValueError):
        score_churn(log, score="some")
