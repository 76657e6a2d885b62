"""Known totals on the larger tables."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import churn, cohorts
from ledgerloom.plans.log import TransactionLog
from ledgerloom.sources import order_lines

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def log(spark):
    return TransactionLog(order_lines(spark, FOLDER))


def test_cleaned_sales(log):
    assert log.profile.rows == 39_954
    assert log.profile.caps["quantity"] == (1.0, 50.0)
    assert log.profile.caps["price"] == pytest.approx((72.9544128584644, 51103.95395))


def test_rfm_totals(log):
    row = log.rfm.agg(F.count("*"), F.sum("recency"), F.sum("frequency"), F.sum("monetary")).first()
    assert tuple(row)[:3] == (1_500, 388_542, 13_972)
    assert row[3] == pytest.approx(2_106_942_273.89, abs=0.01)


def test_repeat_purchase_totals(log):
    row = log.rfmt.agg(F.sum("frequency"), F.sum("recency"), F.sum("T")).first()
    assert tuple(row) == (12_441, 2_828_414, 3_213_956)


def test_churn_totals(log):
    labels = churn.churn_labels(log.lines, log.reference)
    assert tuple(labels.agg(F.count("*"), F.sum("is_churn")).first()) == (1_498, 748)
    rates = churn.observed_return_rate(log.tx, log.reference).agg(F.sum("return_rate")).first()[0]
    assert rates == pytest.approx(657.833645, abs=1e-6)


def test_cohort_totals(log):
    counts = log.staged_cohort_counts
    row = counts.agg(F.count("*"), F.count_distinct("cohort_month"), F.max("cohort_index")).first()
    assert tuple(row) == (1_898, 52, 78)
    retention = cohorts.retention_pct(counts)
    averages = cohorts.early_vs_late_retention(retention, cohorts.mature_cohorts(retention)).first()
    assert averages["early_avg"] == pytest.approx(9.917494, abs=1e-6)
    assert averages["late_avg"] is None
