import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import elapsed_days, month_of, ntz
from ledgerloom.functions.skew import attach_per_key
from ledgerloom.operators import cleaning, cohorts, rfm
from ledgerloom.plans.log import TransactionLog
from ledgerloom.sources import order_lines, purchase_events


def test_days_are_elapsed_not_calendar(spark):
    start, end = ntz(datetime(2011, 12, 8, 13, 0)), ntz(datetime(2011, 12, 9, 12, 50))
    assert spark.range(1).select(elapsed_days(start, end).alias("d")).first()["d"] == 0


def test_elapsed_days_ignore_clock_changes(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    start, end = ntz(datetime(2010, 3, 13, 2, 30)), ntz(datetime(2010, 3, 14, 2, 30))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = spark.range(1).select(elapsed_days(start, end).alias("d")).first()["d"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == 1


def test_rfm_counts_invoices_and_sums_amounts(tx):
    log = TransactionLog(
        tx(
            [
                ("1", "a", 2, "2010-01-01 10:00", 5, 1),
                ("1", "b", 2, "2010-01-01 10:00", 5, 1),
                ("2", "a", 2, "2010-01-03 09:00", 5, 1),
                ("C9", "a", -2, "2010-02-03 09:00", 5, 1),
                ("C8", "a", -2, "2010-02-03 09:00", 5, 2),
            ]
        )
    )
    rows = log.rfm.collect()
    assert [tuple(r) for r in rows] == [(1, 2, 2, 30.0)]


def test_scaling_uses_the_population_deviation(spark):
    table = spark.createDataFrame(
        [(1, 1, 1, 1.0), (2, 3, 1, 4.0)], "customer_id long, recency long, frequency long, monetary double"
    )
    rows = rfm.rfm_scaled(rfm.rfm_log(table)).orderBy("customer_id").collect()
    assert [r["z_recency"] for r in rows] == pytest.approx([-1, 1])
    assert [r["z_frequency"] for r in rows] == [0.0, 0.0]


def test_recency_on_events_with_times_of_day(spark, folder):
    log = TransactionLog(purchase_events(spark, folder))
    assert log.rfm.agg(F.min("recency")).first()[0] == 2


def cohort_log(tx):
    rows = []
    # Customer 1 skips February; customer 2 starts late; customer 3 buys once.
    for invoice, when, who in [
        ("1", "2010-01-05 10:00", 1),
        ("2", "2010-03-01 00:00", 1),
        ("3", "2010-03-31 23:59", 1),
        ("4", "2010-08-01 00:00", 2),
        ("5", "2010-01-20 08:00", 3),
    ]:
        rows.append((invoice, "a", 1, when, 1, who))
    return tx(rows)


def test_cohort_gaps_have_no_row(tx):
    counts = cohorts.cohort_counts(cohort_log(tx))
    got = {(r["cohort_month"], r["cohort_index"]): r["n_customers"] for r in counts.collect()}
    assert got == {(date(2010, 1, 1), 0): 2, (date(2010, 1, 1), 2): 1, (date(2010, 8, 1), 0): 1}


def test_pivot_leaves_gaps_null(tx):
    wide = cohorts.cohort_pivot(cohorts.cohort_counts(cohort_log(tx))).orderBy("cohort_month")
    assert wide.columns == ["cohort_month", "m_0", "m_2"]
    assert [tuple(r)[1:] for r in wide.collect()] == [(2, 1), (1, None)]


def test_row_level_columns_agree_with_the_reduced_ones(spark, folder):
    lines = TransactionLog(order_lines(spark, folder)).lines
    by_row = cohorts.cohort_index(cohorts.cohort_month(lines))
    again = by_row.groupBy("cohort_month", "cohort_index").agg(
        F.count_distinct("customer_id").alias("n_customers")
    )
    reduced = cohorts.cohort_counts(lines)
    assert again.exceptAll(reduced).isEmpty() and reduced.exceptAll(again).isEmpty()


def test_first_column_is_always_100(spark, folder):
    counts = cohorts.cohort_counts(TransactionLog(order_lines(spark, folder)).lines)
    first = cohorts.retention_pct(counts).where("cohort_index = 0")
    assert first.where("retention_pct <> 100").isEmpty()


def test_maturity_is_by_calendar_not_by_rows(spark):
    retention = spark.createDataFrame(
        [(date(y, m, 1), 0, 100.0) for y, m in ((2000, 5), (2001, 2), (2001, 3), (2001, 4), (2001, 7))],
        "cohort_month date, cohort_index int, retention_pct double",
    )
    kept = cohorts.mature_cohorts(retention).agg(F.max("cohort_month")).first()[0]
    assert kept == date(2001, 3, 1)


def test_sparse_late_cohorts_give_stable(spark):
    rows = [(date(2000, m, 1), 0, 100.0) for m in range(1, 11)]
    rows += [(date(2000, 1, 1), i, 50.0) for i in (1, 2, 3)]
    retention = spark.createDataFrame(rows, "cohort_month date, cohort_index int, retention_pct double")
    averages = cohorts.early_vs_late_retention(retention, cohorts.mature_cohorts(retention))
    assert tuple(averages.first()) == (50.0, None)
    assert cohorts.retention_verdict(averages).first()[0] == "stable"


@pytest.mark.parametrize("late, expected", [(60.0, "improving"), (40.0, "declining"), (50.0, "stable")])
def test_verdict(spark, late, expected):
    averages = spark.createDataFrame([(50.0, late)], "early_avg double, late_avg double")
    assert cohorts.retention_verdict(averages).first()[0] == expected


def test_positions_count_distinct_indices_of_the_whole_matrix(spark):
    # Indices 0, 2, 5, 9: positions 1 to 3 are 2, 5 and 9.
    rows = [(date(2000, 1, 1), i, 10.0 * i) for i in (0, 2, 5, 9)] + [(date(2001, 1, 1), 0, 100.0)]
    retention = spark.createDataFrame(rows, "cohort_month date, cohort_index int, retention_pct double")
    averages = cohorts.early_vs_late_retention(retention, cohorts.mature_cohorts(retention))
    assert averages.first()["early_avg"] == pytest.approx((20 + 50 + 90) / 3)


def test_month_does_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = spark.range(1).select(month_of(ntz(datetime(2010, 3, 31, 23, 59))).alias("m")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == date(2010, 3, 1)


def test_a_hot_key_gets_its_value_and_no_row_is_lost(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    # A high threshold leaves one hot key and sends the others through the shuffle.
    got = attach_per_key(rows, "k", {"low": F.min("v")}, hot_share=0.1)
    expected = rows.join(rows.groupBy("k").agg(F.min("v").alias("low")), "k").select("k", "v", "low")
    assert got.count() == 3000
    assert got.exceptAll(expected).isEmpty()
    # The salt must stay in the shuffle key, or the hot rows meet in one task again.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = attach_per_key(rows, "k", {"low": F.min("v")}, hot_share=0.1)
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(k#\d+L?, _salt#\d+", plan)


def test_sales_profile_dates(tx):
    log = TransactionLog(cohort_log(tx))
    assert log.profile.last_ts == datetime(2010, 8, 1)
    assert rfm.analysis_date(log.lines).first()[0] == datetime(2010, 8, 3)
    assert cleaning.drop_missing_customer(log.raw).count() == 5
