"""Monthly cohort retention.

Lines are reduced to one row per customer and month before anything is done per customer,
so each customer's group is bounded by the number of calendar months. Cohort tables are
bounded by the number of months squared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.constants import MATURITY_MONTHS, VERDICT_COHORTS, VERDICT_POSITIONS
from ledgerloom.functions import calendar_months_between, month_of
from ledgerloom.functions.skew import attach_per_key


def invoice_month(sales: DataFrame) -> DataFrame:
    return sales.withColumn("invoice_month", month_of(F.col("invoice_ts")))


def cohort_month(sales: DataFrame) -> DataFrame:
    """Every line with the month of its customer's first purchase."""
    return attach_per_key(
        invoice_month(sales), "customer_id", {"cohort_month": F.min("invoice_month")}
    )


def cohort_index(dated: DataFrame) -> DataFrame:
    gap = calendar_months_between(F.col("cohort_month"), F.col("invoice_month"))
    return dated.withColumn("cohort_index", gap)


def customer_months(sales: DataFrame) -> DataFrame:
    """Distinct (customer, month) with cohort columns; no self-join, one row per month."""
    active = invoice_month(sales).select("customer_id", "invoice_month").distinct()
    first = F.min("invoice_month").over(W.partitionBy("customer_id"))
    return cohort_index(active.withColumn("cohort_month", first))


def cohort_counts(sales: DataFrame) -> DataFrame:
    return (
        customer_months(sales)
        .groupBy("cohort_month", "cohort_index")
        .agg(F.count(F.lit(1)).alias("n_customers"))
    )


def cohort_pivot(
    counts: DataFrame, value: str = "n_customers", indices: Sequence[int] | None = None
) -> DataFrame:
    """Wide form, one column per observed index; a gap is NULL, not 0.

    The indices are named to the pivot, which then needs no pass of its own to find them.
    There are at most as many as the log has months.
    """
    if indices is None:
        seen = counts.agg(F.array_sort(F.collect_set("cohort_index")).alias("seen")).first()
        indices = seen["seen"]
    wide = counts.groupBy("cohort_month").pivot("cohort_index", list(indices)).agg(F.first(value))
    return wide.select("cohort_month", *[F.col(f"`{i}`").alias(f"m_{i}") for i in indices])


def retention_pct(counts: DataFrame) -> DataFrame:
    """Percent of each cohort's first column; the window spans one cohort's months."""
    size = F.first("n_customers").over(W.partitionBy("cohort_month").orderBy("cohort_index"))
    return counts.select(
        "cohort_month", "cohort_index", (F.col("n_customers") / size * 100).alias("retention_pct")
    )


def mature_cohorts(retention: DataFrame, months: int = MATURITY_MONTHS) -> DataFrame:
    """Cohorts at least ``months`` calendar months older than the last cohort."""
    cutoff = retention.agg(F.add_months(F.max("cohort_month"), -months).alias("cutoff"))
    return retention.where(F.col("cohort_month") <= cutoff.scalar())


def early_vs_late_retention(
    retention: DataFrame, mature: DataFrame, cohorts: int = VERDICT_COHORTS
) -> DataFrame:
    """Mean retention at column positions 1-3 for the oldest and the newest mature cohorts.

    Positions count the distinct indices of the whole matrix; means are taken per column
    first and skip gaps.
    """
    places = (
        retention.select("cohort_index")
        .distinct()
        .select("cohort_index", (F.row_number().over(W.orderBy("cohort_index")) - 1).alias("position"))
        .where(F.col("position").isin(*VERDICT_POSITIONS))
    )
    ranked = (
        mature.select("cohort_month")
        .distinct()
        .select(
            "cohort_month",
            F.row_number().over(W.orderBy("cohort_month")).alias("from_first"),
            F.row_number().over(W.orderBy(F.desc("cohort_month"))).alias("from_last"),
        )
    )
    per_column = (
        mature.join(F.broadcast(places), "cohort_index")
        .join(F.broadcast(ranked), "cohort_month")
        .groupBy("position")
        .agg(
            F.avg(F.when(F.col("from_first") <= cohorts, F.col("retention_pct"))).alias("early"),
            F.avg(F.when(F.col("from_last") <= cohorts, F.col("retention_pct"))).alias("late"),
        )
    )
    return per_column.agg(F.avg("early").alias("early_avg"), F.avg("late").alias("late_avg"))


def verdict(early: Column, late: Column) -> Column:
    return (
        F.when(late > early, "improving").when(late < early, "declining").otherwise("stable")
    )


def retention_verdict(averages: DataFrame) -> DataFrame:
    return averages.select(verdict(F.col("early_avg"), F.col("late_avg")).alias("verdict"))


def retention_heatmap_data(retention: DataFrame, months: int = MATURITY_MONTHS) -> DataFrame:
    return mature_cohorts(retention, months).orderBy("cohort_month", "cohort_index")


def retention_preview(retention: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` cohorts, to one decimal."""
    head = retention.select("cohort_month").distinct().orderBy("cohort_month").limit(n)
    return retention.join(F.broadcast(head), "cohort_month", "left_semi").select(
        "cohort_month", "cohort_index", F.round("retention_pct", 1).alias("retention_pct")
    )
