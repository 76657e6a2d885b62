"""Recency, frequency, monetary value, and their scaled form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.constants import ANALYSIS_LAG_DAYS
from ledgerloom.functions import attach_row, elapsed_days, safe_std

MEASURES = ("recency", "frequency", "monetary")
LOGS = tuple(f"log_{m}" for m in MEASURES)
SCALED = tuple(f"z_{m}" for m in MEASURES)


def analysis_date(sales: DataFrame, lag_days: int = ANALYSIS_LAG_DAYS) -> DataFrame:
    lag = F.expr(f"interval {int(lag_days)} days")
    return sales.agg((F.max("invoice_ts") + lag).alias("analysis_ts"))


def rfm(sales: DataFrame, analysis_ts: Column) -> DataFrame:
    """One row per customer.

    The distinct count makes Spark group by customer and invoice first, so a customer with
    a large share of the lines is spread over many tasks before the last small step.
    """
    return sales.groupBy("customer_id").agg(
        elapsed_days(F.max("invoice_ts"), analysis_ts).alias("recency"),
        F.count_distinct("invoice").alias("frequency"),
        F.sum("amount").alias("monetary"),
    )


def rfm_log(table: DataFrame) -> DataFrame:
    return table.withColumns({f"log_{m}": F.log1p(m) for m in MEASURES})


def rfm_scaled(logged: DataFrame) -> DataFrame:
    """z-scores of the log columns, with the population deviation."""
    moments = logged.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in LOGS], *[safe_std(c).alias(f"std_{c}") for c in LOGS]
    )
    return attach_row(logged, moments).select(
        *logged.columns,
        *[
            ((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")).alias(z)
            for c, z in zip(LOGS, SCALED)
        ],
    )


def preview(table: DataFrame, n: int, by: str = "customer_id") -> DataFrame:
    return table.orderBy(by).limit(n)
