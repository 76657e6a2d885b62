"""Views of order and event tables as a transaction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.constants import RETURN_PREFIX


# Declared, so that no job is spent on reading types from the files.
LINE_COLUMNS = (
    "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_returnflag string"
)
ORDER_COLUMNS = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"
EVENT_COLUMNS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def order_lines(spark: SparkSession, folder: str, dirty: bool = False) -> DataFrame:
    """Order lines as a log; an order with returned lines gives a sale and a return invoice.

    The return flag comes straight from the base column so that filters on it reach the
    scan. ``dirty`` adds missing customers and non-positive values to exercise cleaning.
    """
    lines = spark.read.schema(LINE_COLUMNS).parquet(f"{folder}/lineitem.parquet")
    orders = spark.read.schema(ORDER_COLUMNS).parquet(f"{folder}/orders.parquet")
    is_return = F.col("l_returnflag") == "R"
    quantity = F.col("l_quantity")
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    customer = F.col("o_custkey")
    if dirty:
        quantity = F.when(is_return, -quantity).when(F.col("l_partkey") % 97 == 0, 0.0).otherwise(quantity)
        price = F.when(F.col("l_partkey") % 89 == 0, 0.0).otherwise(price)
        customer = F.when(F.col("o_orderkey") % 50 != 0, customer)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(
            F.when(is_return, RETURN_PREFIX).otherwise(""), F.col("o_orderkey").cast("string")
        ).alias("invoice"),
        F.col("l_partkey").cast("string").alias("stock_code"),
        quantity.alias("quantity"),
        F.col("o_orderdate").alias("invoice_ts"),
        price.alias("price"),
        customer.alias("customer_id"),
        is_return.alias("is_return"),
    )


def purchase_events(spark: SparkSession, folder: str) -> DataFrame:
    """Purchase events as a log with times of day; every event is its own invoice."""
    return (
        spark.read.schema(EVENT_COLUMNS).parquet(f"{folder}/events.parquet")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").cast("string").alias("invoice"),
            F.col("event_id").cast("string").alias("stock_code"),
            F.lit(1.0).alias("quantity"),
            F.col("ts").alias("invoice_ts"),
            F.col("value").alias("price"),
            F.col("user_id").alias("customer_id"),
            F.lit(False).alias("is_return"),
        )
    )


def split_extracts(tx: DataFrame, boundary: str) -> tuple[DataFrame, DataFrame]:
    """Two extracts of one log, before and from ``boundary``."""
    edge = F.lit(boundary).cast("timestamp_ntz")
    return tx.where(F.col("invoice_ts") < edge), tx.where(F.col("invoice_ts") >= edge)
