"""Giving every row a value of its key when single keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage

# A key above this share is hot, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1e-4
SALTS = 1 << 20


def attach_per_key(
    rows: DataFrame, key: str, values: dict[str, Column], hot_share: float = HOT_SHARE
) -> DataFrame:
    """Every row with aggregates of its key; rows without a key are dropped.

    Hot keys are few by definition, so their values are broadcast. Their rows still pass the
    shuffle of the others, but salted, which spreads them evenly; they match nothing there.
    All other keys are joined by shuffle. The aggregates are written to the shared folder and
    read for both ways, so ``rows`` is read twice in all.
    """
    counted = stage(
        rows.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"), *[v.alias(n) for n, v in values.items()]),
        "per-key",
    )
    total = counted.agg(F.sum("_rows").alias("total")).scalar()
    is_hot = F.col("_rows") > total * F.lit(hot_share)

    def side(prefix: str, wanted: Column) -> DataFrame:
        renamed = [F.col(n).alias(f"{prefix}{n}") for n in values]
        return counted.where(wanted).select(F.col(key).alias(f"{prefix}key"), *renamed)

    hot = side("_hot_", is_hot)
    # Always 0, but not as a literal: the optimiser would take a constant out of the join key
    # and shuffle by the bare key again.
    unsalted = F.pmod(F.xxhash64("_cold_key"), F.lit(1)).cast("int")
    cold = side("_cold_", ~is_hot).withColumn("_cold_salt", unsalted)
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int") + 1
    known = (
        rows.where(F.col(key).isNotNull())
        .join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_salt", F.when(F.col("_hot_key").isNotNull(), spread).otherwise(0))
    )
    joined = known.join(
        cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left"
    )
    picked = [
        F.when(F.col("_hot_key").isNotNull(), F.col(f"_hot_{n}")).otherwise(F.col(f"_cold_{n}")).alias(n)
        for n in values
    ]
    return joined.select(*rows.columns, *picked)
