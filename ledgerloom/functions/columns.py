"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ntz(moment: datetime | None) -> Column:
    """A zone-free timestamp literal; folded at planning time, so filters on it are pushed."""
    text = None if moment is None else moment.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days from ``start`` to ``end``; not the number of midnights passed.

    Taken from the interval between them, so the session's zone and its clock changes play no
    part.
    """
    return F.extract(F.lit("DAY"), end - start).cast("bigint")


def month_of(ts: Column) -> Column:
    """First day of the month as a date, whatever the session's zone."""
    return F.trunc(F.to_date(ts), "MM")


def calendar_months_between(start: Column, end: Column) -> Column:
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row of ``df``.

    The row is a scalar subquery: it is computed once and used as a value, with no join.
    """
    names = row.columns
    held = row.select(F.struct(*names).alias("held")).scalar()
    widened = df.withColumn("_held", held)
    return widened.select(*df.columns, *[F.col("_held")[n].alias(n) for n in names])


def safe_std(name: str) -> Column:
    """Population deviation, 1 for a constant column so that scaling leaves it at 0."""
    spread = F.stddev_pop(name)
    return F.when(spread > 0, spread).otherwise(F.lit(1.0))
