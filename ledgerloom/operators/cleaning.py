"""From raw invoice lines to cleaned, capped sales."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.constants import (
    ANALYSIS_LAG_DAYS,
    CAP_QUANTILES,
    CHURN_MONTHS,
    RETURN_PREFIX,
)
from ledgerloom.functions import exact_quantiles, ntz
from ledgerloom.functions.sketches import column_sketches, merged_quantiles

CAPPED = ("quantity", "price")


@dataclass(frozen=True)
class SalesProfile:
    """What has to be known about all sales before single rows can be worked on.

    Caps and dates are plain values, so they enter later plans as literals: no join is
    needed to use them and filters on them reach the scan.
    """

    rows: int
    last_ts: datetime | None
    caps: dict[str, tuple[float | None, float | None]]


def analysis_ts(last_ts: datetime | None, lag_days: int = ANALYSIS_LAG_DAYS) -> Column:
    return ntz(last_ts) + F.expr(f"interval {int(lag_days)} days")


def reference_ts(last_ts: datetime | None, months: int = CHURN_MONTHS) -> Column:
    """Calendar months back; the day is clipped to the month, the time of day stays."""
    return ntz(last_ts) - F.expr(f"interval {int(months)} months")


def drop_missing_customer(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("customer_id").isNotNull())


def flag_returns(tx: DataFrame) -> DataFrame:
    """A return is an invoice whose text starts with the prefix, case-sensitively."""
    invoice = F.col("invoice").cast("string")
    # Two plain tests, which a filter on the flag can hand down to a Parquet scan.
    return tx.withColumn("is_return", invoice.isNotNull() & invoice.startswith(RETURN_PREFIX))


def drop_returns(tx: DataFrame) -> DataFrame:
    return tx.where(~F.col("is_return"))


def positive(name: str) -> Column:
    """NaN is greater than 0 to Spark, but no positive number."""
    return (F.col(name) > 0) & ~F.isnan(name)


def positive_lines(tx: DataFrame) -> DataFrame:
    return tx.where(positive("quantity") & positive("price"))


def sale_lines(tx: DataFrame) -> DataFrame:
    """The lines that count as sales, not yet capped."""
    return positive_lines(drop_returns(drop_missing_customer(tx)))


def profile_sales(
    lines: DataFrame,
    quantiles: tuple[float, float] = CAP_QUANTILES,
    caps_until: Column | None = None,
    **quantile_options,
) -> SalesProfile:
    """Size, last moment and exact cap thresholds of the sale lines.

    Caps are taken over all lines, as the default asks. ``caps_until`` limits them to
    lines up to a moment, for models that must not see later data.
    """
    measured = lines
    if caps_until is not None:
        early = F.col("invoice_ts") <= caps_until
        measured = lines.withColumns({c: F.when(early, F.col(c)) for c in CAPPED})
    found, seen = exact_quantiles(
        measured.select("invoice_ts", *CAPPED),
        {c: quantiles for c in CAPPED},
        extras={"rows": F.count(F.lit(1)), "last_ts": F.max("invoice_ts")},
        **quantile_options,
    )
    return SalesProfile(seen["rows"], seen["last_ts"], {c: tuple(found[c]) for c in CAPPED})


def sketch_sales(lines: DataFrame) -> DataFrame:
    """What a sketched profile needs of an extract, a small table to keep: a row per capped column."""
    return column_sketches(lines, CAPPED, {"rows": F.count(F.lit(1)), "last_ts": F.max("invoice_ts")})


def profile_from_sketches(
    sketches: DataFrame, quantiles: tuple[float, float] = CAP_QUANTILES
) -> SalesProfile:
    """The profile of all extracts that ``sketches`` (stacked from ``sketch_sales``) were made of.

    Its caps are approximate: the rank of each is off by at most ``RANK_ERROR`` of the rows. Nothing
    of the extracts themselves is read. :func:`profile_sales` is exact and the default everywhere.
    """
    caps = merged_quantiles(sketches, quantiles)
    seen = sketches.where(F.col("column") == CAPPED[0]).agg(F.sum("rows").alias("rows"), F.max("last_ts").alias("last_ts"))
    row = seen.first()
    return SalesProfile(row["rows"] or 0, row["last_ts"], {c: tuple(caps.get(c, (None, None))) for c in CAPPED})


def winsorize(lines: DataFrame, caps: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Pull values outside the thresholds onto them; rows are kept."""
    return lines.withColumns(
        {c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) for c, (lo, hi) in caps.items()}
    )


def line_amount(lines: DataFrame) -> DataFrame:
    return lines.withColumn("amount", F.col("quantity") * F.col("price"))


def build_sales(lines: DataFrame, profile: SalesProfile) -> DataFrame:
    return line_amount(winsorize(lines, profile.caps))


def visits(tx: DataFrame, caps: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """The log at invoice grain: capped amount and number of sale lines per invoice moment.

    Much smaller than the log, and enough for everything that does not look at products.
    Invoices without sale lines are kept for the return rates.
    """
    is_sale = ~F.col("is_return") & positive("quantity") & positive("price")
    # The caps change quantity and price, so which lines are sales is decided on the originals.
    sold = F.when(F.col("is_sale"), F.col("amount"))
    return (
        line_amount(winsorize(tx.withColumn("is_sale", is_sale), caps))
        .groupBy("customer_id", "invoice", "invoice_ts", "is_return")
        .agg(F.sum(sold).alias("amount"), F.count_if("is_sale").alias("sale_lines"))
    )


def return_rates(tx: DataFrame) -> DataFrame:
    """Share of return invoices among all invoices, per customer.

    Lines are first reduced to invoices, spread by customer and invoice, so a customer with
    very many lines is not worked on by one task.
    """
    invoices = tx.groupBy("customer_id", "invoice").agg(F.bool_or("is_return").alias("is_return"))
    numbered = F.col("invoice").isNotNull()
    return (
        invoices.groupBy("customer_id")
        .agg(
            F.count_if(F.col("is_return") & numbered).alias("return_count"),
            F.count("invoice").alias("total_invoices"),
        )
        .withColumn("return_rate", F.try_divide("return_count", "total_invoices"))
    )


def row_accounting(
    tx: DataFrame, lines: DataFrame, reference: Column, quarantine: DataFrame | None = None
) -> DataFrame:
    """Rows and columns per stage; one conditional count over each input.

    Capping keeps all rows and adds the amount, so the uncapped sale lines are counted. With the
    ``quarantine`` of a tolerant load its records are counted too, as ``quarantined``.
    """
    raw = tx.agg(
        F.count(F.lit(1)).alias("raw"), F.count("customer_id").alias("with_customer")
    ).select(
        F.explode(
            F.array(
                F.struct(F.lit("raw").alias("stage"), F.col("raw").alias("rows")),
                F.struct(F.lit("with_customer").alias("stage"), F.col("with_customer").alias("rows")),
            )
        ).alias("s")
    )
    early = F.col("invoice_ts") <= reference
    cleaned = lines.agg(
        F.count(F.lit(1)).alias("sales"),
        F.count_if(early).alias("observation"),
        F.count_if(~early).alias("performance"),
    ).select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("stage"), F.col(s).alias("rows"))
                    for s in ("sales", "observation", "performance")
                ]
            )
        ).alias("s")
    )
    width = F.when(F.col("s.stage").isin("raw", "with_customer"), len(tx.columns)).otherwise(
        len(lines.columns) + 1
    )
    counted = raw.unionByName(cleaned).select(
        F.col("s.stage").alias("stage"), F.col("s.rows").alias("rows"), width.alias("columns")
    )
    if quarantine is None:
        return counted
    aside = quarantine.agg(F.count(F.lit(1)).alias("rows"))
    return counted.unionByName(
        aside.select(F.lit("quarantined").alias("stage"), "rows", F.lit(len(tx.columns)).alias("columns"))
    )
