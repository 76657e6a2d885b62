"""Reading a transaction log: one row per invoice line."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TX_SCHEMA = T.StructType(
    [
        T.StructField("invoice", T.StringType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("invoice_ts", T.TimestampNTZType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("customer_id", T.LongType()),
    ]
)
TX_COLUMNS = TX_SCHEMA.fieldNames()

# Formats that carry no types of their own; they are read with a declared schema.
TEXT_FORMATS = ("csv", "json")


def load_transactions(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str = "parquet",
    columns: Mapping[str, str] | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read one or more extracts of the same log and stack them.

    ``columns`` maps the file's column names, in file order, to the log's names; columns
    mapped to names outside the log are read over and dropped. Types are declared, not
    inferred, so no pass over the data is spent on guessing them.
    """
    columns = dict(columns or {name: name for name in TX_COLUMNS})
    missing = set(TX_COLUMNS) - set(columns.values())
    if missing:
        raise ValueError(f"no source column for {sorted(missing)}")
    types = {field.name: field.dataType for field in TX_SCHEMA}
    reader = spark.read.format(fmt).options(**dict(options or {}))
    if fmt in TEXT_FORMATS:
        declared = T.StructType()
        for source, target in columns.items():
            # Spreadsheet exports write ids as "17850.0": read as a number, then narrow.
            kind = T.DoubleType() if target == "customer_id" else types.get(target, T.StringType())
            declared.add(source, kind)
        reader = reader.schema(declared)
    wanted = {source: target for source, target in columns.items() if target in types}

    def picked(extract: DataFrame) -> DataFrame:
        fractional = {n for n, kind in extract.dtypes if kind in ("double", "float")}
        return extract.select(
            *[
                (_without_nan(source) if source in fractional else F.col(f"`{source}`"))
                .cast(types[target])
                .alias(target)
                for source, target in wanted.items()
            ]
        )

    return union_extracts(*[picked(reader.load(path)) for path in paths])


def _without_nan(name: str) -> Column:
    """NaN stands for a missing number in exports; in the log it is NULL."""
    return F.when(~F.isnan(F.col(f"`{name}`")), F.col(f"`{name}`"))


def union_extracts(*extracts: DataFrame) -> DataFrame:
    """Stack extracts by column name; duplicate rows are kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), extracts)
