"""Reading messy exports: what cannot be read is set aside, with the reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import stage
from ledgerloom.sources.transactions import TEXT_FORMATS, TX_COLUMNS, TX_SCHEMA, union_extracts

#: A record of another shape than the declared one: too few or too many fields, or no record at all.
SHAPE = "shape"
_RAW = "_raw_record"
_REASONS = "_raw_reasons"


@dataclass(frozen=True)
class Loaded:
    """A log and what did not make it there; both scan one staged table.

    ``quarantine`` has extract (the path given), reasons (the log's columns whose text is no value of
    their type, or ``shape``), fields (source column -> text) and record (the text of a record of the
    wrong shape).
    """

    tx: DataFrame
    quarantine: DataFrame

    def counts(self) -> DataFrame:
        """(reason, rows): records set aside by reason, a record once for each; ``any`` counts records."""
        reasons = F.explode(F.array_union("reasons", F.array(F.lit("any"))))
        return self.quarantine.select(reasons.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def _value(name: str) -> str:
    return f"_value_of_{name}"


def _typed(text: Column, name: str, kind: T.DataType, formats: Sequence[str]) -> Column:
    """The value that ``text`` stands for, or null."""
    if isinstance(kind, T.StringType):
        return text
    plain = F.nullif(F.trim(text), F.lit(""))
    if isinstance(kind, T.TimestampNTZType):
        tried = [F.try_to_timestamp(plain, F.lit(f)).cast(kind) for f in formats]
        return F.coalesce(*tried, plain.try_cast(kind))
    number = plain.try_cast("double")
    number = F.when(~F.isnan(number), number)  # NaN stands for a missing number
    if isinstance(kind, T.LongType):
        # Spreadsheet exports write ids as "17850.0".
        return F.when(number == F.rint(number), number.try_cast(kind))
    return number


def load_tolerant(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str,
    columns: Mapping[str, str],
    options: Mapping[str, str] | None = None,
    timestamp_formats: Sequence[str] = (),
) -> Loaded:
    """Read extracts of a log in a text format; records that cannot be read do not fail the job.

    Each file is read once: fields as text, in Spark's permissive mode, which keeps the text of records
    of another shape. Values are then taken from the text, timestamps by the first of
    ``timestamp_formats`` that fits, else as Spark reads them. A missing value (empty, null, NaN) is no
    fault and becomes NULL. A field that has text but no value puts its record into the quarantine.
    ``columns`` maps the file's columns, in file order, to the log's as in ``load_transactions``.
    """
    if fmt not in TEXT_FORMATS:
        raise ValueError(f"{fmt} files carry their types; use load_transactions")
    missing = set(TX_COLUMNS) - set(columns.values())
    if missing:
        raise ValueError(f"no source column for {sorted(missing)}")
    types = {field.name: field.dataType for field in TX_SCHEMA}
    wanted = {source: target for source, target in columns.items() if target in types}
    declared = T.StructType([T.StructField(source, T.StringType()) for source in columns])
    reader = (
        spark.read.format(fmt)
        .options(**dict(options or {}))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RAW)
        .option("columnPruning", "false")  # else fields that nobody asks for are not counted
        .schema(declared.add(_RAW, T.StringType()))
    )

    def read(path: str) -> DataFrame:
        raw = reader.load(path)
        # In steps, for the text of a record to be taken apart once: a column that is used several times
        # and is not cheap stays a column.
        taken = raw.withColumns(
            {_value(t): _typed(F.col(f"`{s}`"), t, types[t], timestamp_formats) for s, t in wanted.items()}
        )
        faults = [F.when(F.col(f"`{_RAW}`").isNotNull(), F.lit(SHAPE))]
        for source, target in wanted.items():
            text = F.col(f"`{source}`")
            absent = text.isNull() | F.lower(F.trim(text)).isin("", "nan", "null")
            odd = F.col(_value(target)).isNull() & ~absent & F.col(f"`{_RAW}`").isNull()
            faults.append(F.when(odd, F.lit(target)))
        fields = F.map_from_arrays(
            F.array(*[F.lit(s) for s in wanted]), F.array(*[F.col(f"`{s}`") for s in wanted])
        )
        judged = taken.withColumn(_REASONS, F.array_compact(F.array(*faults)))
        return judged.select(
            *[F.col(_value(c)).alias(c) for c in TX_COLUMNS],
            F.lit(path).alias("extract"),
            F.col(_REASONS).alias("reasons"),
            F.when(F.size(_REASONS) > 0, fields).alias("fields"),
            F.col(f"`{_RAW}`").alias("record"),
        )

    # One pass over the text: the reader would parse it again for each of the two tables.
    staged = stage(union_extracts(*[read(path) for path in paths]), "extracts")
    good = F.size("reasons") == 0
    return Loaded(
        staged.where(good).select(*TX_COLUMNS),
        staged.where(~good).select("extract", "reasons", "fields", "record"),
    )
