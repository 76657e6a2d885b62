"""Approximate quantiles from sketches that can be stored and merged.

A KLL sketch of a column is a few hundred kilobytes whatever the rows. Those of several tables merge
to one of all rows, so a new extract of a log costs a scan of its own and nothing of the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 8192
#: Share of the rows by which the rank of an answer can be off. Twice what is published for sketches of
#: this accuracy with a confidence of 99 %.
RANK_ERROR = 0.001


def column_sketches(df: DataFrame, columns: Sequence[str], extras: Mapping[str, Column] | None = None) -> DataFrame:
    """(column, n, sketch, extras): a sketch of the values of each column, from one aggregate."""
    extras = dict(extras or {})
    made = df.agg(
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(ACCURACY)).alias(f"s_{i}") for i, c in enumerate(columns)],
        *[e.alias(name) for name, e in extras.items()],
    )
    lines = [
        F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("n"), F.col(f"s_{i}").alias("sketch"))
        for i, c in enumerate(columns)
    ]
    return made.select(F.inline(F.array(*lines)), *extras)


def merged_quantiles(sketches: DataFrame, probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles per column over all rows that ``sketches`` (column, n, sketch) were made of.

    Every answer is a value of the column. There is a row per extract and column, merged in one task.
    """
    held = sketches.where("n > 0").groupBy("column").agg(F.collect_list("sketch").alias("held"))
    merged = F.aggregate(F.slice("held", 2, F.size("held")), F.col("held")[0], F.kll_sketch_merge_double)
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    found = held.select("column", merged.alias("sketch")).select(
        "column", F.kll_sketch_get_quantile_double("sketch", wanted).alias("values")
    )
    known = {r["column"]: list(r["values"]) for r in found.collect()}  # a row per column
    every = [r["column"] for r in sketches.select("column").distinct().collect()]
    return {c: known.get(c, [None] * len(probabilities)) for c in every}
