"""Working on a table whose other columns may have any names."""

from __future__ import annotations

from pyspark.sql import DataFrame


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., and the new name of each old one."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names
