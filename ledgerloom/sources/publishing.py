"""Publishing result tables all at once or not at all.

Every run writes its tables beside those of earlier runs, reads them back and compares rows and
content with what went in. Only then a manifest is added, which names the folder of each table, or
of each partition of a table. Readers go by the newest manifest, so they see the former results until
the last moment, and a run that fails anywhere leaves nothing but an unused folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import delete_path

_MANIFESTS = "_manifests"
_WHOLE = ""


class PublishError(RuntimeError):
    """What was written is not what was to be written, or another run published first."""


def _at(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, there = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(there)) if fs.exists(there) else []


def _content(df: DataFrame) -> list[Column]:
    """Rows and a sum over their hashes, which does not depend on their order."""
    hashes = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(hashes), F.lit(0).cast("decimal(30,0)")).cast("string").alias("content")]


def manifest(spark: SparkSession, folder: str) -> dict:
    """The newest manifest under ``folder``, or an empty one: version and table -> partition -> path."""
    for name in reversed(_names(spark, f"{folder}/{_MANIFESTS}")):
        if name.endswith(".json"):
            text = spark.read.text(f"{folder}/{_MANIFESTS}/{name}", wholetext=True).first()[0]
            return json.loads(text)
    return {"version": 0, "tables": {}}


def _publish(spark: SparkSession, folder: str, content: dict) -> None:
    """Add a manifest: written under another name, then renamed, which shows it whole or not at all."""
    name = f"{content['version']:010d}.json"
    fs, draft = _at(spark, f"{folder}/{_MANIFESTS}/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(content).encode()))
    finally:
        stream.close()
    _, target = _at(spark, f"{folder}/{_MANIFESTS}/{name}")
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise PublishError(f"another run published {name} first")


def publish_outputs(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    folder: str,
    partition_by: Mapping[str, str] | None = None,
    update: Sequence[str] = (),
) -> dict:
    """Write ``tables`` under ``folder`` and publish them together; returns the new manifest.

    Tables that are not given stay as published. Of a table named in ``update`` only the partitions that
    the new rows fall into are replaced. Content is compared by rows and a sum of hashes that the write
    itself observes, so nothing is computed twice. Of two runs at a time one fails with PublishError.
    """
    folder = folder.rstrip("/")
    partition_by = dict(partition_by or {})
    if not set(update) <= set(partition_by):
        raise ValueError("only partitioned tables can be updated in part")
    before = manifest(spark, folder)
    run = f"runs/{before['version'] + 1:010d}-{uuid.uuid4().hex}"
    entries = {name: dict(entry) for name, entry in before["tables"].items()}
    for name, df in tables.items():
        path, seen = f"{folder}/{run}/{name}", Observation()
        writer = df.observe(seen, *_content(df)).write
        if name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(path)
        back = spark.read.schema(df.schema).parquet(path)
        found = back.agg(*_content(back)).first().asDict()
        if found != dict(seen.get):
            raise PublishError(f"{name}: {found} was read back, {dict(seen.get)} was written")
        kept = entries.get(name, {}).get("parts", {}) if name in update else {}
        parts = [d for d in _names(spark, path) if "=" in d] if name in partition_by else [_WHOLE]
        entries[name] = {
            "schema": df.schema.json(),
            "by": partition_by.get(name),
            "parts": kept | dict.fromkeys(parts, f"{run}/{name}"),
        }
    content = {"version": before["version"] + 1, "tables": entries}
    _publish(spark, folder, content)
    return content


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The published table ``name``."""
    folder = folder.rstrip("/")
    entry = manifest(spark, folder)["tables"][name]
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    bases: dict[str, list[str]] = {}
    for part, base in entry["parts"].items():
        bases.setdefault(base, []).append(part)
    read = [
        spark.read.schema(schema).option("basePath", f"{folder}/{base}").parquet(
            *[f"{folder}/{base}/{part}".rstrip("/") for part in parts]
        )
        for base, parts in sorted(bases.items())
    ]
    if not read:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, read).select(*schema.fieldNames())


def prune_published(spark: SparkSession, folder: str) -> list[str]:
    """Delete the runs that the newest manifest no longer names, and older manifests."""
    folder = folder.rstrip("/")
    newest = manifest(spark, folder)
    used = {base.split("/")[1] for e in newest["tables"].values() for base in e["parts"].values()}
    old = [f"runs/{r}" for r in _names(spark, f"{folder}/runs") if r not in used]
    old += [f"{_MANIFESTS}/{m}" for m in _names(spark, f"{folder}/{_MANIFESTS}") if m != f"{newest['version']:010d}.json"]
    for path in old:
        delete_path(spark, f"{folder}/{path}")
    return old
