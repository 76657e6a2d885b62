"""A forest as a table of nodes, and its walk in blocks of rows.

One row per node says all there is to know: where rows go, and the weight of each class that
trained it. Scores and importances follow from the table alone, in SQL as well as here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerloom.session import stage, staged_path

NODE_SCHEMA = (
    "tree int, node int, feature int, split double, below int, above int, gain double, n0 double, n1 double"
)
#: Rows that a task walks down a tree at a time.
BLOCK_ROWS = 8192


@dataclass(frozen=True)
class Forest:
    """``nodes`` has the columns of NODE_SCHEMA.

    A row with ``feature`` at most ``split`` goes to node ``below``, others to ``above``; leaves have
    null in these four. ``n0`` and ``n1`` are the weights of the classes in training. Roots have
    node number ``root``, and no leaf lies deeper than ``depth``.
    """

    nodes: DataFrame
    trees: int
    depth: int
    root: int = 0


def forest_of(model: RandomForestClassificationModel, spark: SparkSession) -> Forest:
    """The table of a fitted model, read from the files that the model writes of itself."""
    path = staged_path(spark, "forest")
    model.write().save(path)
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner, n["split"]["leftCategoriesOrThreshold"][0]).alias("split"),
        F.when(inner, n["leftChild"]).alias("below"),
        F.when(inner, n["rightChild"]).alias("above"),
        F.when(inner, n["gain"]).alias("gain"),
        n["impurityStats"][0].alias("n0"),
        n["impurityStats"][1].alias("n1"),
    )
    return Forest(nodes, model.getNumTrees, max(t.depth for t in model.trees))


@dataclass(frozen=True)
class _Steps:
    """All nodes by number; a leaf leads to itself, a child that is not there to the last one.

    ``child`` has the numbers of ``below`` and ``above`` in turn, ``roots`` those where the trees start,
    and ``chance`` is the share of class 1, NaN for a node without weight.
    """

    roots: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    chance: np.ndarray
    depth: int

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Mean share of class 1 at the leaves for rows of ``x``; trees without one do not count."""
        total, known = np.zeros(len(x)), np.zeros(len(x))
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(self.depth):
                above = ~(flat[first + self.feature[node]] <= self.split[node])
                node = self.child[2 * node + above]
            found = self.chance[node]
            there = ~np.isnan(found)
            total += np.where(there, found, 0.0)
            known += there
        with np.errstate(invalid="ignore"):
            return total / known


def _steps(forest: Forest) -> _Steps:
    """The nodes on the driver, at most ``trees * 2^(depth + 1)`` of them whatever the data."""
    chance = F.try_divide(F.col("n1"), F.col("n0") + F.col("n1"))
    told = forest.nodes.select("tree", "node", "feature", "split", "below", "above", chance.alias("chance")).toArrow()
    tree, node, feature, below, above = (
        told[c].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        for c in ("tree", "node", "feature", "below", "above")
    )
    split, share = (
        told[c].combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False) for c in ("split", "chance")
    )
    key = (tree << 32) + node
    order = np.argsort(key)
    ordered, own, missing = key[order], np.arange(len(key)), len(key)

    def number(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ordered, wanted)
        there = at < missing
        there[there] = ordered[at[there]] == wanted[there]
        return np.where(there, at, missing)

    leaf = feature[order] < 0
    child = np.full((missing + 1, 2), missing, np.int64)
    for side, name in enumerate((below, above)):
        child[:-1, side] = np.where(leaf, own, number((tree[order] << 32) + name[order]))
    return _Steps(
        number((np.arange(forest.trees) << 32) + forest.root),
        np.append(np.maximum(feature[order], 0), 0), np.append(split[order], np.nan),
        child.ravel(), np.append(share[order], np.nan), forest.depth,
    )


def churn_chances(forest: Forest, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with ``churn_probability``, the mean over trees of the share of class 1 at the leaf.

    Every row starts at the root of each tree and takes one step per level. Blocks of rows take their
    steps together, in the task that has read them, so only rows with their mean are moved, not rows
    times trees. Rows that are alike in all columns become one; a missing feature goes ``above``.
    """
    steps = _steps(forest)
    names, width = rows.columns, len(features)
    values = F.array(*[F.col(f).cast("double") for f in features])
    schema = StructType([*rows.schema.fields, StructField("_chance", DoubleType())])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                x = part.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                chance = steps.chances(x.astype(float))
                columns = [*part.columns[: len(names)], pa.array(chance, mask=np.isnan(chance))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "_chance"])

    ended = rows.withColumn("_values", values).mapInArrow(walked, schema)
    return ended.groupBy(*names).agg(F.avg("_chance").alias("churn_probability"))


def importances(forest: Forest, features: Sequence[str]) -> DataFrame:
    """(feature, importance): gain times weight by feature, as a share within each tree, then averaged."""
    named = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("feature") + 1)
    gains = (
        forest.nodes.where(F.col("feature").isNotNull())
        .groupBy("tree", named.alias("feature"))
        .agg(F.sum(F.col("gain") * (F.col("n0") + F.col("n1"))).alias("gain"))
    )
    total = gains.groupBy("tree").agg(F.sum("gain").alias("total"))
    shares = gains.join(F.broadcast(total), "tree").select("feature", F.try_divide("gain", "total").alias("share"))
    summed = stage(shares.groupBy("feature").agg(F.sum("share").alias("share")), "importance")
    every = forest.nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    whole = summed.agg(F.sum("share").alias("whole"))
    return (
        every.join(F.broadcast(summed), "feature", "left")
        .join(F.broadcast(whole))
        .select("feature", F.coalesce(F.try_divide("share", "whole"), F.lit(0.0)).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )
