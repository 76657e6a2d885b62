"""Pinned parameters that give model scoring an exact answer.

A fit cannot be repeated in SQL, but scoring with known parameters can.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.forest import Forest
from ledgerloom.operators.clv import PurchaseModel, SpendModel

# Fixed values. BG/NBD: the CDNOW estimates of Fader, Hardie & Lee (2005), alpha turned from
# weeks into days. Gamma-Gamma: the estimates of Fader & Hardie (2013). The rest is chosen.
PINNED_PURCHASES = PurchaseModel(r=0.243, alpha=30.898, a=0.793, b=2.426)
PINNED_SPEND = SpendModel(p=6.25, q=3.74, v=15.44)
PINNED_CENTERS = ((-1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0))
EXTRACT_BOUNDARY = "1998-01-01 00:00:00"
RISK_MIDPOINT_DAYS = 180
RISK_SCALE_DAYS = 90

# For each k, centers spread evenly over -1.5..1.5 of scaled recency.
SCORED_CENTERS = {
    k: tuple((-1.5 + 3.0 * (i + 0.5) / k, 0.0, 0.0) for i in range(k)) for k in (2, 3, 4)
}


# Width of the cells of the rounded silhouette, in standard deviations.
SILHOUETTE_GRID = 0.25


def pinned_probability() -> Column:
    exponent = -(F.col("recency") - F.lit(float(RISK_MIDPOINT_DAYS))) / F.lit(float(RISK_SCALE_DAYS))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(exponent))


# Wide tables have a column for each month of so many, from a cohort's first one.
PIVOT_MONTHS = 120

# A forest made by rule: full trees, node i has the children 2i and 2i + 1. Each entry is an
# expression of SQL over (tree, node), the same for Spark and for the check; splits are a share of
# the scale of the feature.
RULED_TREES = 25
RULED_DEPTH = 4
FEATURE_SCALES = (400.0, 12.0, 1500000.0, 90.0, 60.0, 0.5)
RULED_NODE = {
    "feature": "(tree + 2 * node) % 6",
    "share": "((tree * 7 + node * 11) % 19 + 1) / 10.0",
    "gain": "((tree * 5 + node * 3) % 23 + 1) / 100.0",
    "n0": "(tree * 31 + node * 17) % 97 + 1.0",
    "n1": "(tree * 13 + node * 41) % 89 + 1.0",
}


def ruled_forest(spark: SparkSession) -> Forest:
    inner = F.col("node") < 1 << RULED_DEPTH
    scale = F.element_at(F.array(*[F.lit(v) for v in FEATURE_SCALES]), F.expr(RULED_NODE["feature"]) + 1)
    trees = spark.range(RULED_TREES).select(F.col("id").cast("int").alias("tree"))
    numbers = F.explode(F.sequence(F.lit(1), F.lit((2 << RULED_DEPTH) - 1)))
    nodes = trees.select("tree", numbers.alias("node")).select(
        "tree", "node",
        F.when(inner, F.expr(RULED_NODE["feature"])).alias("feature"),
        F.when(inner, F.expr(RULED_NODE["share"]).cast("double") * scale).alias("split"),
        F.when(inner, F.col("node") * 2).alias("below"),
        F.when(inner, F.col("node") * 2 + 1).alias("above"),
        F.when(inner, F.expr(RULED_NODE["gain"]).cast("double")).alias("gain"),
        F.expr(RULED_NODE["n0"]).cast("double").alias("n0"),
        F.expr(RULED_NODE["n1"]).cast("double").alias("n1"),
    )
    return Forest(nodes, RULED_TREES, RULED_DEPTH, root=1)
