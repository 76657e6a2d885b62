"""Churn labels, point-in-time features, the split and the classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import (
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.constants import (
    CHURN_FEATURES,
    CHURN_MONTHS,
    CLASS_NAMES,
    FOREST_DEPTH,
    FOREST_TREES,
    SEED,
    TEST_SHARE,
)
from ledgerloom.functions import elapsed_days
from ledgerloom.functions.forest import Forest, churn_chances, importances
from ledgerloom.functions.grow_forest import grow_forest
from ledgerloom.functions.partitions import steady_layout
from ledgerloom.operators.cleaning import return_rates


def reference_date(sales: DataFrame, months: int = CHURN_MONTHS) -> DataFrame:
    back = F.expr(f"interval {int(months)} months")
    return sales.agg((F.max("invoice_ts") - back).alias("reference_ts"))


def window_split(sales: DataFrame, reference: Column) -> tuple[DataFrame, DataFrame]:
    """Observation (up to and including the reference moment) and performance lines."""
    early = F.col("invoice_ts") <= reference
    return sales.where(early), sales.where(~early)


def window_parts(sales: DataFrame, reference: Column) -> DataFrame:
    """All dated lines with the window that each belongs to, in one pass."""
    part = F.when(F.col("invoice_ts") <= reference, "observation").otherwise("performance")
    return sales.where(F.col("invoice_ts").isNotNull()).withColumn("part", part)


def eligible_customers(observation: DataFrame) -> DataFrame:
    return observation.select("customer_id").distinct()


def active_after(performance: DataFrame, eligible: DataFrame) -> DataFrame:
    """Reduced to customers before the join, so no key has more than one row in it."""
    return performance.select("customer_id").distinct().join(eligible, "customer_id", "left_semi")


def churn_labels(sales: DataFrame, reference: Column) -> DataFrame:
    """1 when a customer seen up to the reference moment has no sale after it.

    First and last sale per customer decide both conditions: one aggregate, no joins.
    """
    span = sales.groupBy("customer_id").agg(
        F.min("invoice_ts").alias("first_ts"), F.max("invoice_ts").alias("last_ts")
    )
    return span.where(F.col("first_ts") <= reference).select(
        "customer_id", (F.col("last_ts") <= reference).cast("int").alias("is_churn")
    )


def churn_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("is_churn").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "is_churn")


def unique_products(lines: DataFrame, reference: Column) -> DataFrame:
    """Distinct products bought per customer up to the reference moment."""
    early = lines.where(F.col("invoice_ts") <= reference)
    return early.groupBy("customer_id").agg(F.count_distinct("stock_code").alias("unique_products"))


def observation_features(sales: DataFrame, reference: Column) -> DataFrame:
    """Per-customer features up to the reference moment, with the label, in one aggregate.

    Later sales only tell whether the customer came back. Unused features are pruned by the
    optimiser when a caller selects fewer columns. ``sales`` may be at invoice grain. Products
    are counted apart, see :func:`unique_products`.
    """
    early = F.col("invoice_ts") <= reference

    def seen(name: str) -> Column:
        return F.when(early, F.col(name))

    measures = [
        F.min(seen("invoice_ts")).alias("first_seen"),
        F.max(seen("invoice_ts")).alias("last_seen"),
        F.max("invoice_ts").alias("last_ts"),
        F.count_distinct(seen("invoice")).alias("frequency"),
        F.sum(seen("amount")).alias("monetary"),
    ]
    per_customer = sales.groupBy("customer_id").agg(*measures).where(F.col("first_seen").isNotNull())
    span = elapsed_days(F.col("first_seen"), F.col("last_seen"))
    return per_customer.select(
        "customer_id",
        elapsed_days(F.col("last_seen"), reference).alias("recency"),
        "frequency",
        "monetary",
        span.alias("timespan"),
        F.try_divide(span, "frequency").alias("avg_order_gap"),
        (F.col("last_ts") <= reference).cast("int").alias("is_churn"),
    )


def observed_return_rate(tx: DataFrame, reference: Column) -> DataFrame:
    """Return rates over the raw lines up to the reference moment."""
    return return_rates(tx.where(F.col("invoice_ts") <= reference)).select(
        "customer_id", "return_rate"
    )


def churn_features(
    sales: DataFrame, tx: DataFrame, reference: Column, products: DataFrame
) -> DataFrame:
    """Features and label of every eligible customer; all sides arrive grouped by customer."""
    rates = observed_return_rate(tx, reference)
    return (
        observation_features(sales, reference)
        .join(products, "customer_id", "left")
        .join(rates, "customer_id", "left")
        .withColumn("return_rate", F.coalesce("return_rate", F.lit(0.0)))
        .select("customer_id", *CHURN_FEATURES, "is_churn")
        .dropna()
    )


def stratified_split(
    labelled: DataFrame, share: float = TEST_SHARE, seed: int = SEED, label: str = "is_churn"
) -> DataFrame:
    """Mark exactly ``ceil(share * n)`` customers of each class as test rows.

    The test rows are those with the smallest hash of id and seed, so the split does not
    depend on partitioning. Ranking a whole class would put it into one task. Instead the
    hash's first four hex digits are counted (at most 65,536 counts per class), the counts
    give the prefix in which the cut falls, and only that prefix's rows are ranked. The cut
    itself is one row per class. ``labelled`` is read three times and should be staged.
    """
    hashed = labelled.withColumn(
        "_hash", F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(f":{seed}")).cast("binary"))
    ).withColumn("_prefix", F.substring("_hash", 1, 4))
    counts = hashed.groupBy(label, "_prefix").agg(F.count(F.lit(1)).alias("n"))
    up_to = W.partitionBy(label).orderBy("_prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(label)
    cut = (
        counts.withColumn("upto", F.sum("n").over(up_to))
        .withColumn("wanted", F.ceil(F.sum("n").over(whole) * F.lit(share)))
        .where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
        .select(label, "_prefix", (F.col("wanted") - F.col("upto") + F.col("n")).alias("_need"))
    )
    last = (
        hashed.join(F.broadcast(cut), [label, "_prefix"])
        .withColumn("_place", F.row_number().over(W.partitionBy(label).orderBy("_hash")))
        .where(F.col("_place") == F.col("_need"))
        .select(label, F.col("_hash").alias("_last"))
    )
    return (
        hashed.join(F.broadcast(last), label, "left")
        .withColumn("is_test", F.coalesce(F.col("_hash") <= F.col("_last"), F.lit(False)))
        .select(*labelled.columns, "is_test")
    )


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fit_model(
    train: DataFrame,
    features: Sequence[str] = CHURN_FEATURES,
    trees: int = FOREST_TREES,
    depth: int = FOREST_DEPTH,
    seed: int = SEED,
    bins: int = 256,
    memory_mb: int = 512,
) -> RandomForestClassificationModel:
    """Spark's own random forest; many bins bring the split points close to exact ones.

    ``functions.forest.forest_of`` turns it into a table of nodes.

    Bootstrap samples are drawn per partition, so rows are laid out by their number alone: the
    same rows grow the same forest on every cluster. A larger ``memory_mb`` per task lets a pass
    grow more nodes at once. ``train`` is read twice and should be staged.
    """
    spread = steady_layout(train, "customer_id")
    forest = RandomForestClassifier(
        labelCol="is_churn",
        numTrees=trees,
        maxDepth=depth,
        maxBins=bins,
        maxMemoryInMB=memory_mb,
        featureSubsetStrategy="sqrt",
        impurity="gini",
        seed=seed,
    )
    return forest.fit(_assembled(spread, features))


def fit_forest(
    train: DataFrame,
    features: Sequence[str] = CHURN_FEATURES,
    trees: int = FOREST_TREES,
    depth: int = FOREST_DEPTH,
    seed: int = SEED,
) -> Forest:
    """A random forest with exact split points, as a table of nodes; see ``functions.grow_forest``.

    The same rows grow the same forest however they are laid out. ``train`` should be staged.
    """
    return grow_forest(train, "customer_id", "is_churn", features, trees, depth, seed)


def predict(forest: Forest, rows: DataFrame, features: Sequence[str] = CHURN_FEATURES) -> DataFrame:
    """Hard label and probability of churn for each customer."""
    scored = churn_chances(forest, rows, features)
    return scored.select(
        *rows.columns,
        (F.col("churn_probability") > 0.5).cast("int").alias("prediction"),
        "churn_probability",
    )


def feature_importance(forest: Forest, features: Sequence[str] = CHURN_FEATURES) -> DataFrame:
    return importances(forest, features)


def classification_report(
    predicted: DataFrame, label: str = "is_churn", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages.

    All rows come from one aggregate of confusion counts; an empty denominator counts as 0.
    """
    truth, guess = F.col(label), F.col(prediction)
    counts = predicted.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(truth == guess).alias("right"),
        *[
            e.alias(f"{kind}{c}")
            for c in (0, 1)
            for kind, e in (
                ("hit", F.count_if((truth == c) & (guess == c))),
                ("said", F.count_if(guess == c)),
                ("is", F.count_if(truth == c)),
            )
        ],
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    for c in (0, 1):
        hit, said, real = F.col(f"hit{c}"), F.col(f"said{c}"), F.col(f"is{c}")
        counts = counts.withColumns(
            {
                f"p{c}": ratio(hit, said),
                f"r{c}": ratio(hit, real),
                f"f{c}": ratio(2 * hit, said + real),
            }
        )

    def line(name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            p.cast("double").alias("precision"),
            r.cast("double").alias("recall"),
            f.cast("double").alias("f1"),
            support.alias("support"),
        )

    def averaged(weight: Sequence[Column]) -> list[Column]:
        total = weight[0] + weight[1]
        return [
            ratio(F.col(f"{m}0") * weight[0] + F.col(f"{m}1") * weight[1], total) for m in "prf"
        ]

    n, none = F.col("n"), F.lit(None)
    lines = [
        *[
            line(name, F.col(f"p{c}"), F.col(f"r{c}"), F.col(f"f{c}"), F.col(f"is{c}"))
            for c, name in enumerate(CLASS_NAMES)
        ],
        line("accuracy", none, none, ratio(F.col("right"), n), n),
        line("macro avg", *averaged((F.lit(1), F.lit(1))), n),
        line("weighted avg", *averaged((F.col("is0"), F.col("is1"))), n),
    ]
    return counts.select(F.inline(F.array(*lines)))
