"""K-Means segmentation of scaled RFM, its scores and its profile."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ledgerloom.constants import (
    CLUSTER_COUNTS,
    KMEANS_MAX_ITERATIONS,
    KMEANS_RESTARTS,
    KMEANS_TOLERANCE,
    SEED,
)
from ledgerloom.functions import block_pairs, distance_sums, lloyd
from ledgerloom.functions.partitions import steady_layout
from ledgerloom.operators.rfm import MEASURES, SCALED
from ledgerloom.session import stage

# Rows of a task of an iteration of K-Means.
ROWS_PER_TASK = 100_000
# Rows of one block in the pairwise silhouette; a task holds two blocks. Every row meets all blocks.
BLOCK_ROWS = 131_072
# Error of a distance to a group of customers that the tree silhouette takes as a whole.
TREE_EPSILON = 0.001


@dataclass(frozen=True)
class FittedClusters:
    k: int
    wcss: float
    centers: tuple[tuple[float, ...], ...]
    sizes: tuple[int, ...]


def vectors(scaled: DataFrame, columns: Sequence[str] = SCALED) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(scaled)


def fit_kmeans(
    scaled: DataFrame,
    ks: Sequence[int] = CLUSTER_COUNTS,
    restarts: int = KMEANS_RESTARTS,
    max_iterations: int = KMEANS_MAX_ITERATIONS,
    seed: int = SEED,
    tolerance: float = KMEANS_TOLERANCE,
) -> dict[int, FittedClusters]:
    """Best of ``restarts`` fits for each k, by within-cluster sum of squares.

    All fits advance together: each iteration is one scan of one cached table, however many there
    are. Starting centers are drawn from a sample of at most ``lloyd.START_ROWS`` customers, the
    iterations take all of them. ``tolerance`` bounds the squared moves of all centers of a fit
    together, in units of the features' variance, which is 1 after scaling. Clusters are numbered
    by ascending center, and the result does not depend on the layout of the rows. An empty table
    or fewer customers than clusters leave clusters without members.
    """
    rows = steady_layout(stage(scaled.select("customer_id", *SCALED), "scaled"), "customer_id", ROWS_PER_TASK)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        points = lloyd.start_points(rows, "customer_id", SCALED, seed)
        points = points if len(points) else np.zeros((1, len(SCALED)))
        jobs = [(k, i) for k in ks for i in range(restarts)]
        starts = [lloyd.spread_centers(points, k, np.random.default_rng([seed, k, i])) for k, i in jobs]
        fits = lloyd.fit_all(rows, SCALED, starts, max_iterations, tolerance)
    finally:
        rows.unpersist()

    def best(k: int) -> FittedClusters:
        centers, told = min((f for (own, _), f in zip(jobs, fits) if own == k), key=lambda f: f[1].cost)
        found = sorted(zip(map(tuple, centers.tolist()), told.counts.tolist()))
        return FittedClusters(k, told.cost, tuple(c for c, _ in found), tuple(n for _, n in found))

    return {k: best(k) for k in ks}


def cluster_costs(scaled: DataFrame, centers: Mapping[int, Sequence[Sequence[float]]]) -> DataFrame:
    """(k, cluster, n, wcss, next_<measure>): what one iteration makes of the given centers of each k.

    ``wcss`` is the cluster's part of the cost at the centers, ``next_`` the center it moves to (its
    own place if it has no customers).
    """
    found = lloyd.scan(scaled, SCALED, {k: np.asarray(c) for k, c in centers.items()})
    lines = [
        (k, c, int(told.counts[c]), float(told.costs[c]), *map(float, moved[c]))
        for k, told in found.items()
        for moved in [told.means(np.asarray(centers[k]))]
        for c in range(len(told.counts))
    ]
    measures = ", ".join(f"next_{m} double" for m in MEASURES)
    return scaled.sparkSession.createDataFrame(lines, f"k int, cluster int, n bigint, wcss double, {measures}")


def center_table(like: DataFrame, fits: Mapping[int, FittedClusters]) -> DataFrame:
    rows = [
        (f.k, c, *center, size)
        for f in fits.values()
        for c, (center, size) in enumerate(zip(f.centers, f.sizes))
    ]
    measures = ", ".join(f"center_{m} double" for m in MEASURES)
    return like.sparkSession.createDataFrame(rows, f"k int, cluster int, {measures}, n bigint")


def single_cluster_wcss(scaled: DataFrame, columns: Sequence[str] = SCALED) -> DataFrame:
    """The k = 1 point of the elbow: rows times the summed population variances."""
    spread = sum((F.var_pop(c) for c in columns[1:]), F.var_pop(columns[0]))
    return scaled.agg((F.count(F.lit(1)) * spread).alias("wcss")).select(
        F.lit(1).alias("k"), "wcss"
    )


def elbow_curve(scaled: DataFrame, fits: Mapping[int, FittedClusters]) -> DataFrame:
    rows = [(f.k, f.wcss) for f in fits.values()]
    fitted = scaled.sparkSession.createDataFrame(rows, "k int, wcss double")
    return single_cluster_wcss(scaled).unionByName(fitted).orderBy("k")


def nearest_center(
    centers: Sequence[Sequence[float]], columns: Sequence[str] = SCALED
) -> Column:
    """Index of the nearest center, the smaller index on ties; stays in the JVM."""
    options = []
    for i, center in enumerate(centers):
        distance = sum(
            ((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, center)),
            F.lit(0.0),
        )
        options.append(F.struct(distance.alias("distance"), F.lit(i).alias("cluster")))
    return F.array_min(F.array(*options))["cluster"]


def assign_clusters(scaled: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    return scaled.withColumn("cluster", nearest_center(centers))


def label_all(scaled: DataFrame, centers: Mapping[int, Sequence[Sequence[float]]]) -> DataFrame:
    """One label column ``cluster_<k>`` for each k."""
    return scaled.withColumns({f"cluster_{k}": nearest_center(c) for k, c in centers.items()})


def silhouette(
    labelled: DataFrame,
    labels: Mapping[int, str],
    key: str = "customer_id",
    columns: Sequence[str] = SCALED,
    method: str = "exact",
    block_rows: int = BLOCK_ROWS,
    grid: float | None = None,
    epsilon: float = TREE_EPSILON,
) -> DataFrame:
    """Mean silhouette per k; ``labels`` names the label column (0..k-1) of each k.

    ``exact`` uses Euclidean distances between all customers, as the statistic is defined,
    and its work grows with their square. Where that is too much, ``grid`` rounds the
    coordinates to multiples of its width and counts the customers per cell: every customer
    still takes part, and no distance moves by more than ``grid * sqrt(dimensions)``.
    ``tree`` takes far groups of customers as a whole, see :func:`silhouette_with_error`.
    ``squared`` is Spark's evaluator, a different statistic that needs only one pass.
    None of these is used unless asked for.
    """
    if method == "squared":
        return _squared_silhouette(labelled, labels, columns)
    if method == "tree":
        return silhouette_with_error(labelled, labels, columns, epsilon).select("k", "silhouette")
    if method != "exact":
        raise ValueError(f"unknown silhouette method {method!r}")
    return _exact_silhouette(labelled, labels, key, columns, block_rows, grid)


def _squared_silhouette(
    labelled: DataFrame, labels: Mapping[int, str], columns: Sequence[str]
) -> DataFrame:
    data = vectors(labelled, columns)
    rows = [
        (k, float(ClusteringEvaluator(predictionCol=label, metricName="silhouette").evaluate(data)))
        for k, label in labels.items()
    ]
    return labelled.sparkSession.createDataFrame(rows, "k int, silhouette double")


def _coordinate(name: str, grid: float | None) -> Column:
    value = F.col(name).cast("double")
    return value if grid is None else F.rint(value / grid) * grid


def _exact_silhouette(
    labelled: DataFrame,
    labels: Mapping[int, str],
    key: str,
    columns: Sequence[str],
    block_rows: int,
    grid: float | None,
) -> DataFrame:
    """All distances, block by block, with every k scored from the same distances.

    Customers with the same labels go to the same blocks of bounded size, and every two blocks meet in
    a task, see ``functions.block_pairs``. Neither pairs nor copies of blocks are written: what is, are some
    sums per customer and set of labels. The work grows with the square of the customers, as the
    definition demands, but is spread evenly whatever the cluster sizes.
    """
    ks = list(labels)
    slots = np.cumsum([0, *ks])
    names = [f"label_{k}" for k in ks]
    places = [f"x{d}" for d in range(len(columns))]
    points = labelled.select(
        F.col(key).alias("id"),
        *[_coordinate(c, grid).alias(x) for c, x in zip(columns, places)],
        *[F.col(labels[k]).cast("int").alias(name) for k, name in zip(ks, names)],
        F.lit(1).cast("bigint").alias("weight"),
    )
    if grid is not None:
        cells = points.groupBy(*places, *names).agg(F.sum("weight").alias("weight"))
        points = cells.withColumn("id", F.xxhash64(*places))
    points = stage(points, "points")
    weighed = F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("weight")
    sets = points.groupBy(*names).agg(*weighed).orderBy(*names).toPandas()
    own = sets[names].to_numpy(np.int64)
    belongs = np.zeros((len(sets), int(slots[-1])))
    for i in range(len(ks)):
        belongs[np.arange(len(sets)), slots[i] + own[:, i]] = 1.0
    sizes = sets["weight"].to_numpy(float) @ belongs

    number = int(sets["rows"].sum())
    cores = labelled.sparkSession.sparkContext.defaultParallelism
    dealt = block_pairs.deal(sets["rows"].tolist(), block_pairs.rows_per_block(number, block_rows, cores))
    numbered = points.sparkSession.createDataFrame(
        [(i, *place, *map(int, row)) for i, (place, row) in enumerate(zip(dealt, own))],
        ", ".join(["kind int", "first int", "parts int", *[f"{n} int" for n in names]]),
    )
    block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    points = points.join(F.broadcast(numbered), names).withColumn("block", block)
    blocks = block_pairs.packed(points, places, max((first + parts for first, parts in dealt), default=0))

    def scores(total: np.ndarray, kind: np.ndarray) -> np.ndarray:
        found, rows = np.zeros((len(total), len(ks))), np.arange(len(total))
        for i in range(len(ks)):
            mine, every = own[kind, i], slice(int(slots[i]), int(slots[i + 1]))
            size = sizes[every]
            inner = total[:, every][rows, mine] / np.maximum(size[mine] - 1, 1)
            others = np.where(size > 0, total[:, every] / np.maximum(size, 1), np.inf)
            others[rows, mine] = np.inf
            outer = others.min(axis=1)
            counts = (size[mine] > 1) & ~np.isposinf(outer)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = (outer - inner) / np.maximum(outer, inner)
            found[:, i] = np.where(counts & ((outer != 0) | (inner != 0)), score, 0.0)
        return found

    parts = block_pairs.scored(blocks, number, belongs, len(places), scores)
    means = parts.agg(
        *[F.try_divide(F.sum(F.col("totals")[i]), F.sum("weight")).alias(f"s_{k}") for i, k in enumerate(ks)]
    )
    lines = [F.struct(F.lit(k).alias("k"), F.col(f"s_{k}").alias("silhouette")) for k in ks]
    return means.select(F.inline(F.array(*lines)))


def silhouette_with_error(
    labelled: DataFrame,
    labels: Mapping[int, str],
    columns: Sequence[str] = SCALED,
    epsilon: float = TREE_EPSILON,
) -> DataFrame:
    """(k, silhouette, error): the mean silhouette and a bound on how far it can be from the exact one.

    Distances to groups of customers of one place and the same labels are summed up at once, see
    ``functions.distance_sums``: those of a group taken as a whole are off by at most ``epsilon`` of its
    distance. ``error`` is what the bounds of all sums make of the statistic, customer by customer. Up
    to ``distance_sums.MOST_PIECES`` different customers, single ones are never merged. Work grows with
    the customers, not with their square. Clusters without customers count for nothing, a single
    customer's own score is 0, and an empty table gives no rows.
    """
    ks = list(labels)
    slots = np.cumsum([0, *ks])
    names = [f"label_{k}" for k in ks]
    places = [f"x{d}" for d in range(len(columns))]
    points = stage(
        labelled.select(
            *[F.col(c).cast("double").alias(x) for c, x in zip(columns, places)],
            *[F.col(labels[k]).cast("int").alias(name) for k, name in zip(ks, names)],
        ),
        "points",
    )
    sets = points.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).toPandas()
    if not len(sets):
        return labelled.sparkSession.createDataFrame([], "k int, silhouette double, error double")
    own = sets[names].to_numpy(np.int64)
    belongs = np.zeros((len(sets), int(slots[-1])))
    for i in range(len(ks)):
        belongs[np.arange(len(sets)), slots[i] + own[:, i]] = 1.0
    sizes = sets["n"].to_numpy(float) @ belongs
    numbered = points.sparkSession.createDataFrame(
        [(i, *map(int, row)) for i, row in enumerate(own)], ", ".join(["label int", *[f"{n} int" for n in names]])
    )
    # A set of labels for each region that the centers of all k part the space into.
    points = points.join(F.broadcast(numbered), names).select("label", *places)
    tree = distance_sums.tree_of(*distance_sums.pieces_of(points, places, "label"), places, "label", belongs, epsilon)

    def scores(at: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Per k: sums of the scores and of their lowest and highest values."""
        sums, error = distance_sums.block_sums(tree, at)
        found = np.zeros((len(ks), 3))
        for i, k in enumerate(ks):
            mine, every = own[label, i], slice(int(slots[i]), int(slots[i + 1]))
            size, total, off = sizes[every], sums[:, every], error[every]
            rows, there = np.arange(len(at)), np.maximum(size, 1)
            mates = np.maximum(size[mine] - 1, 1)
            inner, inner_off = total[rows, mine] / mates, off[mine] / mates
            others = np.where(size > 0, total / there, np.inf)
            others[rows, mine] = np.inf
            gap = off / there
            counts = (size[mine] > 1) & np.isfinite(others.min(axis=1))

            def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                a, b = np.maximum(a, 0.0), np.maximum(b, 0.0)
                top = np.maximum(a, b)
                with np.errstate(invalid="ignore", divide="ignore"):
                    return np.where(counts & (top > 0), (b - a) / top, 0.0).sum()

            found[i] = (
                score(inner, others.min(axis=1)),
                score(inner + inner_off, (others - gap).min(axis=1)),
                score(inner - inner_off, (others + gap).min(axis=1)),
            )
        return found

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(ks), 3)), 0
        for batch in batches:
            at = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            label = batch.column(0).to_numpy()
            for start in range(0, len(at), distance_sums.BLOCK_POINTS):
                part = slice(start, start + distance_sums.BLOCK_POINTS)
                total += scores(at[part], label[part])
            n += len(at)
        if n:
            lines = [(k, *map(float, total[i]), n) for i, k in enumerate(ks)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in zip(*lines, strict=True)], ["k", "total", "low", "high", "n"]
            )

    parts = distance_sums.in_curve_order(points, places).mapInArrow(
        scored, "k long, total double, low double, high double, n long"
    )
    mean, low, high = (F.sum(c) / F.sum("n") for c in ("total", "low", "high"))
    return parts.groupBy("k").agg(
        mean.alias("silhouette"), F.greatest(high - mean, mean - low, F.lit(0.0)).alias("error")
    ).select(F.col("k").cast("int").alias("k"), "silhouette", "error")


def select_k(scores: DataFrame) -> DataFrame:
    """The k with the highest score; the smallest k on ties."""
    return scores.orderBy(F.desc("silhouette"), "k").limit(1).select(F.col("k").alias("best_k"))


def segment_customers(
    scaled: DataFrame, fits: Mapping[int, FittedClusters], **silhouette_options
) -> tuple[DataFrame, DataFrame]:
    """Score every fit, keep the best k and label the customers; returns (labelled, scores).

    The best fit is already at hand, so nothing is fitted again for the chosen k.
    """
    labelled = label_all(scaled, {k: f.centers for k, f in fits.items()})
    measured = silhouette(labelled, {k: f"cluster_{k}" for k in fits}, **silhouette_options)
    rows = [(r["k"], r["silhouette"]) for r in measured.collect()]  # one row per k
    scores = scaled.sparkSession.createDataFrame(rows, "k int, silhouette double")
    best_k = min(rows, key=lambda r: (-r[1], r[0]))[0]
    return assign_clusters(scaled, fits[best_k].centers), scores


def cluster_profile(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(
        *[F.round(F.avg(m), 2).alias(f"{m}_mean") for m in MEASURES],
        F.count("customer_id").alias("n"),
    )
