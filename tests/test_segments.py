import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from ledgerloom.functions import lloyd
from ledgerloom.operators import rfm, segments
from ledgerloom.session import stage

COLUMNS = list(rfm.SCALED)


def brute_silhouette(points, labels):
    """Straight from the definition."""
    points, labels = np.asarray(points), np.asarray(labels)
    distance = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    scores = []
    for i, own in enumerate(labels):
        mates = (labels == own) & (np.arange(len(labels)) != i)
        others = [distance[i, labels == c].mean() for c in set(labels) - {own}]
        if not mates.any() or not others:
            scores.append(0.0)
            continue
        inner, outer = distance[i, mates].mean(), min(others)
        scores.append((outer - inner) / max(outer, inner))
    return float(np.mean(scores))


def scaled_points(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal(c, 0.4, (n // 3, 3)) for c in (-2, 0, 2)])
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "customer_id long, z_recency double, z_frequency double, z_monetary double")


def labelled(spark, n=90):
    df = scaled_points(spark, n)
    return df.withColumns(
        {
            "two": (F.col("z_recency") > 0).cast("int"),
            "three": (F.when(F.col("customer_id") == 0, 2).when(F.col("z_monetary") > 1, 1).otherwise(0)),
        }
    )


@pytest.mark.parametrize("block_rows", [7, 40, 4096])
def test_silhouette_follows_the_definition(spark, block_rows):
    df = labelled(spark)
    got = segments.silhouette(df, {2: "two", 3: "three"}, block_rows=block_rows).collect()
    local = df.toPandas()
    for row, name in zip(sorted(got), ("two", "three")):
        assert row["silhouette"] == pytest.approx(brute_silhouette(local[COLUMNS], local[name]))


def test_silhouette_of_near_customers_far_from_the_origin(spark):
    """Distances taken as products keep their digits where customers nearly coincide."""
    draw = np.random.default_rng(3)
    at = np.repeat(draw.normal(1e3, 1, (6, 3)), 20, axis=0) + draw.normal(0, 1e-6, (120, 3))
    labels = np.arange(120) // 20 % 2
    rows = [(i, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(at, labels))]
    df = spark.createDataFrame(rows, ["customer_id", *COLUMNS, "c"])
    got = segments.silhouette(df, {2: "c"}, block_rows=50).first()["silhouette"]
    assert got == pytest.approx(brute_silhouette(at, labels), rel=1e-9)
    assert segments.BLOCK_ROWS >= 1 << 16  # every row meets all blocks, so large tables need few of them


def test_silhouette_of_identical_customers(spark):
    rows = [(i, 0.0, 0.0, 0.0, i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "customer_id long, z_recency double, z_frequency double, z_monetary double, c int")
    assert segments.silhouette(df, {2: "c"}).first()["silhouette"] == 0.0


def test_cells_keep_every_customer_and_stay_near(spark):
    df = labelled(spark, 300)
    exact = segments.silhouette(df, {2: "two"}).first()["silhouette"]
    near = segments.silhouette(df, {2: "two"}, grid=0.05).first()["silhouette"]
    assert near == pytest.approx(exact, abs=0.02)
    on_grid = df.withColumns({c: F.rint(F.col(c) / 0.5) * 0.5 for c in COLUMNS})
    rounded = segments.silhouette(on_grid, {2: "two"}).first()["silhouette"]
    merged = segments.silhouette(df, {2: "two"}, grid=0.5).first()["silhouette"]
    assert merged == pytest.approx(rounded)


def test_squared_is_another_statistic(spark):
    df = labelled(spark)
    exact = segments.silhouette(df, {2: "two"}).first()["silhouette"]
    squared = segments.silhouette(df, {2: "two"}, method="squared").first()["silhouette"]
    assert squared > exact
    with pytest.raises(ValueError):
        segments.silhouette(df, {2: "two"}, method="guess")


def test_ties_go_to_the_smaller_k(spark):
    scores = spark.createDataFrame([(4, 0.5), (3, 0.5), (2, 0.1)], "k int, silhouette double")
    assert segments.select_k(scores).first()["best_k"] == 3


def test_fit_finds_separate_groups(spark):
    df = scaled_points(spark, 90)
    fits = segments.fit_kmeans(df, ks=(2, 3, 4), restarts=3)
    costs = [fits[k].wcss for k in (2, 3, 4)]
    assert costs == sorted(costs, reverse=True)
    assert fits[3].sizes == (30, 30, 30)
    assert fits[3].centers == tuple(sorted(fits[3].centers))
    labelled_df, scores = segments.segment_customers(df, fits)
    assert labelled_df.groupBy("cluster").count().collect().__len__() == 3
    assert all(-1 <= r["silhouette"] <= 1 for r in scores.collect())


def test_elbow_starts_with_the_total_spread(spark):
    df = scaled_points(spark, 90)
    fits = segments.fit_kmeans(df, ks=(2,), restarts=1)
    curve = segments.elbow_curve(df, fits).collect()
    local = df.toPandas()[COLUMNS].to_numpy()
    assert curve[0]["wcss"] == pytest.approx(((local - local.mean(axis=0)) ** 2).sum())
    assert [r["k"] for r in curve] == [1, 2]


def test_the_same_centers_whatever_the_partitions(spark):
    df = stage(scaled_points(spark, 300), "points")
    one = segments.fit_kmeans(df.coalesce(1), ks=(4,), restarts=2)[4]
    two = segments.fit_kmeans(df.repartition(6), ks=(4,), restarts=2)[4]
    assert one.sizes == two.sizes and np.allclose(one.centers, two.centers, atol=1e-9)


def test_labels_match_the_fitted_sizes(spark):
    df = scaled_points(spark, 90)
    fit = segments.fit_kmeans(df, ks=(3,), restarts=2)[3]
    counts = segments.assign_clusters(df, fit.centers).groupBy("cluster").count().orderBy("cluster")
    assert tuple(r["count"] for r in counts.collect()) == fit.sizes


def brute_pass(points, centers):
    apart = ((points[:, None] - centers[None]) ** 2).sum(axis=2)
    index = apart.argmin(axis=1)
    means = np.array([points[index == c].mean(axis=0) if (index == c).any() else centers[c] for c in range(len(centers))])
    return np.bincount(index, minlength=len(centers)), means, apart.min(axis=1).sum()


def test_one_scan_serves_all_fits(spark):
    df = scaled_points(spark, 300).repartition(3)
    points = df.select(*COLUMNS).toPandas().to_numpy()
    draw = np.random.default_rng(1)
    fits = {n: draw.normal(size=(k, 3)) for n, k in enumerate((1, 2, 2, 5, 9))}
    fits[9] = np.array([[0.0, 0, 0], [99.0, 99, 99]])  # one cluster stays empty
    for n, told in lloyd.scan(df, COLUMNS, fits).items():
        counts, means, cost = brute_pass(points, fits[n])
        assert (told.counts == counts).all() and told.cost == pytest.approx(cost, rel=1e-6)
        assert np.allclose(told.means(fits[n]), means, atol=1e-6)


def test_fits_advance_together_and_drop_out(spark, monkeypatch):
    df = stage(scaled_points(spark, 300), "points")
    points = df.select(*COLUMNS).toPandas().to_numpy()
    draw = np.random.default_rng(2)
    starts = [points[draw.choice(len(points), k, replace=False)] for k in (2, 3, 4, 6, 8, 8)]
    own = []
    for centers in starts:
        for steps in range(1, 31):
            moved = brute_pass(points, centers)[1]
            shift, centers = ((moved - centers) ** 2).sum(), moved
            if shift <= 1e-4:
                break
        own.append((steps, centers, brute_pass(points, centers)[2]))
    seen = []
    scan = lloyd.scan
    monkeypatch.setattr(lloyd, "scan", lambda rows, columns, fits: seen.append(len(fits)) or scan(rows, columns, fits))
    found = lloyd.fit_all(df, COLUMNS, starts, 30, 1e-4)
    for (_, centers, cost), (got, told) in zip(own, found, strict=True):
        assert np.allclose(got, centers, atol=1e-5) and told.cost == pytest.approx(cost, rel=1e-5)
    # One scan per iteration of the longest fit and one for its cost; fits that are done take no part.
    assert len(seen) == max(s for s, _, _ in own) + 1 and seen == sorted(seen, reverse=True) and seen[-1] < len(starts)


def test_costs_as_good_as_single_fits(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(c, 0.7, (60, 3)) for c in rng.normal(0, 2, (7, 3))])
    df = spark.createDataFrame(
        [(i, *map(float, p)) for i, p in enumerate(points)], "customer_id long, z_recency double, z_frequency double, z_monetary double"
    )
    fits = segments.fit_kmeans(df, ks=(3, 5, 7), restarts=6)
    data = segments.vectors(df)
    for k, fit in fits.items():
        single = min(KMeans(k=k, maxIter=100, seed=s, tol=1e-3).fit(data).summary.trainingCost for s in range(3))
        assert fit.wcss <= single * 1.005
        assert sum(fit.sizes) == len(points)


def test_fit_of_few_and_no_customers(spark):
    df = scaled_points(spark, 3)
    assert sum(segments.fit_kmeans(df, ks=(5,), restarts=2)[5].sizes) == 3
    assert segments.fit_kmeans(df.where("false"), ks=(2,), restarts=1)[2].sizes == (0, 0)
