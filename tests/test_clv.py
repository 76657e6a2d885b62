import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.fitting import Shape, minimise_positive
from ledgerloom.functions.gamma import digamma, trigamma
from ledgerloom.functions.hypergeometric import hyp2f1_series
from ledgerloom.operators import clv
from ledgerloom.plans.log import TransactionLog
from ledgerloom.plans.pins import PINNED_PURCHASES, PINNED_SPEND

SUMMARY = "customer_id long, frequency long, recency double, T double, monetary_value double"


def summary(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SUMMARY)


def test_published_expectation(spark):
    weekly = clv.PurchaseModel(r=0.243, alpha=4.414, a=0.793, b=2.426)
    df = summary(spark, [(2, 30.43, 38.86, 1.0)])
    got = df.select(clv.expected_purchases(weekly, 39).alias("e")).first()["e"]
    assert got == pytest.approx(1.226, abs=5e-4)


def test_expectations_in_days(spark):
    rows = [(0, 0.0, 400.0, 0.0), (1, 30.0, 400.0, 1.0), (12, 300.0, 420.0, 1.0), (3, 10.0, 600.0, 1.0)]
    df = clv.predict_purchases(summary(spark, rows), PINNED_PURCHASES)
    got = [r["expected_purchases_6m"] for r in df.orderBy("customer_id").collect()]
    assert got == pytest.approx([0.09574950, 0.10156116, 1.19894634, 0.00067322], abs=1e-8)


def test_expectation_of_new_customers_with_a_short_scale(spark):
    """T = 0 and a small alpha bring the series' argument close to 1."""
    model = clv.PurchaseModel(r=0.5, alpha=2.0, a=0.8, b=2.5)
    df = summary(spark, [(0, 0.0, 0.0, 0.0)])
    got = df.select(clv.expected_purchases(model, 180).alias("e")).first()["e"]
    r, alpha, a, b, t = 0.5, 2.0, 0.8, 2.5, 180.0
    # The untransformed series, summed until it has died out.
    total, term, z = 1.0, 1.0, t / (alpha + t)
    for n in range(20_000):
        term *= (r + n) * (b + n) / ((a + b - 1 + n) * (n + 1)) * z
        total += term
    expected = (a + b - 1) / (a - 1) * (1 - (alpha / (alpha + t)) ** r * total)
    assert got == pytest.approx(expected, rel=1e-7)


@pytest.mark.parametrize(("a", "b"), [(0.793, 2.426), (1.0, 2.0), (0.4, 0.6), (0.05, 0.3)])
def test_expectation_for_any_scale(spark, a, b):
    """Against the mean over the drop-out chance, on a fine grid of its logit."""
    rows = [(0, 0.0, 0.0, 0.0), (0, 0.0, 5.0, 0.0), (5, 100.0, 101.0, 1.0), (200, 900.0, 1000.0, 1.0)]
    df = summary(spark, rows).coalesce(1)
    y = np.arange(-900, 200, 0.004)
    log_p, log_q = -np.logaddexp(0, -y), -np.logaddexp(0, y)
    p = np.exp(log_p)
    for alpha in (1e-9, 1e-2, 30.0, 1e6):
        model = clv.PurchaseModel(r=0.243, alpha=alpha, a=a, b=b)
        got = [r["e"] for r in df.select(clv.expected_purchases(model, 180.0).alias("e")).collect()]
        for (x, recency, age, _), found in zip(rows, got):
            weight = a * log_p + (b + x) * log_q
            weight = np.exp(weight - weight.max())
            age += alpha
            level = np.maximum(p, 1e-290)
            mean = np.where(p > 1e-290, -np.expm1(-(model.r + x) * np.log1p(p * 180 / age)) / level, (model.r + x) * 180 / age)
            gone = a / (b + x - 1) * (age / (alpha + recency)) ** (model.r + x) if x else 0.0
            assert found == pytest.approx((weight * mean).sum() / weight.sum() / (1 + gone), rel=1e-8)


def test_flags_of_fits_go_with_the_results(spark):
    rows = summary(spark, [(2, 30.0, 60.0, 5.0)])
    assert clv.expected_profit(rows, clv.SpendModel(1.0, 0.9, 1.0)).first()["expected_avg_profit"] is None
    flagged = clv.with_fit_flags(rows, "spend", clv.SpendModel(1.0, 0.9, 1.0, degenerate=True, converged=False))
    assert flagged.select("spend_degenerate", "spend_converged").first()[:] == (True, False)
    table = clv.model_parameters(rows, PINNED_PURCHASES, PINNED_SPEND)
    assert [r["parameter"] for r in table.collect()] == ["r", "alpha", "a", "b", "p", "q", "v"]


def test_a_search_that_ends_at_its_edge_has_not_converged():
    def log(points):
        return [Shape(math.log(p), np.array([1 / p]), np.array([[-1 / p**2]])) for (p,) in points]

    def square(points):
        return [Shape((p - 2) ** 2, np.array([2 * (p - 2)]), np.array([[2.0]])) for (p,) in points]

    low, good = minimise_positive(log, (1.0,)), minimise_positive(square, (1.0,))
    assert not low.converged and good.converged and good.parameters[0] == pytest.approx(2)


def test_series_matches_a_closed_form():
    # 2F1(1, 1; 2; z) = -ln(1 - z) / z
    z = np.array([0.3, 0.01, 0.85])
    assert hyp2f1_series(1.0, 1.0, np.full(3, 2.0), z) == pytest.approx(-np.log(1 - z) / z)
    assert hyp2f1_series(1.0, 1.0, np.array([2.0]), np.array([0.0])) == pytest.approx([1.0])


def test_histories_with_nulls_have_no_expectation(spark):
    rows = [(2, 30.0, 60.0, 5.0), (2, None, 60.0, 5.0), (None, 30.0, 60.0, 5.0), (2, 30.0, None, 5.0)]
    got = clv.predict_purchases(summary(spark, rows), PINNED_PURCHASES).orderBy("customer_id").collect()
    assert [r["expected_purchases_6m"] is None for r in got] == [False, True, True, True]
    assert clv.discounted_value(summary(spark, rows[:1]).where("false"), PINNED_PURCHASES).count() == 0


def test_day_grain_summary(tx):
    log = TransactionLog(
        tx(
            [
                ("1", "a", 1, "2010-01-01 09:00", 10, 1),
                ("2", "a", 1, "2010-01-01 18:00", 10, 1),
                ("3", "a", 1, "2010-01-11 08:00", 10, 1),
                ("4", "a", 1, "2010-01-21 07:00", 10, 1),
                ("5", "a", 1, "2010-01-21 23:00", 10, 1),
                ("6", "a", 1, "2010-01-05 10:00", 10, 2),
                ("7", "a", 1, "2010-01-05 11:00", 10, 2),
            ]
        )
    )
    rows = {r["customer_id"]: tuple(r)[1:] for r in log.rfmt.collect()}
    assert rows == {1: (2, 20, 20, 15.0), 2: (0, 0, 16, 0.0)}
    assert log.rfm.where("customer_id = 2").first()["frequency"] == 2
    assert [r["customer_id"] for r in clv.repeat_customers(log.rfmt).collect()] == [1]
    assert log.last_ts == datetime(2010, 1, 21, 23, 0)


def test_value_is_a_sum_over_months(spark):
    df = summary(spark, [(3, 100.0, 150.0, 20.0)])
    curve = [
        df.select(clv.expected_purchases(PINNED_PURCHASES, d).alias("e")).first()["e"]
        for d in range(30, 181, 30)
    ]
    flows = np.diff([0.0, *curve]) * 20.0 / 1.01 ** np.arange(1, 7)
    got = clv.discounted_value(df, PINNED_PURCHASES).first()["clv_6m"]
    assert got == pytest.approx(flows.sum())


def test_value_may_use_the_modelled_spend(spark):
    df = clv.expected_profit(summary(spark, [(3, 100.0, 150.0, 20.0)]), PINNED_SPEND)
    row = clv.discounted_value(df, PINNED_PURCHASES, value_col="expected_avg_profit").first()
    plain = clv.discounted_value(df, PINNED_PURCHASES).first()
    assert row["clv_6m"] / plain["clv_6m"] == pytest.approx(row["expected_avg_profit"] / 20.0)


def test_expected_profit_lies_between_own_and_population_mean(spark):
    population = PINNED_SPEND.v * PINNED_SPEND.p / (PINNED_SPEND.q - 1)
    row = clv.expected_profit(summary(spark, [(2, 5.0, 9.0, 100.0)]), PINNED_SPEND).first()
    assert population < row["expected_avg_profit"] < 100.0


def test_customers_without_repeat_purchases_keep_null(spark):
    clustered = spark.createDataFrame([(1, 0), (2, 0)], "customer_id long, cluster int")
    valued = spark.createDataFrame(
        [(1, 5.0, 1.0, 2.0)],
        "customer_id long, clv_6m double, expected_purchases_6m double, expected_avg_profit double",
    )
    joined = clv.rfm_with_clv(clustered, valued)
    assert [r["clv_6m"] for r in clv.top_by(joined, "clv_6m").collect()] == [5.0, None]
    assert clv.clv_by_cluster(joined).first()["avg_clv_6m"] == 5.0


def test_minimiser_on_a_known_function():
    def shape(a, b):
        u, w = math.log(a) - 1, math.log(b) + math.log(a)
        slope = np.array([(2 * u + 20 * w) / a, 20 * w / b])
        curve = np.array([[(22 - 2 * u - 20 * w) / a**2, 20 / (a * b)], [20 / (a * b), (20 - 20 * w) / b**2]])
        return Shape(u**2 + 10 * w**2, slope, curve)

    def losses(points):
        return [shape(*p) for p in points]

    best = minimise_positive(losses, (3.0, 3.0))
    assert best.parameters == pytest.approx((math.e, 1 / math.e), rel=1e-4)
    assert best.gradient_norm < 1e-6


def simulated_purchases(n, r, alpha, a, b, seed=11):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        rate, leave = rng.gamma(r, 1 / alpha), rng.beta(a, b)
        age = rng.uniform(200, 400)
        now, times = 0.0, []
        while True:
            now += rng.exponential(1 / rate)
            if now > age:
                break
            times.append(now)
            if rng.random() < leave:
                break
        rows.append((len(times), float(times[-1]) if times else 0.0, float(age), 1.0))
    return rows


def test_purchase_fit_recovers_known_parameters(spark):
    df = summary(spark, simulated_purchases(6000, r=0.8, alpha=20.0, a=0.9, b=2.5))
    model = clv.fit_purchases(df, penalty=0.0)
    assert not model.degenerate and model.gradient < 1e-5
    assert model.r == pytest.approx(0.8, rel=0.15)
    assert model.alpha == pytest.approx(20.0, rel=0.2)
    assert model.a / (model.a + model.b) == pytest.approx(0.9 / 3.4, rel=0.15)


def test_penalty_pulls_parameters_down(spark):
    df = summary(spark, simulated_purchases(1500, r=0.8, alpha=20.0, a=0.9, b=2.5))
    free, held = clv.fit_purchases(df, penalty=0.0), clv.fit_purchases(df, penalty=0.05)
    assert held.b < free.b


def test_spend_fit_recovers_known_parameters(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(8000):
        x = int(rng.integers(1, 12))
        rate = rng.gamma(4.0, 1 / 16.0)
        rows.append((x, 1.0, 2.0, float(rng.gamma(6.0 * x, 1 / (rate * x)))))
    model = clv.fit_spend(summary(spark, rows), penalty=0.0)
    assert not model.degenerate and model.gradient < 1e-5
    assert model.p == pytest.approx(6.0, rel=0.15)
    assert model.q == pytest.approx(4.0, rel=0.15)
    assert model.p * model.v / (model.q - 1) == pytest.approx(6.0 * 16.0 / 3.0, rel=0.1)


def test_purchases_without_drop_out_are_reported(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(800):
        days = np.sort(rng.integers(1, 300, rng.poisson(8)))
        rows.append((len(days), float(days[-1]) if len(days) else 0.0, 300.0, 1.0))
    model = clv.fit_purchases(summary(spark, rows))
    assert model.degenerate and model.a >= clv.PARAMETER_FLOOR
    scored = clv.predict_purchases(summary(spark, rows), model)
    assert scored.where("expected_purchases_6m < 0 OR isnan(expected_purchases_6m)").isEmpty()


def numeric(evaluate, at, h=1e-5):
    """Slope and curvature by differences of values alone."""
    def value(p):
        return evaluate([tuple(p)])[0].value

    at = np.asarray(at, float)
    nudge = np.diag(h * at)
    slope = np.array([(value(at + d) - value(at - d)) / (2 * d.max()) for d in nudge])
    def slopes(p):
        return evaluate([tuple(p)])[0].slope

    return slope, np.array([(slopes(at + d) - slopes(at - d)) / (2 * d.max()) for d in nudge])


def test_derivatives_of_log_gamma():
    for x in (1e-3, 0.3, 1.0, 7.7, 40.0, 1e6):
        h = 1e-5 * x
        assert digamma(x) == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-4, abs=1e-7)
        assert trigamma(x) == pytest.approx((digamma(x + h) - digamma(x - h)) / (2 * h), rel=1e-6)
    assert digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-14)
    assert trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-13)


def test_exact_derivatives_of_both_likelihoods(spark):
    rows = summary(spark, [(0, 0.0, 50.0, 0.0), (0, 0.0, 400.0, 0.0), (1, 30.0, 90.0, 7.0), (12, 300.0, 420.0, 3.5), (3, 9.0, 600.0, 90.0)])
    grouped = clv.purchase_histogram(rows).cache()
    counts = clv._counts_of_x(grouped)
    for at in ((0.243, 30.9, 0.79, 2.4), (2.0, 0.5, 0.05, 0.1), (0.01, 900.0, 5.0, 40.0)):
        found = clv._purchase_shapes(grouped, counts, [at])[0]
        slope, curve = numeric(lambda points: clv._purchase_shapes(grouped, counts, points), at)
        assert found.slope == pytest.approx(slope, rel=1e-4, abs=1e-6)
        assert found.curve == pytest.approx(curve, rel=1e-4, abs=1e-6)
    spent = clv.spend_rows(clv.repeat_customers(rows)).cache()
    counts = clv._spend_counts(spent)
    for at in ((6.25, 3.74, 15.44), (0.1, 1.1, 200.0)):
        found = clv._spend_shapes(spent, counts, [at])[0]
        slope, curve = numeric(lambda points: clv._spend_shapes(spent, counts, points), at)
        assert found.slope == pytest.approx(slope, rel=1e-4, abs=1e-6)
        assert found.curve == pytest.approx(curve, rel=1e-4, abs=1e-6)


def test_a_fit_needs_few_jobs_and_ends_where_a_plain_one_does(spark, monkeypatch):
    df = summary(spark, simulated_purchases(3000, r=0.8, alpha=20.0, a=0.9, b=2.5))
    asked = []
    shapes = clv._purchase_shapes
    monkeypatch.setattr(clv, "_purchase_shapes", lambda *a, **k: asked.append(1) or shapes(*a, **k))
    monkeypatch.setattr(clv, "START_HISTORIES", 500)
    model, few = clv.fit_purchases(df), len(asked)
    monkeypatch.setattr(clv, "_purchase_start", lambda grouped, scale, penalty, at: at)
    asked.clear()
    plain = clv.fit_purchases(df)
    assert model.converged and model.lowest and few <= len(asked) / 2
    for one, two in zip((model.r, model.alpha, model.a, model.b), (plain.r, plain.alpha, plain.a, plain.b)):
        assert one == pytest.approx(two, rel=1e-5)
