"""Expected purchases and customer lifetime value.

Purchases follow the BG/NBD model (Fader, Hardie & Lee, 2005, "Counting Your Customers the
Easy Way"), spend the Gamma-Gamma model (Fader & Hardie, 2013). In their notation x is the
number of repeat purchase days, t the days from first to last purchase and T the days from
first purchase to the end of observation.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ledgerloom.constants import (
    CLV_DAYS_PER_MONTH,
    CLV_MONTHLY_DISCOUNT,
    CLV_MONTHS,
    MODEL_PENALTY,
    PURCHASE_HORIZON_DAYS,
)
from ledgerloom.functions import ntz
from ledgerloom.functions.beta_mean import beta_mean
from ledgerloom.functions.fitting import Shape, minimise_positive
from ledgerloom.functions.gamma import digamma, trigamma
from ledgerloom.functions.hypergeometric import hyp2f1_series
from ledgerloom.session import stage

# Below these a fitted parameter has run off to its boundary and the formulas have poles.
PARAMETER_FLOOR = 1e-3
# Distance from the poles of the series within which it is not used.
POLE_GAP = 1e-3
# Histories of the sample whose optimum a fit starts from.
START_HISTORIES = 20_000
# Beyond this the series needs more than some 240 terms.
CALM_Z = 0.9


@dataclass(frozen=True)
class PurchaseModel:
    """BG/NBD parameters; ``alpha`` in days."""

    r: float
    alpha: float
    a: float
    b: float
    degenerate: bool = False
    loss: float | None = None
    gradient: float | None = None
    converged: bool = True
    lowest: bool = True


@dataclass(frozen=True)
class SpendModel:
    """Gamma-Gamma parameters."""

    p: float
    q: float
    v: float
    degenerate: bool = False
    loss: float | None = None
    gradient: float | None = None
    converged: bool = True
    lowest: bool = True


def rfmt_summary(sales: DataFrame, last_ts: datetime | None) -> DataFrame:
    """Repeat-purchase summary at day grain.

    Lines are first summed per customer and day. The mean over repeat days is the total
    without the first day's spend, so no window over a customer's days is needed.
    """
    day = F.to_date("invoice_ts")
    daily = sales.groupBy("customer_id", day.alias("day")).agg(F.sum("amount").alias("spend"))
    repeats = F.col("days") - 1
    return (
        daily.groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
            F.sum("spend").alias("total"),
            F.min_by("spend", "day").alias("first_spend"),
        )
        .select(
            "customer_id",
            repeats.alias("frequency"),
            F.datediff("last_day", "first_day").cast("bigint").alias("recency"),
            F.datediff(F.to_date(ntz(last_ts)), "first_day").cast("bigint").alias("T"),
            F.coalesce(
                F.try_divide(F.col("total") - F.col("first_spend"), repeats), F.lit(0.0)
            ).alias("monetary_value"),
        )
    )


def repeat_customers(rfmt: DataFrame) -> DataFrame:
    return rfmt.where(F.col("frequency") > 0)


# --- likelihoods -----------------------------------------------------------------------
#
# Spark has no log-gamma, but every gamma term depends on the customer only through x, the
# number of repeat days. Those terms are summed on the driver over the counts of x, at most
# one entry per day of the log. What is left per row is elementary and stays in the JVM.
#
# All points asked for go into one job: each row meets the few points and is summed per point
# before anything is shuffled. Points are data, not literals, so every job of a fit runs the
# same compiled code.


def _at_points(rows: DataFrame, names: Sequence[str], points: Sequence[Sequence[float]]) -> DataFrame:
    # One text literal, folded once when planned; a column per number would be slow to plan.
    entries = json.dumps([{"point": i, **dict(zip(names, p))} for i, p in enumerate(points)])
    fields = ", ".join(["point int", *[f"{n} double" for n in names]])
    return rows.select("*", F.inline(F.from_json(F.lit(entries), f"array<struct<{fields}>>")))


def _counts_of_x(grouped: DataFrame) -> list[tuple[int, int]]:
    found = grouped.groupBy("frequency").agg(F.sum("n").alias("n")).collect()
    return [(int(r["frequency"]), int(r["n"])) for r in found]


def purchase_histogram(rfmt: DataFrame) -> DataFrame:
    return rfmt.groupBy("frequency", "recency", "T").agg(F.count(F.lit(1)).alias("n"))


class _OnColumns:
    """Functions for terms of DataFrame columns."""

    log, exp = staticmethod(F.log), staticmethod(F.exp)

    @staticmethod
    def pick(test: Column, yes: Column, no: Column) -> Column:
        return F.when(test, yes).otherwise(no)


class _OnArrays:
    """The same for arrays, to look for a start on a sample."""

    log, exp, pick = staticmethod(np.log), staticmethod(np.exp), staticmethod(np.where)


# Entries on and above the diagonal of the second derivatives by (r, alpha, a, b).
_CORNER = tuple((i, j) for i in range(4) for j in range(i, 4))


def _purchase_row_terms(of, x, t, T, r, alpha, a, b) -> list:
    """What a history adds to the log-likelihood besides gamma terms: value, slope, curvature.

    The likelihood is a sum of two chances, still buying and gone since the last purchase; ``gone``
    is the share of the second. Derivatives of the logarithm of the sum are means of those of the
    two, plus the spread between them.
    """
    shape = r + x
    late, early = of.log(alpha + T), of.log(alpha + t)
    by_late, by_early = 1.0 / (alpha + T), 1.0 / (alpha + t)
    # Without repeats there is no second chance; any number that is no pole will do below.
    left = of.pick(x > 0, b + x - 1.0, b + 1.0)
    odds = of.log(a) - of.log(left) + shape * (late - early)
    high = of.pick(odds > 0, odds, 0.0 * odds)
    small = of.exp(-abs(odds) if of is _OnArrays else -F.abs(odds))
    some = of.pick(x > 0, 1.0 + 0.0 * odds, 0.0 * odds)
    value = -shape * late + some * (high + of.log(1.0 + small))
    gone = some * of.pick(odds > 0, 1.0 / (1.0 + small), small / (1.0 + small))
    alive = 1.0 - gone
    both = gone * alive
    rate = alive * by_late + gone * by_early
    slope = [-alive * late - gone * early, -shape * rate, gone / a, -gone / left]
    apart = [late - early, -shape * (by_early - by_late), 1.0 / a, -1.0 / left]
    own = {
        (0, 1): -rate,
        (1, 1): shape * (alive * by_late * by_late + gone * by_early * by_early),
        (2, 2): -gone / (a * a),
        (3, 3): gone / (left * left),
    }
    curve = [both * apart[i] * apart[j] + own.get((i, j), 0.0) for i, j in _CORNER]
    return [value, *slope, *curve]


def _purchase_gamma_terms(x: int, r: float, alpha: float, a: float, b: float) -> np.ndarray:
    lg, one, two = math.lgamma, digamma, trigamma
    value = lg(r + x) - lg(r) + r * math.log(alpha) + lg(a + b) + lg(b + x) - lg(b) - lg(a + b + x)
    left, left_2 = one(a + b) - one(a + b + x), two(a + b) - two(a + b + x)
    slope = [one(r + x) - one(r) + math.log(alpha), r / alpha, left, left + one(b + x) - one(b)]
    own = {
        (0, 0): two(r + x) - two(r),
        (0, 1): 1.0 / alpha,
        (1, 1): -r / alpha**2,
        (2, 2): left_2,
        (2, 3): left_2,
        (3, 3): left_2 + two(b + x) - two(b),
    }
    return np.array([value, *slope, *[own.get(at, 0.0) for at in _CORNER]])


def _shape(terms: np.ndarray, size: int) -> Shape:
    """From value, slope and the corner of the second derivatives in a row."""
    curve = np.zeros((size, size))
    corner = [(i, j) for i in range(size) for j in range(i, size)]
    for (i, j), term in zip(corner, terms[1 + size :], strict=True):
        curve[i, j] = curve[j, i] = term
    return Shape(float(terms[0]), np.asarray(terms[1 : 1 + size], float), curve)


def _loss(shape: Shape, total: int, penalty: float, at: Sequence[float]) -> Shape:
    """Mean negative log-likelihood with an L2 penalty."""
    p = np.asarray(at, float)
    return Shape(
        -shape.value / total + penalty * float(p @ p),
        -shape.slope / total + 2 * penalty * p,
        -shape.curve / total + 2 * penalty * np.eye(len(p)),
    )


def _purchase_shapes(
    grouped: DataFrame,
    counts: Sequence[tuple[int, int]],
    points: Sequence[Sequence[float]],
    scale: float = 1.0,
) -> list[Shape]:
    """Log-likelihood with its derivatives at all ``points``, from one aggregate."""
    met = _at_points(grouped, ("r", "alpha", "a", "b", "scale"), [(*p, scale) for p in points])
    x = F.col("frequency").cast("double")
    t, T = F.col("recency") * F.col("scale"), F.col("T") * F.col("scale")
    terms = _purchase_row_terms(_OnColumns, x, t, T, *[F.col(n) for n in ("r", "alpha", "a", "b")])
    sums = [F.sum(F.col("n") * term).alias(f"t{i}") for i, term in enumerate(terms)]
    seen = {row["point"]: row for row in met.groupBy("point").agg(*sums).collect()}  # a row per point
    return [
        _shape(
            np.array([seen[i][f"t{j}"] for j in range(len(terms))])
            + sum(c * _purchase_gamma_terms(k, *p) for k, c in counts),
            4,
        )
        for i, p in enumerate(points)
    ]


def _purchase_start(
    grouped: DataFrame, scale: float, penalty: float, at: Sequence[float]
) -> Sequence[float]:
    """The optimum of a sample of at most START_HISTORIES histories, found on the driver."""
    hashed = F.xxhash64("frequency", "recency", "T")
    some = grouped.orderBy(hashed, "frequency", "recency", "T").limit(START_HISTORIES).toPandas()
    n, x = some["n"].to_numpy(float), some["frequency"].to_numpy(float)
    t, T = (some[c].to_numpy(float) * scale for c in ("recency", "T"))
    ks, places = np.unique(some["frequency"].to_numpy(), return_inverse=True)
    counts = np.bincount(places, n)

    def losses(points: Sequence[Sequence[float]]) -> list[Shape]:
        found = []
        for p in points:
            terms = np.array([float((n * term).sum()) for term in _purchase_row_terms(_OnArrays, x, t, T, *p)])
            terms = terms + sum(c * _purchase_gamma_terms(int(k), *p) for k, c in zip(ks, counts))
            found.append(_loss(_shape(terms, 4), n.sum(), penalty, p))
        return found

    if not len(some):
        return at
    best = minimise_positive(losses, at)
    return best.parameters if best.converged else at


def purchase_loglik(rfmt: DataFrame, model: PurchaseModel) -> DataFrame:
    grouped = purchase_histogram(rfmt)
    counts = _counts_of_x(grouped)
    found = _purchase_shapes(grouped, counts, [(model.r, model.alpha, model.a, model.b)])[0]
    total = sum(c for _, c in counts)
    return rfmt.sparkSession.createDataFrame([(total, found.value)], "n bigint, loglik double")


def _slopes(like: DataFrame, shape: Shape, names: Sequence[str], total: int) -> DataFrame:
    rows = [
        (name, float(shape.slope[i]) / total, float(shape.curve[i, i]) / total) for i, name in enumerate(names)
    ]
    return like.sparkSession.createDataFrame(rows, "parameter string, slope double, curvature double")


def purchase_slopes(rfmt: DataFrame, model: PurchaseModel) -> DataFrame:
    """(parameter, slope, curvature) of the mean log-likelihood at ``model``, by each parameter alone."""
    grouped = purchase_histogram(rfmt)
    counts = _counts_of_x(grouped)
    found = _purchase_shapes(grouped, counts, [(model.r, model.alpha, model.a, model.b)])[0]
    return _slopes(rfmt, found, ("r", "alpha", "a", "b"), sum(c for _, c in counts))


def fit_purchases(
    rfmt: DataFrame, penalty: float = MODEL_PENALTY, scale_time: bool = True
) -> PurchaseModel:
    """Maximum likelihood with an L2 penalty, on customers grouped by (x, t, T).

    With ``scale_time`` the longest T counts as 1 during the fit, so the penalty acts on the
    scaled ``alpha``. Parameters that ran off to zero are floored and reported. The histogram
    is staged: losing an executor costs a small scan, not another pass over the log. Newton's steps
    start from the optimum of a sample, so only the last few are jobs over all histories.
    """
    histogram = stage(purchase_histogram(rfmt), "purchase-histogram")
    grouped = histogram.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = _counts_of_x(grouped)
        longest = grouped.agg(F.max("T")).first()[0] or 1
        scale = 1.0 / longest if scale_time else 1.0
        total = sum(c for _, c in counts)

        def losses(points: Sequence[Sequence[float]]) -> list[Shape]:
            found = _purchase_shapes(grouped, counts, points, scale)
            return [_loss(f, total, penalty, p) for f, p in zip(found, points)]

        best = minimise_positive(losses, _purchase_start(grouped, scale, penalty, (1.0, 1.0, 1.0, 1.0)))
    finally:
        grouped.unpersist()
    r, alpha, a, b = best.parameters
    return PurchaseModel(
        r,
        alpha / scale,
        max(a, PARAMETER_FLOOR),
        max(b, PARAMETER_FLOOR),
        degenerate=min(a, b) < PARAMETER_FLOOR,
        loss=best.value,
        gradient=best.gradient_norm,
        converged=best.converged,
        lowest=best.lowest,
    )


def spend_rows(repeat: DataFrame) -> DataFrame:
    """Customers the spend model can use: repeat buyers with a positive mean spend."""
    return repeat.where((F.col("frequency") > 0) & (F.col("monetary_value") > 0)).select(
        "frequency", "monetary_value"
    )


_SPEND_SUMS = ("log_m", "x_log_m", "x_log_x", "mix", "x_mix", "inv", "x_inv", "inv2", "x_inv2")


def _spend_row_terms(of, x, m, v) -> list:
    """Sums of these over customers make up the log-likelihood and its derivatives for any p and q."""
    pot = x * m + v
    inv = 1.0 / pot
    return [of.log(m), x * of.log(m), x * of.log(x), of.log(pot), x * of.log(pot), inv, x * inv, inv * inv, x * inv * inv]


def _spend_shape(s: Sequence[float], counts: Sequence[tuple[int, int]], p: float, q: float, v: float) -> Shape:
    log_m, x_log_m, x_log_x, mix, x_mix, inv, x_inv, inv2, x_inv2 = s
    lg, one, two = math.lgamma, digamma, trigamma
    n = sum(c for _, c in counts)
    gammas = np.zeros(6)
    for k, c in counts:
        top, top_2 = one(p * k + q), two(p * k + q)
        gammas += c * np.array(
            [
                lg(p * k + q) - lg(p * k) - lg(q) + q * math.log(v),
                k * (top - one(p * k)),
                top - one(q) + math.log(v),
                k * k * (top_2 - two(p * k)),
                k * top_2,
                top_2 - two(q),
            ]
        )
    terms = [
        gammas[0] + p * (x_log_m + x_log_x - x_mix) - log_m - q * mix,
        gammas[1] + x_log_m + x_log_x - x_mix,
        gammas[2] - mix,
        n * q / v - p * x_inv - q * inv,
        gammas[3], gammas[4], -x_inv,
        gammas[5], n / v - inv,
        -n * q / v**2 + p * x_inv2 + q * inv2,
    ]
    return _shape(np.array(terms), 3)


def _spend_shapes(
    rows: DataFrame, counts: Sequence[tuple[int, int]], points: Sequence[Sequence[float]]
) -> list[Shape]:
    scales = sorted({point[2] for point in points})
    met = _at_points(rows, ("v",), [(v,) for v in scales])
    terms = _spend_row_terms(_OnColumns, F.col("frequency").cast("double"), F.col("monetary_value"), F.col("v"))
    summed = met.groupBy("point").agg(*[F.sum(t).alias(n) for t, n in zip(terms, _SPEND_SUMS)])
    seen = {scales[row["point"]]: [row[n] for n in _SPEND_SUMS] for row in summed.collect()}  # a row per point
    return [_spend_shape(seen[v], counts, p, q, v) for p, q, v in points]


def _spend_start(rows: DataFrame, penalty: float, at: Sequence[float]) -> Sequence[float]:
    """The optimum of a sample of at most START_HISTORIES customers, found on the driver."""
    some = rows.orderBy(F.xxhash64("frequency", "monetary_value"), "frequency", "monetary_value")
    some = some.limit(START_HISTORIES).toPandas()
    x, m = some["frequency"].to_numpy(float), some["monetary_value"].to_numpy(float)
    counts = [(int(k), int(c)) for k, c in zip(*np.unique(x, return_counts=True))]

    def losses(points: Sequence[Sequence[float]]) -> list[Shape]:
        sums = [[float(np.sum(t)) for t in _spend_row_terms(_OnArrays, x, m, v)] for _, _, v in points]
        return [_loss(_spend_shape(s, counts, *p), len(x), penalty, p) for s, p in zip(sums, points)]

    if not len(some):
        return at
    best = minimise_positive(losses, at)
    return best.parameters if best.converged else at


def _spend_counts(rows: DataFrame) -> list[tuple[int, int]]:
    return _counts_of_x(rows.select("frequency", F.lit(1).alias("n")))


def spend_loglik(repeat: DataFrame, model: SpendModel) -> DataFrame:
    rows = spend_rows(repeat)
    counts = _spend_counts(rows)
    found = _spend_shapes(rows, counts, [(model.p, model.q, model.v)])[0]
    total = sum(c for _, c in counts)
    return repeat.sparkSession.createDataFrame([(total, found.value)], "n bigint, loglik double")


def spend_slopes(repeat: DataFrame, model: SpendModel) -> DataFrame:
    """(parameter, slope, curvature) of the mean log-likelihood at ``model``, by each parameter alone."""
    rows = spend_rows(repeat)
    counts = _spend_counts(rows)
    found = _spend_shapes(rows, counts, [(model.p, model.q, model.v)])[0]
    return _slopes(repeat, found, ("p", "q", "v"), sum(c for _, c in counts))


def fit_spend(repeat: DataFrame, penalty: float = MODEL_PENALTY) -> SpendModel:
    """Maximum likelihood with an L2 penalty, on repeat customers."""
    rows = stage(spend_rows(repeat), "spend-rows").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = _spend_counts(rows)
        total = sum(c for _, c in counts)

        def losses(points: Sequence[Sequence[float]]) -> list[Shape]:
            found = _spend_shapes(rows, counts, points)
            return [_loss(f, total, penalty, p) for f, p in zip(found, points)]

        best = minimise_positive(losses, _spend_start(rows, penalty, (1.0, 1.0, 1.0)))
    finally:
        rows.unpersist()
    p, q, v = best.parameters
    # With q at or below 1 the model's mean spend is undefined.
    return SpendModel(
        p, q, v, degenerate=q <= 1.0, loss=best.value, gradient=best.gradient_norm,
        converged=best.converged, lowest=best.lowest,
    )


def with_fit_flags(df: DataFrame, name: str, model: PurchaseModel | SpendModel) -> DataFrame:
    """Say in every row whether the fit that it comes from can be relied on."""
    return df.withColumns(
        {f"{name}_degenerate": F.lit(model.degenerate), f"{name}_converged": F.lit(model.converged)}
    )


def model_parameters(
    like: DataFrame, purchases: PurchaseModel, spend: SpendModel
) -> DataFrame:
    """Both fits as a table: a row per parameter, with loss, steepest slope and the flags."""
    rows = [
        (name, parameter, float(getattr(model, parameter)), model.loss, model.gradient, model.degenerate, model.converged)
        for name, model, parameters in (
            ("purchases", purchases, ("r", "alpha", "a", "b")),
            ("spend", spend, ("p", "q", "v")),
        )
        for parameter in parameters
    ]
    return like.sparkSession.createDataFrame(
        rows,
        "model string, parameter string, value double, loss double, gradient double,"
        " degenerate boolean, converged boolean",
    )


# --- predictions -----------------------------------------------------------------------


def expectation(
    model: PurchaseModel, horizon: float, x: np.ndarray, t: np.ndarray, T: np.ndarray
) -> np.ndarray:
    """Expected purchases within ``horizon`` days for histories (x, t, T).

    The paper's formula holds 2F1(r+x, b+x; a+b+x-1; z), whose terms first grow with x. Euler's
    transformation turns it into 2F1(a+b-1-r, a-1; a+b+x-1; z) times a power of 1-z that
    cancels most of the factor before it; the remaining series settles in a few dozen terms.

    Towards z = 1 (a horizon long against alpha and T) the series slows down without bound, and it
    has poles at a = 1 and a + b + x = 1. There the same expectation is taken as what it stands
    for: with drop-out chance p it is (1 - (age / (age + p t))^(r+x)) / p, averaged over p.
    """
    r, alpha, a, b = model.r, model.alpha, model.a, model.b
    age = alpha + T
    z = horizon / (age + horizon)
    shape = r + x
    alive = np.full(len(x), np.nan)
    calm = (z <= CALM_Z) & (abs(a - 1.0) > POLE_GAP) & (abs(a + b - 1.0) > POLE_GAP)
    if calm.any():
        low, bottom = z[calm], a + b - 1.0 + x[calm]
        series = hyp2f1_series(a + b - 1.0 - r, a - 1.0, bottom, low)
        alive[calm] = bottom / (a - 1.0) * (1.0 - (1.0 - low) ** (a - 1.0) * series)
    hard = ~calm & ~np.isnan(z)
    if hard.any():
        power, ratio = shape[hard], horizon / age[hard]
        alive[hard] = beta_mean(
            np.full(len(power), a), b + x[hard], lambda p: -np.expm1(-power * np.log1p(p * ratio)) / p,
            power * ratio, -np.expm1(-power * np.log1p(ratio)),
        )
    left = np.where(x > 0, b + x - 1.0, 1.0)
    gone = np.where(x > 0, a / left * (age / (alpha + t)) ** shape, 0.0)
    return alive / (1.0 + gone)


def _expected(model: PurchaseModel, weights: dict[float, float]) -> Column:
    """Weighted sum over horizons, worked out for a batch of customers at a time."""

    @F.pandas_udf("double")
    def summed(x: pd.Series, t: pd.Series, T: pd.Series) -> pd.Series:
        at = [v.to_numpy(float, na_value=np.nan) for v in (x, t, T)]
        with np.errstate(over="ignore", invalid="ignore"):
            return pd.Series(sum(w * expectation(model, h, *at) for h, w in weights.items()))

    found = summed(*[F.col(c).cast("double") for c in ("frequency", "recency", "T")])
    return F.when(~F.isnan(found), found)


def expected_purchases(model: PurchaseModel, horizon: float) -> Column:
    """Expected purchases within ``horizon`` days, given a customer's history; see :func:`expectation`.

    The series takes dozens to hundreds of terms, which arrays of customers do much faster than a
    fold of expressions for each row. A history with a null has no expectation.
    """
    return _expected(model, {float(horizon): 1.0})


def predict_purchases(
    rfmt: DataFrame, model: PurchaseModel, horizon: float = PURCHASE_HORIZON_DAYS
) -> DataFrame:
    return rfmt.withColumn("expected_purchases_6m", expected_purchases(model, horizon))


def expected_profit(repeat: DataFrame, model: SpendModel) -> DataFrame:
    """Mean spend per purchase: the customer's own mean drawn towards the population's.

    With ``q`` at or below 1 the model has no mean, and the column is NULL.
    """
    if model.q <= 1.0:
        return repeat.withColumn("expected_avg_profit", F.lit(None).cast("double"))
    x, m = F.col("frequency"), F.col("monetary_value")
    value = F.lit(model.p) * (F.lit(model.v) + x * m) / (F.lit(model.p) * x + F.lit(model.q - 1.0))
    return repeat.withColumn("expected_avg_profit", value)


def discounted_value(
    repeat: DataFrame,
    model: PurchaseModel,
    months: int = CLV_MONTHS,
    rate: float = CLV_MONTHLY_DISCOUNT,
    value_col: str = "monetary_value",
) -> DataFrame:
    """Discounted value of the purchases expected in each of the next months.

    Purchases are valued at the observed mean spend unless ``value_col`` names another column.
    Expectations at the month ends are differences of one cumulative curve, so the weights are
    collected per month end and each point of the curve is computed once.
    """
    weights = {}
    for i in range(1, months + 1):
        weight = (1.0 + rate) ** -i
        if i < months:
            weight -= (1.0 + rate) ** -(i + 1)
        weights[float(i * CLV_DAYS_PER_MONTH)] = weight
    return repeat.withColumn("clv_6m", F.col(value_col) * _expected(model, weights))


def rfm_with_clv(clustered: DataFrame, valued: DataFrame) -> DataFrame:
    """Every customer; those without repeat purchases keep NULL values."""
    return clustered.join(
        valued.select("customer_id", "clv_6m", "expected_purchases_6m", "expected_avg_profit"),
        "customer_id",
        "left",
    )


def top_by(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), "customer_id").limit(n)


def clv_by_cluster(rfm_clv: DataFrame) -> DataFrame:
    return (
        rfm_clv.groupBy("cluster")
        .agg(F.round(F.avg("clv_6m"), 2).alias("avg_clv_6m"))
        .orderBy(F.desc_nulls_last("avg_clv_6m"), "cluster")
    )
