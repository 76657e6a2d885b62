"""From a log to every result table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.constants import CLUSTER_COUNTS, KMEANS_RESTARTS
from ledgerloom.functions.forest import Forest
from ledgerloom.operators import actions, churn, clv, cohorts, segments
from ledgerloom.plans.log import TransactionLog
from ledgerloom.session import stage


def report_tables(log: TransactionLog) -> dict[str, DataFrame]:
    """The result tables that need no model fit."""
    retention = cohorts.retention_pct(log.staged_cohort_counts)
    return {
        "rfm": log.rfm,
        "rfm_scaled": log.staged_rfm_scaled,
        "rfmt": log.rfmt,
        "cohort_counts": log.staged_cohort_counts,
        "retention": retention,
        "retention_mature": cohorts.mature_cohorts(retention),
        "churn_features": log.churn_features,
    }


@dataclass(frozen=True)
class Scored:
    """Outcome of the churn side: the forest's report, probabilities and the action matrix."""

    report: DataFrame
    importance: DataFrame
    segmented: DataFrame
    medians: actions.Medians


def score_churn(log: TransactionLog, score: str = "test", **forest_options) -> Scored:
    """Train on three quarters of the customers and place the scored ones in the matrix.

    ``score="test"`` scores the held-out quarter; ``"all"`` every customer in scope.
    """
    if score not in ("test", "all"):
        raise ValueError(f"unknown score {score!r}")
    split = log.staged_split
    return place_churn(churn.fit_forest(split.where(~F.col("is_test")), **forest_options), split, score)


def place_churn(forest: Forest, split: DataFrame, score: str = "test") -> Scored:
    """What a forest says of the customers of ``split``."""
    scored = stage(churn.predict(forest, split), "scored")
    tested = scored.where("is_test")
    matrix = actions.action_matrix(scored if score == "all" else tested)
    medians = actions.action_medians(matrix)
    return Scored(
        churn.classification_report(tested),
        churn.feature_importance(forest),
        actions.assign_segment(matrix, medians),
        medians,
    )


@dataclass(frozen=True)
class Valued:
    """Outcome of the value side: fitted models, expected purchases of all, values of repeaters."""

    purchases: clv.PurchaseModel
    spend: clv.SpendModel
    expected: DataFrame
    customers: DataFrame


def value_customers(log: TransactionLog, value_col: str = "monetary_value") -> Valued:
    """Fit both models and value the repeat customers."""
    rfmt = stage(log.rfmt, "rfmt")
    purchases, spend = clv.fit_purchases(rfmt), clv.fit_spend(clv.repeat_customers(rfmt))
    expected = clv.predict_purchases(rfmt, purchases)
    expected = clv.with_fit_flags(expected, "purchases", purchases)
    priced = clv.with_fit_flags(
        clv.expected_profit(clv.repeat_customers(expected), spend), "spend", spend
    )
    valued = clv.discounted_value(priced, purchases, value_col=value_col)
    return Valued(purchases, spend, expected, valued)


def full_report(
    log: TransactionLog,
    silhouette_grid: float | None,
    ks: tuple[int, ...] = CLUSTER_COUNTS,
    restarts: int = KMEANS_RESTARTS,
    score: str = "test",
    value_col: str = "monetary_value",
    silhouette_epsilon: float | None = None,
) -> Mapping[str, DataFrame]:
    """Every result table, with all models fitted on the log.

    Make the log with ``reuse=True``: its lines are then read once for nearly all tables. The
    exact silhouette's work grows with the square of the customers, so the caller decides:
    ``silhouette_grid=None`` asks for it, a number gives the width of cells that bound the work,
    and ``silhouette_epsilon`` takes far groups of customers as a whole and bounds the error, see
    :func:`ledgerloom.operators.segments.silhouette`.
    """
    tables = report_tables(log)
    scaled = log.staged_rfm_scaled
    fits = segments.fit_kmeans(scaled, ks, restarts)
    how = {"grid": silhouette_grid} if silhouette_epsilon is None else {"method": "tree", "epsilon": silhouette_epsilon}
    clustered, scores = segments.segment_customers(scaled, fits, **how)
    valued = value_customers(log, value_col)
    rfm_clv = clv.rfm_with_clv(clustered, valued.customers)
    rfm_clv = clv.with_fit_flags(rfm_clv, "purchases", valued.purchases)
    rfm_clv = stage(clv.with_fit_flags(rfm_clv, "spend", valued.spend), "rfm-clv")
    churned = score_churn(log, score)
    averages = cohorts.early_vs_late_retention(tables["retention"], tables["retention_mature"])
    return {
        **tables,
        "elbow": segments.elbow_curve(scaled, fits),
        "silhouette": scores,
        "cluster_profile": segments.cluster_profile(clustered),
        "model_parameters": clv.model_parameters(rfm_clv, valued.purchases, valued.spend),
        "expected_purchases": valued.expected,
        "top_expected_purchases": clv.top_by(valued.expected, "expected_purchases_6m"),
        "rfm_clv": rfm_clv,
        "top_clv": clv.top_by(rfm_clv, "clv_6m"),
        "clv_by_cluster": clv.clv_by_cluster(rfm_clv),
        "retention_averages": averages,
        "retention_verdict": cohorts.retention_verdict(averages),
        "classification_report": churned.report,
        "feature_importance": churned.importance,
        "action_matrix": churned.segmented,
        "segment_summary": actions.segment_summary(churned.segmented),
        "revenue_at_risk": actions.revenue_at_risk(churned.segmented),
        "quadrant_chart": actions.quadrant_chart_data(churned.segmented, churned.medians),
    }
