"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.constants import CAP_QUANTILES
from ledgerloom.functions.sketches import RANK_ERROR
from ledgerloom.operators import actions, churn, cleaning, clv, cohorts, rfm, segments
from ledgerloom.plans.log import TransactionLog
from ledgerloom.plans.pins import (
    EXTRACT_BOUNDARY,
    PINNED_CENTERS,
    PINNED_PURCHASES,
    PINNED_SPEND,
    PIVOT_MONTHS,
    SCORED_CENTERS,
    SILHOUETTE_GRID,
    pinned_probability,
    ruled_forest,
)
from ledgerloom.plans.report import place_churn, report_tables, score_churn, value_customers
from ledgerloom.session import delete_path, stage, staged_path
from ledgerloom.sources import (
    load_tolerant,
    order_lines,
    publish_outputs,
    purchase_events,
    read_published,
    split_extracts,
    union_extracts,
    write_outputs,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


def over_log(name: str, dirty: bool = False) -> Callable:
    """Register a query that takes the log of the order tables."""

    def register(fn: Callable[[TransactionLog], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(TransactionLog(order_lines(spark, folder, dirty)))
        return fn

    return register


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    """Sums of doubles differ in their last bits between engines and runs."""
    return df.withColumns({n: F.round(n, places) for n in names})


def on_grid(df: DataFrame, name: str) -> DataFrame:
    """To multiples of 2^-16: a mean of decimal amounts does not fall halfway between two."""
    return df.withColumn(name, F.round(F.col(name) * 65536.0) / 65536.0)


# --- sources, sinks, set operations ------------------------------------------------------


@query("load_transactions")
def _load(spark: SparkSession, folder: str) -> DataFrame:
    return order_lines(spark, folder)


@query("union_extracts")
def _union(spark: SparkSession, folder: str) -> DataFrame:
    return union_extracts(*split_extracts(order_lines(spark, folder), EXTRACT_BOUNDARY))


@over_log("row_accounting", dirty=True)
def _accounting(log: TransactionLog) -> DataFrame:
    return cleaning.row_accounting(log.raw, log.staged_lines, log.reference)


@query("write_outputs")
def _write(spark: SparkSession, folder: str) -> DataFrame:
    """Write the result tables, read them back and report rows and the sum of a measure of each.

    Models are pinned. What was written is deleted afterwards.
    """
    log = TransactionLog(order_lines(spark, folder), reuse=True)
    segmented, medians = _segmented(log)
    tables = {
        **report_tables(log),
        "elbow": segments.single_cluster_wcss(log.staged_rfm_scaled),
        "silhouette": _pinned_scores(log),
        "cluster_profile": segments.cluster_profile(_clustered(log)),
        "segment_summary": actions.segment_summary(segmented),
        "quadrant_chart": actions.quadrant_chart_data(segmented, medians),
    }
    target = staged_path(spark, "outputs")
    paths = write_outputs(tables, target, {"retention": "cohort_month"})
    found = [
        spark.read.parquet(path).agg(
            F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.expr(measure)), 1).cast("double").alias("total")
        ).select(F.lit(name).alias("table_name"), "rows", "total")
        for name, path in paths.items()
        for measure in [WRITTEN_MEASURES[name]]
    ]
    rows = union_extracts(*found).collect()  # one row per table
    delete_path(spark, target)
    return spark.createDataFrame(rows, "table_name string, rows bigint, total double")


def _messy_export(spark: SparkSession, folder: str) -> str:
    """The order lines as a text export with records that cannot be read, by rule."""
    raw = order_lines(spark, folder)
    part, order = F.col("stock_code").cast("long"), F.regexp_replace("invoice", "C", "").cast("long")
    fields = [
        "invoice",
        "stock_code",
        F.when(part % 101 == 0, "many").otherwise(F.col("quantity").cast("string")),
        F.when(part % 107 == 0, "31.02.1996").otherwise(F.date_format("invoice_ts", "dd.MM.yyyy HH:mm")),
        F.when(part % 103 == 0, "12,5").otherwise(F.col("price").cast("string")),
        F.when(order % 109 == 0, "C-17").when(order % 50 != 0, F.concat(F.col("customer_id").cast("string"), F.lit(".0"))).otherwise(""),
    ]
    line = F.when(part % 113 == 0, F.concat_ws(";", "invoice", "stock_code")).otherwise(F.concat_ws(";", *fields))
    path = staged_path(spark, "export")
    raw.select(line.alias("value")).write.text(path)
    return path


def _messy_load(spark: SparkSession, folder: str):
    columns = {c: c for c in ("invoice", "stock_code", "quantity", "invoice_ts", "price", "customer_id")}
    return load_tolerant(
        spark, [_messy_export(spark, folder)], "csv", columns, {"sep": ";"}, ["dd.MM.yyyy HH:mm"]
    )


@query("load_tolerant")
def _load_tolerant(spark: SparkSession, folder: str) -> DataFrame:
    """The log that a messy export leaves."""
    return _messy_load(spark, folder).tx


@query("quarantine_counts")
def _quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return _messy_load(spark, folder).counts()


@query("row_accounting_tolerant")
def _accounting_tolerant(spark: SparkSession, folder: str) -> DataFrame:
    loaded = _messy_load(spark, folder)
    log = TransactionLog(cleaning.flag_returns(loaded.tx))
    return cleaning.row_accounting(log.raw, log.staged_lines, log.reference, loaded.quarantine)


@query("publish_outputs")
def _publish(spark: SparkSession, folder: str) -> DataFrame:
    """Publish tables, replace the mature cohorts of one, and report what readers find."""
    log = TransactionLog(order_lines(spark, folder), reuse=True)
    made = report_tables(log)
    target, by = staged_path(spark, "published"), {"retention": "cohort_month"}
    publish_outputs(spark, {n: made[n] for n in ("rfm", "cohort_counts", "retention")}, target, by)
    publish_outputs(spark, {"retention": made["retention_mature"]}, target, by, update=["retention"])
    found = [
        read_published(spark, target, name).agg(
            F.count(F.lit(1)).alias("rows"),
            F.round(F.sum(F.expr(WRITTEN_MEASURES[name])), 1).cast("double").alias("total"),
        ).select(F.lit(name).alias("table_name"), "rows", "total")
        for name in ("rfm", "cohort_counts", "retention")
    ]
    rows = union_extracts(*found).collect()  # one row per table
    delete_path(spark, target)
    return spark.createDataFrame(rows, "table_name string, rows bigint, total double")


WRITTEN_MEASURES = {
    "rfm": "monetary",
    "rfm_scaled": "abs(z_recency)",
    "rfmt": "T",
    "cohort_counts": "n_customers",
    "retention": "retention_pct",
    "retention_mature": "retention_pct",
    "churn_features": "monetary",
    "elbow": "wcss",
    "silhouette": "silhouette",
    "cluster_profile": "recency_mean",
    "segment_summary": "customer_count",
    "quadrant_chart": "log_monetary",
}


# --- cleaning ----------------------------------------------------------------------------


@over_log("drop_missing_customer", dirty=True)
def _drop_missing(log: TransactionLog) -> DataFrame:
    return cleaning.drop_missing_customer(log.raw)


@over_log("flag_returns", dirty=True)
def _flag(log: TransactionLog) -> DataFrame:
    return cleaning.flag_returns(log.raw.drop("is_return"))


@over_log("drop_returns", dirty=True)
def _drop_returns(log: TransactionLog) -> DataFrame:
    return cleaning.drop_returns(log.raw)


@over_log("positive_lines", dirty=True)
def _positive(log: TransactionLog) -> DataFrame:
    return cleaning.positive_lines(log.raw)


@over_log("positive_lines_nan")
def _positive_nan(log: TransactionLog) -> DataFrame:
    """Lines of which some quantities and prices are not numbers."""
    broken = {
        c: F.when(F.col("stock_code").cast("long") % n == 0, F.lit(float("nan"))).otherwise(F.col(c))
        for c, n in (("quantity", 53), ("price", 59))
    }
    return cleaning.positive_lines(log.raw.withColumns(broken))


def _caps_table(spark: SparkSession, profile: cleaning.SalesProfile) -> DataFrame:
    rows = [(c, lo, hi) for c, (lo, hi) in profile.caps.items()]
    return rounded(spark.createDataFrame(rows, "column string, lo double, hi double"), 6, "lo", "hi")


@over_log("outlier_thresholds")
def _thresholds(log: TransactionLog) -> DataFrame:
    return _caps_table(log.raw.sparkSession, log.profile)


@over_log("outlier_thresholds_dirty", dirty=True)
def _thresholds_dirty(log: TransactionLog) -> DataFrame:
    return _caps_table(log.raw.sparkSession, log.profile)


@over_log("outlier_thresholds_sketched")
def _thresholds_sketched(log: TransactionLog) -> DataFrame:
    """Approximate caps from stored sketches of two extracts, and whether their ranks are as near as stated."""
    extracts = split_extracts(log.staged_tx, EXTRACT_BOUNDARY)
    kept = [stage(cleaning.sketch_sales(cleaning.sale_lines(e)), "sketches") for e in extracts]
    profile = cleaning.profile_from_sketches(union_extracts(*kept))
    lines, checks = log.staged_lines, []
    for c, caps in profile.caps.items():
        for name, cap, share in zip(("lo", "hi"), caps, CAP_QUANTILES):
            # Equal values share a range of ranks; the wanted one has to be near it.
            below, upto = F.count_if(F.col(c) < cap) / F.count(c), F.count_if(F.col(c) <= cap) / F.count(c)
            checks.append(((below <= share + RANK_ERROR) & (upto >= share - RANK_ERROR)).alias(f"{c}_{name}"))
    told = lines.agg(F.count(F.lit(1)).alias("n"), *checks)
    per_column = [
        F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"{c}_lo").alias("lo_near"), F.col(f"{c}_hi").alias("hi_near"))
        for c in profile.caps
    ]
    return told.select(F.inline(F.array(*per_column)))


@over_log("winsorize")
def _winsorize(log: TransactionLog) -> DataFrame:
    capped = cleaning.winsorize(log.staged_lines, log.profile.caps)
    return rounded(capped, 8, "quantity", "price")


@over_log("line_amount")
def _amount(log: TransactionLog) -> DataFrame:
    picked = log.sales.select("invoice", "stock_code", "customer_id", "amount")
    return rounded(picked, 4, "amount")


@over_log("customer_return_rate")
def _return_rate(log: TransactionLog) -> DataFrame:
    return cleaning.return_rates(log.tx)


@over_log("customer_return_rate_dirty", dirty=True)
def _return_rate_dirty(log: TransactionLog) -> DataFrame:
    return cleaning.return_rates(log.tx)


@over_log("raw_snapshot", dirty=True)
def _snapshot(log: TransactionLog) -> DataFrame:
    return log.tx


# --- RFM ---------------------------------------------------------------------------------


@over_log("analysis_date")
def _analysis_date(log: TransactionLog) -> DataFrame:
    return rfm.analysis_date(log.lines)


@over_log("rfm")
def _rfm(log: TransactionLog) -> DataFrame:
    return rounded(log.rfm, 2, "monetary")


@over_log("rfm_dirty", dirty=True)
def _rfm_dirty(log: TransactionLog) -> DataFrame:
    return rounded(log.rfm, 2, "monetary")


@query("rfm_events")
def _rfm_events(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(TransactionLog(purchase_events(spark, folder)).rfm, 2, "monetary")


@over_log("rfm_log")
def _rfm_log(log: TransactionLog) -> DataFrame:
    return rounded(rfm.rfm_log(log.rfm).select("customer_id", *rfm.LOGS), 6, *rfm.LOGS)


@over_log("rfm_scaled")
def _rfm_scaled(log: TransactionLog) -> DataFrame:
    picked = log.staged_rfm_scaled.select("customer_id", *rfm.SCALED)
    return rounded(picked, 6, *rfm.SCALED)


# --- segmentation ------------------------------------------------------------------------


def _fits(scaled: DataFrame) -> dict[int, segments.FittedClusters]:
    return segments.fit_kmeans(scaled)


@over_log("kmeans_fit")
def _kmeans(log: TransactionLog) -> DataFrame:
    scaled = log.staged_rfm_scaled
    return segments.center_table(scaled, _fits(scaled))


@over_log("elbow_curve")
def _elbow(log: TransactionLog) -> DataFrame:
    scaled = log.staged_rfm_scaled
    return segments.elbow_curve(scaled, _fits(scaled))


@over_log("elbow_single_cluster")
def _elbow_one(log: TransactionLog) -> DataFrame:
    return rounded(segments.single_cluster_wcss(log.staged_rfm_scaled), 4, "wcss")


@over_log("kmeans_step")
def _kmeans_step(log: TransactionLog) -> DataFrame:
    """One iteration from published centers of several k, in one scan."""
    moved = segments.cluster_costs(log.staged_rfm_scaled, SCORED_CENTERS)
    return rounded(rounded(moved, 3, "wcss"), 5, *[f"next_{m}" for m in rfm.MEASURES])


def _pinned_scores(log: TransactionLog) -> DataFrame:
    labelled = segments.label_all(log.staged_rfm_scaled, SCORED_CENTERS)
    return segments.silhouette(labelled, {k: f"cluster_{k}" for k in SCORED_CENTERS})


@over_log("silhouette")
def _silhouette(log: TransactionLog) -> DataFrame:
    return rounded(_pinned_scores(log), 6, "silhouette")


@over_log("silhouette_grid")
def _silhouette_grid(log: TransactionLog) -> DataFrame:
    """On coordinates rounded to a grid, as for very many customers."""
    labelled = segments.label_all(log.staged_rfm_scaled, SCORED_CENTERS)
    labels = {k: f"cluster_{k}" for k in SCORED_CENTERS}
    return rounded(segments.silhouette(labelled, labels, grid=SILHOUETTE_GRID), 6, "silhouette")


@over_log("silhouette_tree")
def _silhouette_tree(log: TransactionLog) -> DataFrame:
    """With far groups of customers taken as a whole, and whether the bound on the error is small."""
    labelled = segments.label_all(log.staged_rfm_scaled, SCORED_CENTERS)
    scores = segments.silhouette_with_error(labelled, {k: f"cluster_{k}" for k in SCORED_CENTERS})
    return rounded(scores, 4, "silhouette").select("k", "silhouette", (F.col("error") <= 0.005).alias("near"))


@over_log("select_k")
def _select_k(log: TransactionLog) -> DataFrame:
    return segments.select_k(_pinned_scores(log))


@over_log("fitted_segments")
def _fitted_segments(log: TransactionLog) -> DataFrame:
    """Fit, score, choose k and label the customers, nothing pinned."""
    scaled = log.staged_rfm_scaled
    labelled, _ = segments.segment_customers(scaled, _fits(scaled))
    return labelled.select("customer_id", *rfm.MEASURES, "cluster")


def _clustered(log: TransactionLog) -> DataFrame:
    return segments.assign_clusters(log.staged_rfm_scaled, PINNED_CENTERS)


@over_log("assign_clusters")
def _assign(log: TransactionLog) -> DataFrame:
    return _clustered(log).select("customer_id", "cluster")


@over_log("cluster_profile")
def _profile(log: TransactionLog) -> DataFrame:
    return segments.cluster_profile(_clustered(log))


@over_log("rfm_cluster_preview")
def _preview(log: TransactionLog) -> DataFrame:
    head = rfm.preview(_clustered(log), 10).select("customer_id", *rfm.MEASURES, "cluster")
    return rounded(head, 2, "monetary")


# --- customer lifetime value -------------------------------------------------------------


@over_log("rfmt_summary")
def _rfmt(log: TransactionLog) -> DataFrame:
    return on_grid(log.rfmt, "monetary_value")


@query("rfmt_events")
def _rfmt_events(spark: SparkSession, folder: str) -> DataFrame:
    return on_grid(TransactionLog(purchase_events(spark, folder)).rfmt, "monetary_value")


def _purchase_fit(log: TransactionLog) -> DataFrame:
    model = clv.fit_purchases(stage(log.rfmt, "rfmt"))
    row = (model.r, model.alpha, model.a, model.b, model.degenerate, model.converged, model.loss, model.gradient)
    return log.raw.sparkSession.createDataFrame(
        [row],
        "r double, alpha double, a double, b double, degenerate boolean, converged boolean,"
        " loss double, gradient double",
    )


@over_log("bgnbd_fit")
def _bgnbd_fit(log: TransactionLog) -> DataFrame:
    return _purchase_fit(log)


@query("bgnbd_fit_events")
def _bgnbd_fit_events(spark: SparkSession, folder: str) -> DataFrame:
    return _purchase_fit(TransactionLog(purchase_events(spark, folder)))


@over_log("bgnbd_loglik")
def _bgnbd_loglik(log: TransactionLog) -> DataFrame:
    return rounded(clv.purchase_loglik(stage(log.rfmt, "rfmt"), PINNED_PURCHASES), 4, "loglik")


@over_log("bgnbd_slopes")
def _bgnbd_slopes(log: TransactionLog) -> DataFrame:
    """Derivatives that the fit steps by, at published parameters."""
    found = clv.purchase_slopes(stage(log.rfmt, "rfmt"), PINNED_PURCHASES)
    return rounded(rounded(found, 4, "slope"), 3, "curvature")


@over_log("bgnbd_predict")
def _bgnbd_predict(log: TransactionLog) -> DataFrame:
    predicted = clv.predict_purchases(log.rfmt, PINNED_PURCHASES)
    return rounded(predicted.select("customer_id", "expected_purchases_6m"), 6, "expected_purchases_6m")


@query("bgnbd_predict_events")
def _bgnbd_predict_events(spark: SparkSession, folder: str) -> DataFrame:
    log = TransactionLog(purchase_events(spark, folder))
    predicted = clv.predict_purchases(log.rfmt, PINNED_PURCHASES)
    return rounded(predicted.select("customer_id", "expected_purchases_6m"), 6, "expected_purchases_6m")


@over_log("top_expected_purchases")
def _top_purchases(log: TransactionLog) -> DataFrame:
    top = clv.top_by(clv.predict_purchases(log.rfmt, PINNED_PURCHASES), "expected_purchases_6m")
    return rounded(on_grid(top, "monetary_value"), 4, "expected_purchases_6m")


@over_log("repeat_customers")
def _repeat(log: TransactionLog) -> DataFrame:
    return on_grid(clv.repeat_customers(log.rfmt), "monetary_value")


def _spend_fit(log: TransactionLog) -> DataFrame:
    model = clv.fit_spend(clv.repeat_customers(stage(log.rfmt, "rfmt")))
    row = (model.p, model.q, model.v, model.degenerate, model.converged, model.loss, model.gradient)
    return log.raw.sparkSession.createDataFrame(
        [row],
        "p double, q double, v double, degenerate boolean, converged boolean, loss double, gradient double",
    )


@over_log("gamma_gamma_fit")
def _gg_fit(log: TransactionLog) -> DataFrame:
    return _spend_fit(log)


@query("gamma_gamma_fit_events")
def _gg_fit_events(spark: SparkSession, folder: str) -> DataFrame:
    return _spend_fit(TransactionLog(purchase_events(spark, folder)))


@query("fit_checks")
def _fit_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each fit is what it says: a row per model and log."""
    rows = []
    for name, lines in (("orders", order_lines(spark, folder)), ("events", purchase_events(spark, folder))):
        rfmt = stage(TransactionLog(lines).rfmt, "rfmt")
        bought, spent = clv.fit_purchases(rfmt), clv.fit_spend(clv.repeat_customers(rfmt))
        floored = min(bought.a, bought.b) <= clv.PARAMETER_FLOOR
        rows += [
            (name, "purchases", bought.converged, bought.lowest, bought.degenerate, bought.degenerate == floored),
            (name, "spend", spent.converged, spent.lowest, spent.degenerate, spent.degenerate == (spent.q <= 1)),
        ]
    return spark.createDataFrame(
        rows,
        "log string, model string, converged boolean, lowest boolean, degenerate boolean, flag_agrees boolean",
    )


@over_log("gg_loglik")
def _gg_loglik(log: TransactionLog) -> DataFrame:
    rfmt = stage(log.rfmt, "rfmt")
    return rounded(clv.spend_loglik(clv.repeat_customers(rfmt), PINNED_SPEND), 2, "loglik")


@over_log("gg_slopes")
def _gg_slopes(log: TransactionLog) -> DataFrame:
    rfmt = stage(log.rfmt, "rfmt")
    found = clv.spend_slopes(clv.repeat_customers(rfmt), PINNED_SPEND)
    return rounded(rounded(found, 4, "slope"), 3, "curvature")


@over_log("gg_expected_profit")
def _gg_profit(log: TransactionLog) -> DataFrame:
    valued = clv.expected_profit(clv.repeat_customers(log.rfmt), PINNED_SPEND)
    return rounded(valued.select("customer_id", "expected_avg_profit"), 2, "expected_avg_profit")


def _valued(log: TransactionLog) -> DataFrame:
    predicted = clv.predict_purchases(clv.repeat_customers(log.rfmt), PINNED_PURCHASES)
    priced = clv.expected_profit(predicted, PINNED_SPEND)
    return clv.discounted_value(priced, PINNED_PURCHASES)


@over_log("clv_discounted")
def _clv(log: TransactionLog) -> DataFrame:
    return rounded(_valued(log).select("customer_id", "clv_6m"), 2, "clv_6m")


@over_log("clv_discounted_modelled_spend")
def _clv_modelled(log: TransactionLog) -> DataFrame:
    """Purchases valued by the spend model's estimate instead of the observed mean."""
    priced = clv.expected_profit(clv.repeat_customers(log.rfmt), PINNED_SPEND)
    valued = clv.discounted_value(priced, PINNED_PURCHASES, value_col="expected_avg_profit")
    return rounded(valued.select("customer_id", "clv_6m"), 2, "clv_6m")


def _rfm_clv(log: TransactionLog) -> DataFrame:
    clustered = _clustered(log).select("customer_id", *rfm.MEASURES, "cluster")
    return clv.rfm_with_clv(clustered, _valued(log))


@over_log("rfm_with_clv")
def _rfm_with_clv(log: TransactionLog) -> DataFrame:
    joined = rounded(_rfm_clv(log), 2, "monetary", "clv_6m", "expected_avg_profit")
    return rounded(joined, 4, "expected_purchases_6m")


@over_log("top_clv")
def _top_clv(log: TransactionLog) -> DataFrame:
    top = clv.top_by(_rfm_clv(log), "clv_6m").select(
        "customer_id", *rfm.MEASURES, "cluster", "clv_6m"
    )
    return rounded(top, 2, "monetary", "clv_6m")


@over_log("clv_by_cluster")
def _clv_by_cluster(log: TransactionLog) -> DataFrame:
    return clv.clv_by_cluster(_rfm_clv(log))


@over_log("fitted_clv")
def _fitted_clv(log: TransactionLog) -> DataFrame:
    """Lifetime value with both models fitted on the log itself."""
    return value_customers(log).customers


# --- cohort retention --------------------------------------------------------------------


@over_log("invoice_month")
def _invoice_month(log: TransactionLog) -> DataFrame:
    return cohorts.invoice_month(log.lines).select("invoice", "stock_code", "invoice_month")


@over_log("cohort_month")
def _cohort_month(log: TransactionLog) -> DataFrame:
    return cohorts.cohort_month(log.lines).select("customer_id", "invoice", "invoice_month", "cohort_month")


@over_log("cohort_index")
def _cohort_index(log: TransactionLog) -> DataFrame:
    dated = cohorts.cohort_index(cohorts.cohort_month(log.lines))
    return dated.select("customer_id", "invoice", "cohort_index")


@over_log("cohort_counts")
def _cohort_counts(log: TransactionLog) -> DataFrame:
    return cohorts.cohort_counts(log.lines)


@over_log("cohort_pivot")
def _cohort_pivot(log: TransactionLog) -> DataFrame:
    return cohorts.cohort_pivot(log.staged_cohort_counts, indices=range(PIVOT_MONTHS))


def _retention(log: TransactionLog) -> DataFrame:
    return cohorts.retention_pct(log.staged_cohort_counts)


@over_log("retention_pct")
def _retention_pct(log: TransactionLog) -> DataFrame:
    return rounded(cohorts.retention_pct(cohorts.cohort_counts(log.lines)), 6, "retention_pct")


@over_log("mature_cohorts")
def _mature(log: TransactionLog) -> DataFrame:
    return rounded(cohorts.mature_cohorts(_retention(log)), 6, "retention_pct")


def _averages(log: TransactionLog) -> DataFrame:
    retention = _retention(log)
    return cohorts.early_vs_late_retention(retention, cohorts.mature_cohorts(retention))


@over_log("early_vs_late_retention")
def _early_late(log: TransactionLog) -> DataFrame:
    return rounded(_averages(log), 6, "early_avg", "late_avg")


@over_log("retention_verdict")
def _verdict(log: TransactionLog) -> DataFrame:
    return cohorts.retention_verdict(_averages(log))


@over_log("retention_heatmap_data")
def _heatmap(log: TransactionLog) -> DataFrame:
    return rounded(cohorts.retention_heatmap_data(_retention(log)), 6, "retention_pct")


@over_log("retention_preview")
def _retention_preview(log: TransactionLog) -> DataFrame:
    return cohorts.retention_preview(_retention(log))


# --- churn -------------------------------------------------------------------------------


@over_log("reference_date")
def _reference(log: TransactionLog) -> DataFrame:
    return churn.reference_date(log.lines)  # a single pass


@over_log("window_split")
def _windows(log: TransactionLog) -> DataFrame:
    parted = churn.window_parts(log.sales, log.reference)
    return rounded(parted.select("part", "invoice", "stock_code", "customer_id", "amount"), 4, "amount")


@over_log("eligible_customers")
def _eligible(log: TransactionLog) -> DataFrame:
    return churn.eligible_customers(churn.window_split(log.staged_lines, log.reference)[0])


@over_log("active_after")
def _active(log: TransactionLog) -> DataFrame:
    observation, performance = churn.window_split(log.staged_lines, log.reference)
    return churn.active_after(performance, churn.eligible_customers(observation))


@over_log("churn_labels")
def _labels(log: TransactionLog) -> DataFrame:
    return churn.churn_labels(log.staged_lines, log.reference)


@over_log("churn_distribution")
def _distribution(log: TransactionLog) -> DataFrame:
    return churn.churn_distribution(churn.churn_labels(log.staged_lines, log.reference))


def _feature(name: str, places: int | None = None) -> Callable[[TransactionLog], DataFrame]:
    def build(log: TransactionLog) -> DataFrame:
        picked = churn.observation_features(log.sales, log.reference).select("customer_id", name)
        return picked if places is None else rounded(picked, places, name)

    return build


over_log("feat_recency")(_feature("recency"))
over_log("feat_frequency")(_feature("frequency"))
over_log("feat_monetary")(_feature("monetary", 2))
over_log("feat_timespan")(_feature("timespan"))
over_log("feat_avg_order_gap")(_feature("avg_order_gap"))
@over_log("feat_unique_products")
def _feat_products(log: TransactionLog) -> DataFrame:
    return churn.unique_products(log.staged_lines, log.reference)


@over_log("feat_return_rate")
def _feat_return_rate(log: TransactionLog) -> DataFrame:
    return churn.observed_return_rate(log.staged_tx, log.reference)


@over_log("churn_features")
def _churn_features(log: TransactionLog) -> DataFrame:
    return rounded(log.churn_features, 2, "monetary")


@over_log("churn_features_dirty", dirty=True)
def _churn_features_dirty(log: TransactionLog) -> DataFrame:
    return rounded(log.churn_features, 2, "monetary")


@over_log("stratified_split")
def _split(log: TransactionLog) -> DataFrame:
    return log.staged_split.select("customer_id", "is_churn", "is_test")


def _trained(log: TransactionLog):
    split = log.staged_split
    return split, churn.fit_forest(split.where(~F.col("is_test")))


@over_log("rf_fit")
def _rf_fit(log: TransactionLog) -> DataFrame:
    """The forest that the fit grew, a row per node."""
    return _trained(log)[1].nodes


@over_log("rf_predict")
def _rf_predict(log: TransactionLog) -> DataFrame:
    split, model = _trained(log)
    scored = churn.predict(model, split.where("is_test"))
    return scored.select("customer_id", "is_churn", "prediction")


@over_log("rf_scored_rows")
def _rf_rows(log: TransactionLog) -> DataFrame:
    """Customers that the forest scores, with their labels: what SQL can tell of ``rf_predict``."""
    split, model = _trained(log)
    return churn.predict(model, split.where("is_test")).select("customer_id", "is_churn")


def _pinned_scored(log: TransactionLog) -> DataFrame:
    tested = log.staged_split.where("is_test")
    scored = tested.withColumn("churn_probability", pinned_probability())
    return scored.withColumn("prediction", (F.col("churn_probability") >= 0.5).cast("int"))


@over_log("classification_report")
def _report(log: TransactionLog) -> DataFrame:
    report = churn.classification_report(_pinned_scored(log))
    return rounded(report, 6, "precision", "recall", "f1")


@over_log("rf_classification_report")
def _rf_report(log: TransactionLog) -> DataFrame:
    split, model = _trained(log)
    return churn.classification_report(churn.predict(model, split.where("is_test")))


@over_log("feature_importance")
def _importance(log: TransactionLog) -> DataFrame:
    return churn.feature_importance(_trained(log)[1])


@over_log("churn_probability")
def _probability(log: TransactionLog) -> DataFrame:
    split, model = _trained(log)
    scored = churn.predict(model, split.where("is_test"))
    return scored.select("customer_id", "churn_probability")


@over_log("churn_probability_all")
def _probability_all(log: TransactionLog) -> DataFrame:
    """Probabilities for every customer in scope, not only the test quarter."""
    split, model = _trained(log)
    return churn.predict(model, split).select("customer_id", "is_test", "churn_probability")


def _ruled(log: TransactionLog):
    """The side of churn scores with the forest made by rule in place of a fitted one."""
    return place_churn(ruled_forest(log.raw.sparkSession), log.staged_split)


@over_log("rf_predict_pinned")
def _rf_predict_pinned(log: TransactionLog) -> DataFrame:
    scored = churn.predict(ruled_forest(log.raw.sparkSession), log.staged_split.where("is_test"))
    return scored.select("customer_id", "is_churn", "prediction")


@over_log("churn_probability_pinned")
def _probability_pinned(log: TransactionLog) -> DataFrame:
    scored = churn.predict(ruled_forest(log.raw.sparkSession), log.staged_split)
    return rounded(scored.select("customer_id", "is_test", "churn_probability"), 6, "churn_probability")


@over_log("rf_classification_report_pinned")
def _rf_report_pinned(log: TransactionLog) -> DataFrame:
    return rounded(_ruled(log).report, 6, "precision", "recall", "f1")


@query("feature_importance_pinned")
def _importance_pinned(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(churn.feature_importance(ruled_forest(spark)), 6, "importance")


@over_log("action_summary_pinned")
def _actions_pinned(log: TransactionLog) -> DataFrame:
    return actions.segment_summary(_ruled(log).segmented)


# --- action matrix -----------------------------------------------------------------------


def _matrix(log: TransactionLog) -> DataFrame:
    return actions.action_matrix(_pinned_scored(log))


def _segmented(log: TransactionLog) -> tuple[DataFrame, actions.Medians]:
    matrix = _matrix(log)
    medians = actions.action_medians(matrix)
    return actions.assign_segment(matrix, medians), medians


@over_log("action_matrix")
def _action_matrix(log: TransactionLog) -> DataFrame:
    return rounded(rounded(_matrix(log), 6, "churn_probability"), 2, "monetary")


@over_log("action_medians")
def _medians(log: TransactionLog) -> DataFrame:
    found = actions.action_medians(_matrix(log))
    table = log.raw.sparkSession.createDataFrame(
        [(found.probability, found.monetary)], "median_p double, median_m double"
    )
    return rounded(rounded(table, 6, "median_p"), 2, "median_m")


@over_log("assign_segment")
def _assign_segment(log: TransactionLog) -> DataFrame:
    return _segmented(log)[0].select("customer_id", "segment")


@over_log("segment_summary")
def _summary(log: TransactionLog) -> DataFrame:
    return actions.segment_summary(_segmented(log)[0])


@over_log("revenue_at_risk")
def _at_risk(log: TransactionLog) -> DataFrame:
    return rounded(actions.revenue_at_risk(_segmented(log)[0]), 2, "revenue_at_risk")


@over_log("quadrant_chart_data")
def _quadrant(log: TransactionLog) -> DataFrame:
    chart = actions.quadrant_chart_data(*_segmented(log))
    exact = rounded(chart, 6, "churn_probability", "log_monetary", "median_probability")
    return rounded(exact, 2, "monetary", "median_monetary")


@over_log("fitted_action_summary")
def _fitted_actions(log: TransactionLog) -> DataFrame:
    """Segment summary of the forest's own probabilities."""
    return actions.segment_summary(score_churn(log).segmented)
