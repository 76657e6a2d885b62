"""One transaction log and the tables derived from it."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import churn, cleaning, clv, cohorts, rfm
from ledgerloom.session import stage
from ledgerloom.sources.transactions import TX_COLUMNS


LOG_COLUMNS = (*TX_COLUMNS, "is_return")


class TransactionLog:
    """Derived tables of one log; each is a lazy DataFrame over the log's files.

    Properties named ``staged_...`` write a table to the shared folder, for callers that
    read the same result several times. What takes one pass reads the log itself. Caps and the
    last moment take passes of their own, so whatever needs them reads ``staged_tx``, the lines
    of known customers: however many passes follow, the log is read and joined once.

    For many tables, ``reuse=True`` also reduces the lines to invoices, once, and derives the
    others from those; only the product counts read the lines again.

    A ``profile`` that is known already, such as one from sketches, takes the place of the exact one.
    """

    def __init__(self, raw: DataFrame, reuse: bool = False, profile: cleaning.SalesProfile | None = None):
        self.raw = raw
        self.reuse = reuse
        if profile is not None:
            self.__dict__["profile"] = profile
        self.tx = cleaning.drop_missing_customer(raw)
        self.lines = cleaning.sale_lines(raw)

    @cached_property
    def staged_tx(self) -> DataFrame:
        return stage(self.tx.select(*LOG_COLUMNS), "tx")

    @property
    def staged_lines(self) -> DataFrame:
        return cleaning.sale_lines(self.staged_tx)

    @cached_property
    def profile(self) -> cleaning.SalesProfile:
        return cleaning.profile_sales(self.staged_lines)

    @cached_property
    def last_ts(self) -> datetime | None:
        """Moment of the last sale; on its own it needs no cap thresholds."""
        if self.reuse or "profile" in self.__dict__:
            return self.profile.last_ts
        return self.staged_lines.agg(F.max("invoice_ts")).first()[0]

    @property
    def reference(self) -> Column:
        return cleaning.reference_ts(self.last_ts)

    @cached_property
    def sales(self) -> DataFrame:
        return cleaning.build_sales(self.staged_lines, self.profile)

    @cached_property
    def staged_visits(self) -> DataFrame:
        return stage(cleaning.visits(self.staged_tx, self.profile.caps), "visits")

    @property
    def _purchases(self) -> DataFrame:
        return self.staged_visits.where("sale_lines > 0") if self.reuse else self.sales

    @cached_property
    def rfm(self) -> DataFrame:
        return rfm.rfm(self._purchases, cleaning.analysis_ts(self.profile.last_ts))

    @cached_property
    def staged_rfm_scaled(self) -> DataFrame:
        """Scaled from a staged RFM table, so its moments do not read the log again."""
        return rfm.rfm_scaled(rfm.rfm_log(stage(self.rfm, "rfm")))

    @cached_property
    def rfmt(self) -> DataFrame:
        return clv.rfmt_summary(self._purchases, self.profile.last_ts)

    @cached_property
    def staged_cohort_counts(self) -> DataFrame:
        # Amounts do not matter here, so without reuse the caps are not needed.
        bought = self._purchases if self.reuse else self.lines
        return stage(cohorts.cohort_counts(bought), "cohort-counts")

    @cached_property
    def churn_features(self) -> DataFrame:
        """From visits, returns included; two distinct counts in one aggregate would triple the rows."""
        bought = self.staged_visits.where("sale_lines > 0")
        products = churn.unique_products(self.staged_lines, self.reference)
        return churn.churn_features(bought, self.staged_visits, self.reference, products)

    @cached_property
    def staged_split(self) -> DataFrame:
        features = stage(self.churn_features, "churn-features")
        return stage(churn.stratified_split(features), "churn-split")
