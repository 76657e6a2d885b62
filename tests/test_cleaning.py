import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exact_quantiles, ntz
from ledgerloom.functions.sketches import RANK_ERROR
from ledgerloom.operators import cleaning
from ledgerloom.plans.log import TransactionLog
from ledgerloom.sources import load_transactions, order_lines


def test_returns_are_prefixed_case_sensitively(tx):
    rows = tx(
        [
            ("C1", "a", 1, "2010-01-01 00:00", 1, 1),
            ("c2", "a", 1, "2010-01-01 00:00", 1, 1),
            ("3C", "a", 1, "2010-01-01 00:00", 1, 1),
            (None, "a", 1, "2010-01-01 00:00", 1, 1),
        ]
    )
    assert [r["is_return"] for r in rows.collect()] == [True, False, False, False]
    assert cleaning.drop_returns(rows).count() == 3


def test_only_positive_lines_of_known_customers_stay(tx):
    rows = tx(
        [
            ("1", "a", 1, "2010-01-01 00:00", 1, 1),
            ("2", "a", 0, "2010-01-01 00:00", 1, 1),
            ("3", "a", 1, "2010-01-01 00:00", 0, 1),
            ("4", "a", -1, "2010-01-01 00:00", 1, 1),
            ("5", "a", 1, "2010-01-01 00:00", 1, None),
            ("C6", "a", 1, "2010-01-01 00:00", 1, 1),
        ]
    )
    assert [r["invoice"] for r in cleaning.sale_lines(rows).collect()] == ["1"]


def test_quantile_is_interpolated(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9)], "v double")
    found, _ = exact_quantiles(df, {"v": [0.01, 0.5]})
    assert found["v"] == pytest.approx([1.03, 3.0])


@pytest.mark.parametrize("kind", ["spread", "tied", "skewed", "constant", "negative"])
def test_quantiles_of_large_columns_are_exact(spark, kind):
    rng = random.Random(7)
    make = {
        "spread": lambda: rng.uniform(0, 1e6),
        "tied": lambda: rng.choice([1.0, 1.0, 2.0, rng.random()]),
        "skewed": lambda: rng.lognormvariate(0, 4),
        "constant": lambda: 5.0,
        "negative": lambda: rng.gauss(0, 1),
    }[kind]
    values = [make() for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v double").repartition(4)
    shares = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    found, extras = exact_quantiles(df, {"v": shares}, {"n": F.count(F.lit(1))}, gather_rows=50)
    assert found["v"] == pytest.approx(list(np.quantile(values, shares)), rel=1e-12, abs=1e-12)
    assert extras["n"] == 20_005


def test_quantiles_of_nothing_are_null(spark):
    found, _ = exact_quantiles(spark.createDataFrame([], "v double"), {"v": [0.5]})
    assert found["v"] == [None]


def test_winsorizing_keeps_rows_and_is_idempotent(spark, folder):
    log = TransactionLog(order_lines(spark, folder))
    once = cleaning.winsorize(log.lines, log.profile.caps)
    twice = cleaning.winsorize(once, log.profile.caps)
    assert once.count() == log.lines.count()
    assert once.exceptAll(twice).isEmpty()
    lo, hi = log.profile.caps["price"]
    bounds = once.agg(F.min("price"), F.max("price")).first()
    assert bounds[0] == lo and bounds[1] == hi


def test_caps_may_be_limited_to_early_lines(tx):
    rows = tx(
        [(str(i), "a", 1, "2010-01-01 00:00", 10, 1) for i in range(50)]
        + [("late", "a", 1, "2011-01-01 00:00", 10_000, 1)]
    )
    limit = ntz(datetime(2010, 6, 1))
    assert cleaning.profile_sales(rows).caps["price"][1] > 10
    assert cleaning.profile_sales(rows, caps_until=limit).caps["price"][1] == 10


def test_return_rates(tx):
    rows = tx(
        [
            ("1", "a", 1, "2010-01-01 00:00", 1, 1),
            ("1", "b", 1, "2010-01-01 00:00", 1, 1),
            ("C1", "a", -1, "2010-01-02 00:00", 1, 1),
            ("C2", "a", -1, "2010-01-02 00:00", 1, 2),
            ("3", "a", 1, "2010-01-02 00:00", 1, 3),
        ]
    )
    got = {r["customer_id"]: (r["return_count"], r["total_invoices"], r["return_rate"]) for r in cleaning.return_rates(rows).collect()}
    assert got == {1: (1, 2, 0.5), 2: (1, 1, 1.0), 3: (0, 1, 0.0)}


def test_reference_moment_clips_the_day_and_keeps_the_time(spark):
    moment = cleaning.reference_ts(datetime(2011, 8, 31, 12, 50))
    got = spark.range(1).select(moment.alias("m")).first()["m"]
    assert got == datetime(2011, 2, 28, 12, 50)


def test_filters_and_columns_reach_the_scan(spark, folder):
    query = TransactionLog(order_lines(spark, folder)).lines.select("quantity")
    scans = query._jdf.queryExecution().sparkPlan().collectLeaves()
    text = " ".join(
        scans.apply(i).metadata().apply(part)
        for i in range(scans.size())
        for part in ("PushedFilters", "ReadSchema")
    )
    assert "Not(EqualTo(l_returnflag,R))" in text
    assert "GreaterThan(l_quantity,0.0)" in text
    assert "IsNotNull(o_custkey)" in text
    assert "l_shipdate" not in text and "o_totalprice" not in text


def test_filters_of_a_plain_log_reach_the_scan(spark, tx, tmp_path):
    rows = tx([("1", "a", 1, "2010-01-01 00:00", 1, 1), ("C2", "a", 1, "2010-01-01 00:00", 1, 1)])
    rows.drop("is_return").write.parquet(str(tmp_path / "log"))
    log = cleaning.sale_lines(cleaning.flag_returns(load_transactions(spark, [str(tmp_path / "log")])))
    assert [r["invoice"] for r in log.collect()] == ["1"]
    scans = log._jdf.queryExecution().sparkPlan().collectLeaves()
    pushed = scans.apply(0).metadata().apply("PushedFilters")
    assert "Not(StringStartsWith(invoice,C))" in pushed and "IsNotNull(customer_id)" in pushed


def test_nan_counts_as_missing(spark, tmp_path):
    nan = float("nan")
    rows = [
        ("1", "a", 1.0, "2010-01-01 00:00:00", 2.0, 7.0), ("2", "a", nan, "2010-01-01 00:00:00", 2.0, 7.0),
        ("3", "a", 1.0, "2010-01-01 00:00:00", nan, 7.0), ("4", "a", 1.0, "2010-01-01 00:00:00", 2.0, nan),
    ]
    made = spark.createDataFrame(rows, ["invoice", "stock_code", "quantity", "invoice_ts", "price", "customer_id"])
    made.write.parquet(str(tmp_path / "log"))
    loaded = load_transactions(spark, [str(tmp_path / "log")])
    by = {r["invoice"]: r for r in loaded.collect()}
    assert by["2"]["quantity"] is None and by["3"]["price"] is None and by["4"]["customer_id"] is None
    log = TransactionLog(cleaning.flag_returns(loaded))
    assert [r["amount"] for r in log.sales.collect()] == [2.0] and log.profile.caps["price"] == (2.0, 2.0)
    raw = made.withColumn("customer_id", F.lit(1).cast("long"))
    assert cleaning.positive_lines(raw).count() == 2


def test_the_log_is_read_once(spark, folder):
    log = TransactionLog(order_lines(spark, folder))
    for made in (log.sales, log.rfm, log.churn_features):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "Expand" not in plan
    one = log.tx._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("l_orderkey") and one.count("Relation") == 2


def test_results_do_not_depend_on_partitioning(spark, folder):
    log = order_lines(spark, folder)
    one = TransactionLog(log.coalesce(1)).rfm.withColumn("monetary", F.round("monetary", 4))
    many = TransactionLog(log.repartition(7)).rfm.withColumn("monetary", F.round("monetary", 4))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_sketches_of_extracts_make_a_profile(spark, folder):
    lines = cleaning.sale_lines(order_lines(spark, folder, dirty=True)).cache()
    exact = cleaning.profile_sales(lines)
    parts = [lines.where(F.col("stock_code").cast("long") % 3 == i) for i in range(3)] + [lines.where("false")]
    kept = parts[0].sparkSession.createDataFrame([], cleaning.sketch_sales(lines).schema)
    for part in parts:
        kept = kept.unionByName(cleaning.sketch_sales(part))
    found = cleaning.profile_from_sketches(kept)
    assert (found.rows, found.last_ts) == (exact.rows, exact.last_ts)
    for c in cleaning.CAPPED:
        values = np.sort([r[0] for r in lines.select(c).collect()])
        for value, share in zip(found.caps[c], (0.01, 0.99), strict=True):
            low, high = (np.searchsorted(values, value, side) / len(values) for side in ("left", "right"))
            assert low - RANK_ERROR <= share <= high + RANK_ERROR
    log = TransactionLog(order_lines(spark, folder, dirty=True), profile=found)
    assert log.sales.agg(F.max("price")).first()[0] == found.caps["price"][1]


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([], "invoice_ts timestamp_ntz, quantity double, price double")
    found = cleaning.profile_from_sketches(cleaning.sketch_sales(none))
    assert found == cleaning.SalesProfile(0, None, {"quantity": (None, None), "price": (None, None)})
