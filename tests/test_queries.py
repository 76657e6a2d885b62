"""The registered queries against their SQL, and the whole report."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_oracle import TABLES, difference  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from ledgerloom.plans.log import TransactionLog  # noqa: E402
from ledgerloom.plans.oracle import ORACLE_SQL  # noqa: E402
from ledgerloom.plans.report import full_report  # noqa: E402
from ledgerloom.sources import order_lines, write_outputs  # noqa: E402

CHECKED = sorted(ORACLE_SQL)


@pytest.fixture(scope="module")
def engine(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, folder, engine, name):
    ours = contract.queries()[name](spark, folder).toPandas()
    assert difference(ours, engine.execute(ORACLE_SQL[name]).df()) is None


def test_entry(spark):
    assert contract.entry(spark).count() >= 1


def test_full_report_is_written(spark, folder, tmp_path):
    log = TransactionLog(order_lines(spark, folder), reuse=True)
    tables = full_report(log, None, ks=(2, 3), restarts=1)
    paths = write_outputs(tables, str(tmp_path), {"retention": "cohort_month"})
    rows = {name: spark.read.parquet(path).count() for name, path in paths.items()}
    assert rows["elbow"] == 3 and rows["silhouette"] == 2
    assert rows["rfm"] == rows["rfm_clv"] == rows["rfm_scaled"] == rows["expected_purchases"]
    assert rows["top_clv"] == rows["top_expected_purchases"] == 10
    assert "clv_6m" in tables["rfm_clv"].columns
    assert rows["retention_verdict"] == 1 and rows["feature_importance"] == 6


def rounded(df):
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, 4) for c in doubles})


def test_reduced_log_gives_the_same_tables(spark, folder):
    raw = order_lines(spark, folder, dirty=True)
    plain, reduced = TransactionLog(raw), TransactionLog(raw, reuse=True)
    for name in ("rfm", "rfmt", "staged_cohort_counts", "churn_features"):
        one, two = rounded(getattr(plain, name)), rounded(getattr(reduced, name))
        assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty(), name
