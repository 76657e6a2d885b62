from ledgerloom.operators.cleaning import flag_returns
from ledgerloom.session import shared_folder, stage
from ledgerloom.sources import (
    TX_SCHEMA,
    load_transactions,
    order_lines,
    split_extracts,
    union_extracts,
    write_outputs,
)

ROWS = [
    ("1", "a", 2, "2010-01-05 10:00", 3.5, 17850),
    ("C2", "a", -2, "2010-01-06 11:30", 3.5, None),
    ("1", "a", 2, "2010-01-05 10:00", 3.5, 17850),
]


def test_parquet_extracts_are_stacked_with_duplicates(spark, tx, tmp_path):
    log = tx(ROWS).drop("is_return")
    log.write.parquet(str(tmp_path / "one"))
    log.write.parquet(str(tmp_path / "two"))
    loaded = load_transactions(spark, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert loaded.count() == 6
    assert [f.dataType for f in loaded.schema] == [f.dataType for f in TX_SCHEMA]


def test_csv_with_its_own_column_names(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
        "489434,85048,LIGHTS,12,2009-12-01 07:45:00,6.95,13085.0,UK\n"
        "C489449,22087,BUNTING,-12,2009-12-01 10:33:00,2.95,,Australia\n"
    )
    columns = {
        "Invoice": "invoice",
        "StockCode": "stock_code",
        "Description": "-",
        "Quantity": "quantity",
        "InvoiceDate": "invoice_ts",
        "Price": "price",
        "Customer ID": "customer_id",
        "Country": "-",
    }
    loaded = load_transactions(spark, [str(path)], "csv", columns, {"header": "true"})
    rows = flag_returns(loaded).orderBy("invoice").collect()
    assert [r["customer_id"] for r in rows] == [13085, None]
    assert [r["is_return"] for r in rows] == [False, True]
    assert str(rows[0]["invoice_ts"]) == "2009-12-01 07:45:00"


def test_missing_source_column_is_refused(spark):
    try:
        load_transactions(spark, ["x"], "csv", {"Invoice": "invoice"})
    except ValueError as error:
        assert "customer_id" in str(error)
    else:
        raise AssertionError("expected a ValueError")


def test_split_and_union_give_the_log_back(spark, folder):
    log = order_lines(spark, folder)
    again = union_extracts(*split_extracts(log, "1998-01-01 00:00:00"))
    assert log.exceptAll(again).isEmpty() and again.exceptAll(log).isEmpty()


def test_union_fills_columns_an_extract_lacks(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([("y",)], "s string")
    assert sorted(union_extracts(a, b).collect(), key=lambda r: r["s"])[1]["k"] is None


def test_outputs_are_written_and_partitioned(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    paths = write_outputs({"a": df, "b": df}, str(tmp_path), {"b": "k"})
    assert spark.read.parquet(paths["a"]).count() == 2
    assert (tmp_path / "b" / "k=1").is_dir()


def test_stage_writes_to_the_shared_folder(spark):
    staged = stage(spark.range(10).toDF("id"), "ids")
    assert staged.count() == 10
    assert staged.inputFiles()[0].replace("file://", "").startswith(shared_folder(spark))


def test_outputs_in_another_format(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    paths = write_outputs({"a": df}, str(tmp_path), fmt="orc")
    assert spark.read.orc(paths["a"]).first()["v"] == 2.0
