"""Exports with records that cannot be read, and results that appear all at once."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cleaning
from ledgerloom.sources import TX_SCHEMA, load_tolerant, publish_outputs, publishing, read_published

COLUMNS = {
    "Invoice": "invoice",
    "Code": "stock_code",
    "Description": "-",
    "Quantity": "quantity",
    "Date": "invoice_ts",
    "Price": "price",
    "Customer ID": "customer_id",
}
LINES = """Invoice,Code,Description,Quantity,Date,Price,Customer ID
1,a,x,2,2010-01-05 10:00:00,3.5,17850.0
C2,b,"two, words",-2,05/01/2010 11:30,3.5,
3,c,,NaN,2010-01-05,nan,17850
4,d,x,two,2010-01-05 10:00:00,3.5,17850
5,e,x,1,31/02/2010 10:00,3.5,17850
6,f,x,1,yesterday,free,17850.5
7,g,x
8,h,x,1,2010-01-05 10:00:00,3.5,17850,surplus
9,i,x,1,2010-01-05 10:00:00,1e3,abc
,,,,,,
"""


@pytest.fixture
def loaded(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(LINES)
    return load_tolerant(spark, [str(path)], "csv", COLUMNS, {"header": "true"}, ["dd/MM/yyyy HH:mm"])


def test_readable_records_make_the_log(loaded):
    assert [(f.name, f.dataType) for f in loaded.tx.schema] == [(f.name, f.dataType) for f in TX_SCHEMA]
    rows = {r["invoice"]: r for r in loaded.tx.collect()}
    assert set(rows) == {"1", "C2", "3", None}
    assert (rows["1"]["quantity"], rows["1"]["customer_id"]) == (2.0, 17850)
    assert str(rows["C2"]["invoice_ts"]) == "2010-01-05 11:30:00" and rows["C2"]["customer_id"] is None
    assert rows["3"]["quantity"] is None and rows["3"]["price"] is None and str(rows["3"]["invoice_ts"]) == "2010-01-05 00:00:00"


def test_other_records_are_set_aside_with_reasons(loaded):
    told = {r["fields"]["Invoice"]: (r["reasons"], r["record"]) for r in loaded.quarantine.collect()}
    assert {k: v[0] for k, v in told.items()} == {
        "4": ["quantity"],
        "5": ["invoice_ts"],
        "6": ["invoice_ts", "price", "customer_id"],
        "7": ["shape"],
        "8": ["shape"],
        "9": ["customer_id"],
    }
    assert told["7"][1] == "7,g,x" and told["4"][1] is None
    counts = {r["reason"]: r["rows"] for r in loaded.counts().collect()}
    assert counts == {"quantity": 1, "invoice_ts": 2, "price": 1, "customer_id": 2, "shape": 2, "any": 6}


def test_quarantine_is_in_the_accounting(loaded):
    log = cleaning.flag_returns(loaded.tx)
    lines = cleaning.sale_lines(log)
    told = {r["stage"]: r["rows"] for r in cleaning.row_accounting(log, lines, F.lit("2011-01-01").cast("timestamp_ntz"), loaded.quarantine).collect()}
    assert told["raw"] == 4 and told["quarantined"] == 6 and told["sales"] == 1


def test_json_records_and_refusals(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text('{"i": "1", "s": "a", "q": 2, "t": "2010-01-05", "p": 1.5, "c": 7}\n{"i": "2", "q": [1]}\nnot json\n{"i": "3", "p": "x"}\n')
    columns = {"i": "invoice", "s": "stock_code", "q": "quantity", "t": "invoice_ts", "p": "price", "c": "customer_id"}
    loaded = load_tolerant(spark, [str(path), str(path)], "json", columns)
    assert [r["invoice"] for r in loaded.tx.collect()] == ["1", "1"]
    assert {r["reason"]: r["rows"] for r in loaded.counts().collect()} == {"quantity": 2, "shape": 2, "price": 2, "any": 6}
    with pytest.raises(ValueError):
        load_tolerant(spark, [str(path)], "parquet", columns)
    with pytest.raises(ValueError):
        load_tolerant(spark, [str(path)], "csv", {"i": "invoice"})


def numbers(spark, n, label="a"):
    return spark.range(n).select("id", F.lit(label).alias("label"), (F.col("id") % 3).alias("part"))


def test_published_tables_are_replaced_together(spark, tmp_path):
    folder = str(tmp_path)
    publish_outputs(spark, {"one": numbers(spark, 5), "two": numbers(spark, 7)}, folder)
    publish_outputs(spark, {"one": numbers(spark, 3, "b")}, folder)
    assert read_published(spark, folder, "one").select("label").distinct().collect() == [("b",)]
    assert read_published(spark, folder, "two").count() == 7
    gone = publishing.prune_published(spark, folder)
    assert len(gone) == 1 and read_published(spark, folder, "two").count() == 7
    publish_outputs(spark, {"one": numbers(spark, 0)}, folder)
    assert read_published(spark, folder, "one").count() == 0
    with pytest.raises(KeyError):
        read_published(spark, folder, "three")


def test_a_failure_in_the_middle_leaves_the_former_results(spark, tmp_path):
    folder = str(tmp_path)
    publish_outputs(spark, {"one": numbers(spark, 5), "two": numbers(spark, 5)}, folder)
    broken = numbers(spark, 9).withColumn("id", F.expr("IF(id = 8, CAST(raise_error('no') AS BIGINT), id)"))
    with pytest.raises(Exception, match="no"):
        publish_outputs(spark, {"one": numbers(spark, 9), "two": broken}, folder)
    assert [read_published(spark, folder, t).count() for t in ("one", "two")] == [5, 5]
    assert publishing.manifest(spark, folder)["version"] == 1
    publish_outputs(spark, {"one": numbers(spark, 6)}, folder)
    assert read_published(spark, folder, "one").count() == 6


def test_what_is_read_back_has_to_be_what_was_written(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    publish_outputs(spark, {"one": numbers(spark, 5)}, folder)
    content = publishing._content
    seen = []

    def other(df):  # the second look sees other rows
        seen.append(df)
        return content(df) if len(seen) % 2 else [(c + 1).alias("rows") if i == 0 else c for i, c in enumerate(content(df))]

    monkeypatch.setattr(publishing, "_content", other)
    with pytest.raises(publishing.PublishError):
        publish_outputs(spark, {"one": numbers(spark, 8)}, folder)
    assert read_published(spark, folder, "one").count() == 5


def test_of_two_runs_at_a_time_one_publishes(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    before = publishing.manifest(spark, folder)
    publish_outputs(spark, {"one": numbers(spark, 5)}, folder)
    monkeypatch.setattr(publishing, "manifest", lambda *_: before)
    with pytest.raises(publishing.PublishError):
        publish_outputs(spark, {"one": numbers(spark, 8)}, folder)
    monkeypatch.undo()
    assert read_published(spark, folder, "one").count() == 5


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    folder, by = str(tmp_path), {"one": "part"}
    publish_outputs(spark, {"one": numbers(spark, 9)}, folder, by)
    publish_outputs(spark, {"one": numbers(spark, 2, "b")}, folder, by, update=["one"])
    table = read_published(spark, folder, "one")
    assert table.columns == ["id", "label", "part"]
    told = {(r["part"], r["label"]): r["n"] for r in table.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert told == {(0, "b"): 1, (1, "b"): 1, (2, "a"): 3}
    assert publishing.prune_published(spark, folder) == ["_manifests/0000000001.json"]
    assert read_published(spark, folder, "one").count() == 5
    with pytest.raises(ValueError):
        publish_outputs(spark, {"two": numbers(spark, 2)}, folder, update=["two"])


def test_a_record_is_taken_apart_once(spark, tmp_path, monkeypatch):
    """The format of timestamps stands in the plan once, however often their column is used."""
    from ledgerloom.sources import tolerant

    (tmp_path / "log.csv").write_text("536365;85123A;6;01.12.2010 08:26;2.55;17850.0\n")
    seen = []
    monkeypatch.setattr(tolerant, "stage", lambda df, name: seen.append(df) or df)
    columns = {c: c for c in ("invoice", "stock_code", "quantity", "invoice_ts", "price", "customer_id")}
    tolerant.load_tolerant(spark, [str(tmp_path / "log.csv")], "csv", columns, {"sep": ";"}, ["dd.MM.yyyy HH:mm"])
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("dd.MM.yyyy HH:mm") == 1
