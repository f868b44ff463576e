import datetime as dt
from decimal import Decimal

import numpy as np
import pytest

from tallybook.operators import metrics, overview
from tallybook.operators.cleaning import clean, conform, unreadable
from tallybook.plans import forecast
from tallybook.plans.maximum_likelihood import minimise
from tallybook.sources import sinks, staging
from tallybook.sources import transactions as sources

RAW = (
    "InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate string, "
    "UnitPrice double, CustomerID string, Country string"
)
DAY = "12/1/2010 8:26"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def test_cleaning_rules(spark):
    df = raw(
        spark,
        ("1", "A", "a", 2, DAY, 1.25, "17850.0", "UK"),  # kept, number text becomes 17850
        ("2", "A", "a", 2, DAY, 1.25, None, "UK"),  # no customer
        ("C3", "A", "a", 2, DAY, 1.25, "1", "UK"),  # cancelled
        ("4C4", "A", "a", 2, DAY, 1.25, "1", "UK"),  # C in the middle cancels too
        ("c5", "A", "a", 2, DAY, 1.25, "1", "UK"),  # a small c does not
        (None, "A", "a", 2, DAY, 1.25, "1", "UK"),  # no invoice number is no cancellation
        ("7", "A", "a", -2, DAY, 1.25, "1", "UK"),  # return
        ("8", "A", "a", 2, DAY, 0.0, "1", "UK"),  # free
        ("9", "A", "a", 2, "no date", 0.001, "1", "UK"),  # tiny price and no readable date are kept
        ("10", "A", "a", 2, DAY, 1.25, "x", "UK"),  # no customer number
    )
    rows = {r.InvoiceNo: r for r in clean(df).collect()}
    assert set(rows) == {"1", "c5", None, "9"}
    assert rows["1"].CustomerID == 17850
    assert rows["1"].TotalPrice == Decimal("2.5000")
    assert rows["1"].InvoiceDate == dt.datetime(2010, 12, 1, 8, 26)
    assert rows["9"].InvoiceDate is None and rows["9"].TotalPrice == Decimal("0.0020")


def test_conform_leaves_typed_columns_alone(spark):
    df = sources.star_schema_transactions(spark, "/root/testdata/sf0.001")
    assert conform(df).dtypes == df.dtypes
    assert conform(df).dtypes == [(f.name, f.dataType.simpleString()) for f in sources.TRANSACTION_SCHEMA]


def test_empty_log(spark):
    tx = clean(raw(spark))
    assert overview.daily_revenue(tx).collect() == []
    row = overview.kpis(tx).first()
    assert (row.Records, row.TotalRevenue, row.AvgOrderValue) == (0, None, None)


def test_null_keys_make_no_group(spark):
    tx = clean(
        raw(
            spark,
            ("1", "A", None, 1, DAY, 2.0, "1", None),
            (None, "A", "a", 1, DAY, 4.0, "1", "UK"),
            ("1", "B", "b", 1, "bad", 6.0, "2", "UK"),
        )
    )
    assert [(r.Country, r.TotalPrice) for r in overview.top_countries(tx).collect()] == [("UK", 10.0)]
    assert [r.StockCode for r in overview.top_products(tx).collect()] == ["B", "A"]
    assert [(r.Date, r.Revenue) for r in overview.daily_revenue(tx).collect()] == [(dt.date(2010, 12, 1), 6.0)]
    row = overview.kpis(tx).first()
    assert (row.Records, row.Customers, row.Countries, row.TotalRevenue, row.AvgOrderValue) == (3, 2, 1, 12.0, 8.0)


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_csv_in_both_encodings(spark, tmp_path, encoding):
    text = (
        "Country,InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Extra\n"
        'France,536365,85123A,"CAFÉ ""NOIR"", GRAND",6,12/1/2010 8:26,2.55,17850.0,x\n'
        "France,C536366,71053,LANTERN,6,2010-12-01 08:28:00,3.39,17850,x\n"
    )
    path = tmp_path / "log.csv"
    path.write_bytes(text.encode(encoding))
    assert sources.choose_encoding(spark, str(path)) == encoding
    first, second = sources.read_transactions(spark, str(path)).orderBy("InvoiceNo").collect()
    assert first.Description == 'CAFÉ "NOIR", GRAND' and first.CustomerID == 17850
    assert first.UnitPrice == Decimal("2.5500") and first.Country == "France"
    assert second.InvoiceDate == dt.datetime(2010, 12, 1, 8, 28)


def test_example_rows(spark):
    tx = clean(sources.example_transactions(spark))
    assert tx.count() == 5
    assert overview.kpis(tx).first().TotalRevenue == pytest.approx(6 * 2.55 + 6 * 3.39 + 8 * 2.75 + 12 * 3.39)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 5.0, 1)], "Date date, Predicted_Revenue double, Day int")
    assert sinks.export_forecast(df, str(tmp_path / "forecast"))
    back = spark.read.option("header", True).csv(str(tmp_path / "forecast"))
    assert back.columns == ["Date", "Predicted_Revenue"] and back.first().Date == "2020-01-01"
    assert not sinks.export_at_risk(df.filter("Day > 1"), str(tmp_path / "risk"))
    assert not (tmp_path / "risk").exists()
    assert sinks.export_clv(df, str(tmp_path / "clv")) and sinks.export_segments(df, str(tmp_path / "segments"))


def test_staged_table_is_pruned_by_month(spark, tmp_path):
    tx = clean(sources.example_transactions(spark))
    sources.stage_transactions(tx, str(tmp_path / "tx"))
    back = sources.read_staged_transactions(spark, str(tmp_path / "tx"))
    assert back.filter("InvoiceMonth = '2010-12'").count() == 5
    assert sorted(back.drop("InvoiceMonth").collect()) == sorted(tx.collect())


def test_stage_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, s string")
    back = staging.stage(df)
    assert back.dtypes == df.dtypes and sorted(r.id for r in back.collect()) == [1, 2]


TEXT = (
    "InvoiceNo string, StockCode string, Description string, Quantity string, InvoiceDate string, "
    "UnitPrice string, CustomerID string, Country string"
)


def test_no_figure_is_rounded_away(spark):
    rows = [
        ("1", "A", "a", "2", DAY, "0.00004", "9007199254740993", "UK"),
        ("2", "A", "a", "2.5", DAY, "3.00", "9007199254740992", "UK"),
        ("3", "A", "a", "1", DAY, "123456789012345.67", "17850.0", "UK"),
        ("4", "A", "a", "1", DAY, "0", "1", "UK"),
    ]
    got = {r.InvoiceNo: (r.TotalPrice, r.CustomerID) for r in clean(spark.createDataFrame(rows, TEXT)).collect()}
    assert got == {
        "1": (Decimal("0.00008"), 9007199254740993),
        "2": (Decimal("7.5"), 9007199254740992),
        "3": (Decimal("123456789012345.67"), 17850),
    }


def test_dates_in_given_formats_and_a_count_of_what_cannot_be_read(spark):
    days = ["31.12.2010 8:26", "12/1/10 8:26", "12/1/2010 8:26 AM", "2010-12-31", "soon", None]
    rows = [(str(i), "A", "a", "x" if i == 5 else "1", d, "1", "1", "UK") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, TEXT)
    formats = ["d.M.yyyy H:mm", "M/d/yy H:mm", "M/d/yyyy h:mm a"]
    read = {r.InvoiceNo: r.InvoiceDate for r in conform(df, formats).collect()}
    assert read["0"] == dt.datetime(2010, 12, 31, 8, 26)
    assert read["1"] == read["2"] == dt.datetime(2010, 12, 1, 8, 26)
    assert read["3"] == dt.datetime(2010, 12, 31) and read["4"] is None and read["5"] is None
    counts = {r.Column: r.Unreadable for r in unreadable(df, formats).collect()}
    assert counts == {"Quantity": 1, "InvoiceDate": 1, "UnitPrice": 0, "CustomerID": 0}
    assert {r.Column: r.Unreadable for r in unreadable(df).collect()}["InvoiceDate"] == 4


def test_files_with_unlike_headers_are_an_error(spark, tmp_path):
    header = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country"
    (tmp_path / "a.csv").write_text(f"{header}\n1,A,a,1,{DAY},2,3,UK\n")
    (tmp_path / "b.csv").write_text(f"{header.replace('InvoiceNo,StockCode', 'StockCode,InvoiceNo')}\nA,1,a,1,{DAY},2,3,UK\n")
    with pytest.raises(Exception, match="(?i)header"):
        sources.read_transactions(spark, str(tmp_path)).collect()


def test_confusion_has_both_classes(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0)], "label double, prediction double")
    assert sorted(map(tuple, metrics.confusion(df).collect())) == [(0, 0, 0), (1, 1, 1)]
    assert sorted(map(tuple, metrics.confusion(df.limit(0)).collect())) == [(0, 0, 0), (1, 0, 0)]


def test_a_short_log_gives_empty_forecasts(spark):
    rows = [(str(i), "A", "a", 2, f"12/{i}/2010 8:26", 1.25, "1", "UK") for i in range(1, 21)]
    found = forecast.analyse(clean(raw(spark, *rows)))
    assert found.model is None and found.importance.count() == found.tested.count() == 0
    assert forecast.with_band(found).columns == ["Date", "Predicted_Revenue", "Lower", "Upper"]
    assert forecast.with_band(found).count() == 0


def test_a_fit_that_does_not_end_raises():
    with pytest.raises(ArithmeticError):
        minimise(lambda points: np.array([-float(p[0]) for p in points]), np.zeros(1), rounds=5)
