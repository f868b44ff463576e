import datetime as dt
import math
import statistics

import pytest

from tallybook.operators import forecast, metrics
from tallybook.plans import forecast as plan

START = dt.date(2011, 1, 1)


def daily(spark, n, gap=()):
    days = [START + dt.timedelta(days=i) for i in range(n) if i not in gap]
    return spark.createDataFrame(
        [(d, 100.0 + 10 * d.weekday() + (d.toordinal() % 11)) for d in days], "Date date, Revenue double"
    )


def test_series_counts_observed_days(spark):
    source = daily(spark, 50, gap={5, 6, 20})
    values = [r.Revenue for r in source.orderBy("Date").collect()]
    rows = forecast.series_features(source).orderBy("Date").collect()
    assert len(rows) == len(values) - 30
    first = rows[0]
    assert (first.Revenue_Lag_1, first.Revenue_Lag_30) == (values[29], values[0])
    assert first.Revenue_Rolling_Mean_7 == pytest.approx(statistics.mean(values[24:31]))
    assert first.Revenue_Rolling_Std_30 == pytest.approx(statistics.stdev(values[1:31]))
    assert first.DayOfWeek == first.Date.weekday() and first.WeekOfYear == first.Date.isocalendar()[1]
    past_only = forecast.series_features(source, exclude_current=True).orderBy("Date").first()
    assert past_only.Revenue_Rolling_Mean_7 == pytest.approx(statistics.mean(values[23:30]))


def test_split_is_chronological(spark):
    rows = forecast.time_split(daily(spark, 11)).orderBy("Date").collect()
    assert [r.IsTrain for r in rows] == [True] * 8 + [False] * 3


def test_future_carries_the_last_values(spark):
    series = forecast.series_features(daily(spark, 80))
    values = [r.Revenue for r in series.orderBy("Date").collect()]
    rows = forecast.future_features(series, 9).orderBy("Date").collect()
    assert [r.Date for r in rows] == [START + dt.timedelta(days=80 + i) for i in range(9)]
    assert {r.Revenue_Lag_14 for r in rows} == {values[-14]}
    assert {round(r.Revenue_Rolling_Std_7, 9) for r in rows} == {round(statistics.stdev(values[-7:]), 9)}


def test_short_series_has_no_future(spark):
    assert forecast.future_features(forecast.series_features(daily(spark, 59)), 9).count() == 0
    assert forecast.future_features(forecast.series_features(daily(spark, 60)), 9).count() == 9


def test_summary(spark):
    past = spark.createDataFrame([(START + dt.timedelta(days=i), 10.0 * (i + 1)) for i in range(4)], "Date date, Revenue double")
    future = spark.createDataFrame(
        [(START + dt.timedelta(days=4 + i), v) for i, v in enumerate([50.0, 80.0, 80.0])],
        "Date date, Predicted_Revenue double",
    )
    row = forecast.forecast_summary(past, future, 3).first()
    assert row.Total == 210.0 and row.TotalChange == pytest.approx((210 / 90 - 1) * 100)
    assert row.DailyMean == 70.0 and row.DailyMeanChange == pytest.approx((70 / 25 - 1) * 100)
    assert (row.PeakDate, row.PeakRevenue) == (START + dt.timedelta(days=5), 80.0)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "Actual double, Predicted double")
    row = metrics.regression_metrics(df).first()
    assert row.RMSE == pytest.approx(math.sqrt(2 / 3)) and row.R2 == pytest.approx(1 - 2 / 8)


def test_whole_forecast(spark):
    tx = daily(spark, 150).selectExpr(
        "CAST(Date AS TIMESTAMP_NTZ) AS InvoiceDate", "CAST(Revenue AS DECIMAL(18,4)) AS TotalPrice"
    )
    out = plan.analyse(tx, 14)
    assert out.tested.count() == 24 and out.quality.first().R2 > 0
    banded = plan.with_band(out).collect()
    assert len(banded) == 14 and all(r.Lower < r.Predicted_Revenue < r.Upper for r in banded)
    assert out.importance.count() == 10


def test_whole_forecast_of_a_short_log(spark):
    tx = daily(spark, 20).selectExpr(
        "CAST(Date AS TIMESTAMP_NTZ) AS InvoiceDate", "CAST(Revenue AS DECIMAL(18,4)) AS TotalPrice"
    )
    out = plan.analyse(tx)
    assert out.model is None and out.future.count() == 0
