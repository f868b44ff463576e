"""Features of the daily revenue series, the future rows to predict, and figures of a forecast.

Windows without a partition key run over days, after the lines have been summed: a century of
trading is under 40,000 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.constants import LAGS, ROLLING_WINDOWS
from tallybook.functions.expressions import ratio

def calendar(days: DataFrame) -> DataFrame:
    """Calendar columns of Date; Monday is 0, weeks are ISO weeks."""
    return days.select(
        "*",
        F.dayofmonth("Date").alias("Day"),
        F.month("Date").alias("Month"),
        F.year("Date").alias("Year"),
        F.weekday("Date").alias("DayOfWeek"),
        F.weekofyear("Date").alias("WeekOfYear"),
    )


def series_features(daily: DataFrame, exclude_current: bool = False) -> DataFrame:
    """Calendar, lag and rolling columns; days without a full history are dropped.

    Lags and windows count observed days. Rolling windows include the day itself unless
    `exclude_current` is set.
    """

    by_date = Window.orderBy("Date")

    def rolling(w: int, aggregate: Column) -> Column:
        first, last = (-w, -1) if exclude_current else (1 - w, 0)
        frame = by_date.rowsBetween(first, last)
        return F.when(F.count("Revenue").over(frame) == w, aggregate.over(frame))

    return (
        calendar(daily)
        .select(
            "*",
            *[F.lag("Revenue", n).over(by_date).alias(f"Revenue_Lag_{n}") for n in LAGS],
            *[
                rolling(w, aggregate).alias(f"Revenue_Rolling_{name}_{w}")
                for w in ROLLING_WINDOWS
                for name, aggregate in (("Mean", F.avg("Revenue")), ("Std", F.stddev_samp("Revenue")))
            ],
        )
        .dropna()
    )


def time_split(series: DataFrame, train_share: float = 0.8) -> DataFrame:
    """Mark the first `train_share` of the days as the training part."""
    cut = F.floor(F.count(F.lit(1)).over(Window.partitionBy()) * F.lit(train_share))
    return series.withColumn("IsTrain", F.row_number().over(Window.orderBy("Date")) <= cut)


def future_features(series: DataFrame, horizon: int = 30) -> DataFrame:
    """Rows for the days after the series, with its last values as lags and rolling figures.

    These columns are the same for every future day. Without enough days for the longest lag there
    is nothing to carry forward and no row comes back.
    """
    back = Window.orderBy(F.desc("Date"))
    newest_first = series.select("Date", "Revenue", F.row_number().over(back).alias("Age"))

    def newest(w: int) -> Column:
        return F.when(F.col("Age") <= w, F.col("Revenue"))

    last = newest_first.agg(
        F.count(F.lit(1)).alias("Days"),
        F.max("Date").alias("LastDate"),
        *[F.max(F.when(F.col("Age") == n, F.col("Revenue"))).alias(f"Revenue_Lag_{n}") for n in LAGS],
        *[
            aggregate(newest(w)).alias(f"Revenue_Rolling_{name}_{w}")
            for w in ROLLING_WINDOWS
            for name, aggregate in (("Mean", F.avg), ("Std", F.stddev_samp))
        ],
    ).filter(F.col("Days") >= max(LAGS))
    spine = F.sequence(F.date_add("LastDate", 1), F.date_add("LastDate", horizon))
    return calendar(last.select(F.explode(spine).alias("Date"), *last.columns[2:]))


def actual_and_predicted(predicted: DataFrame) -> DataFrame:
    return predicted.select("Date", F.col("Revenue").alias("Actual"), F.col("prediction").alias("Predicted"))


def history_and_forecast(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """Past and predicted revenue in one table, each in its own column."""
    past = series.select("Date", F.col("Revenue").alias("Historical"))
    future = forecast.select("Date", F.col("Predicted_Revenue").alias("Forecast"))
    return past.unionByName(future, allowMissingColumns=True)


def band(forecast: DataFrame, rmse: Column | float) -> DataFrame:
    """A 95 % band around the prediction from the hold-out error."""
    error = rmse if isinstance(rmse, Column) else F.lit(rmse)
    # Fixed value: normal quantile of a two-sided 95 % band
    width = error * F.lit(1.96)
    p = F.col("Predicted_Revenue")
    return forecast.select("Date", "Predicted_Revenue", (p - width).alias("Lower"), (p + width).alias("Upper"))


def forecast_summary(series: DataFrame, forecast: DataFrame, horizon: int = 30) -> DataFrame:
    """Total, mean and peak of a forecast, with the change in % against the recent and the whole past."""
    rows = history_and_forecast(series, forecast).withColumn(
        # past days first, newest first; forecast days sort last and are never among the newest past days
        "Age",
        F.row_number().over(Window.orderBy(F.col("Historical").isNull(), F.desc("Date"))),
    )
    recent = F.sum(F.when((F.col("Age") <= horizon), F.col("Historical")))
    peak = F.max_by(
        F.struct("Date", "Forecast"), F.when(F.col("Forecast").isNotNull(), F.struct(F.col("Forecast"), -F.unix_date("Date")))
    )
    return rows.agg(
        F.sum("Forecast").alias("Total"),
        ((ratio(F.sum("Forecast"), recent) - 1) * 100).alias("TotalChange"),
        F.avg("Forecast").alias("DailyMean"),
        ((ratio(F.avg("Forecast"), F.avg("Historical")) - 1) * 100).alias("DailyMeanChange"),
        peak.alias("Peak"),
    ).select(
        "Total",
        "TotalChange",
        "DailyMean",
        "DailyMeanChange",
        F.col("Peak.Date").alias("PeakDate"),
        F.col("Peak.Forecast").alias("PeakRevenue"),
    )
