"""Train a revenue forest on the older days, judge it on the newer ones and predict the future."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.constants import FORECAST_FEATURES
from tallybook.operators import forecast as ops
from tallybook.operators import metrics
from tallybook.operators.overview import daily_revenue
from tallybook.plans import forests
from tallybook.sources.staging import stage


@dataclass
class RevenueForecast:
    """All parts of a forecast; when the series is too short, `model` is None, the tables are empty, the errors null."""

    series: DataFrame
    model: PipelineModel | None
    tested: DataFrame
    quality: DataFrame
    importance: DataFrame
    future: DataFrame


def analyse(tx: DataFrame, horizon: int = 30, settings: forests.Settings = forests.Settings()) -> RevenueForecast:
    series = stage(ops.time_split(ops.series_features(daily_revenue(tx))))
    past, recent = series.filter("IsTrain"), series.filter("NOT IsTrain")
    future = ops.future_features(series, horizon)
    if past.limit(2).count() < 2:
        empty = future.filter(F.lit(False)).withColumn("Predicted_Revenue", F.lit(None).cast("double"))
        spark = tx.sparkSession
        return RevenueForecast(
            series,
            None,
            spark.createDataFrame([], "Date date, Actual double, Predicted double"),
            spark.createDataFrame([(None, None)], "RMSE double, R2 double"),
            spark.createDataFrame([], "Feature string, Importance double"),
            empty,
        )
    # the windows left all days in one partition; a few are enough for the trees of a daily series
    model = forests.fit_regressor(past.repartition(8, "Date"), FORECAST_FEATURES, "Revenue", settings)
    tested = ops.actual_and_predicted(model.transform(recent))
    predicted = model.transform(future).drop("features").withColumnRenamed("prediction", "Predicted_Revenue")
    return RevenueForecast(
        series, model, tested, metrics.regression_metrics(tested), forests.importance(past, model), predicted
    )


def with_band(forecast: RevenueForecast) -> DataFrame:
    """Predicted days with a 95 % band from the error on the tested days."""
    return ops.band(forecast.future, forecast.quality.select("RMSE").scalar())
