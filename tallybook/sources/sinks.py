"""Exports: CSV folders for result tables and saved ML pipelines."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, skip_empty: bool = False) -> bool:
    """Write a table as a CSV folder with a header, one file per task. True when something was written."""
    if skip_empty and df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True


def export_segments(segments: DataFrame, path: str) -> bool:
    return write_csv(segments, path)


def export_at_risk(at_risk: DataFrame, path: str) -> bool:
    """Nothing is written when no customer is at risk."""
    return write_csv(at_risk, path, skip_empty=True)


def export_forecast(forecast: DataFrame, path: str) -> bool:
    return write_csv(forecast.select("Date", "Predicted_Revenue"), path)


def export_clv(clv: DataFrame, path: str) -> bool:
    return write_csv(clv, path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

