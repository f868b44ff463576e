"""Random forests over a table of numeric columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Settings:
    """Size of a forest. Spark grows trees to 30 levels at most; 10 keep a forest of 100 small enough to share."""

    trees: int = 100
    depth: int = 10
    bins: int = 64
    seed: int = 42


def fit_classifier(train: DataFrame, columns: list[str], label: str, settings: Settings = Settings()) -> PipelineModel:
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol=label,
        numTrees=settings.trees,
        seed=settings.seed,
        maxDepth=settings.depth,
        maxBins=settings.bins,
        maxMemoryInMB=512,
        featureSubsetStrategy="sqrt",
    )
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), forest]).fit(train)


def fit_regressor(train: DataFrame, columns: list[str], label: str, settings: Settings = Settings()) -> PipelineModel:
    forest = RandomForestRegressor(
        featuresCol="features",
        labelCol=label,
        numTrees=settings.trees,
        seed=settings.seed,
        maxDepth=settings.depth,
        maxBins=settings.bins,
        maxMemoryInMB=512,
        featureSubsetStrategy="all",
    )
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), forest]).fit(train)


def importance(train: DataFrame, model: PipelineModel, n: int = 10) -> DataFrame:
    """The n columns the forest relies on most; one row per column exists in all."""
    columns = model.stages[0].getInputCols()
    rows = [(c, float(v)) for c, v in zip(columns, model.stages[-1].featureImportances.toArray())]
    return (
        train.sparkSession.createDataFrame(rows, "Feature string, Importance double")
        .orderBy(F.desc("Importance"), "Feature")
        .limit(n)
    )
