"""Train a churn forest, judge it on held-out customers and score everyone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.constants import CHURN_FEATURES
from tallybook.operators import churn as ops
from tallybook.operators import metrics
from tallybook.plans import forests
from tallybook.sources.staging import stage


@dataclass
class ChurnModel:
    """A fitted forest, or the only class seen in training when there was just one."""

    forest: PipelineModel | None
    only_class: float | None

    def predict(self, features: DataFrame) -> DataFrame:
        """Add prediction and Churn_Probability."""
        if self.forest is None:
            return features.withColumn("prediction", F.lit(self.only_class)).withColumn(
                "Churn_Probability", F.lit(self.only_class)
            )
        return (
            self.forest.transform(features)
            .withColumn("Churn_Probability", vector_to_array("probability")[1])
            .drop("features", "rawPrediction", "probability")
        )


def labelled(tx: DataFrame, churn_days: int = 90) -> DataFrame:
    """Features with a numeric label, staged because training reads them many times."""
    features = ops.churn_features(tx, churn_days)
    return stage(features.withColumn("label", F.col("Churned").cast("double")))


def train(features: DataFrame, settings: forests.Settings = forests.Settings()) -> ChurnModel:
    part, _ = ops.split(features)
    classes = [row["label"] for row in part.select("label").distinct().collect()]  # two at most
    if len(classes) < 2:
        return ChurnModel(None, classes[0] if classes else 0.0)
    return ChurnModel(forests.fit_classifier(part, CHURN_FEATURES, "label", settings), None)


@dataclass
class ChurnReport:
    model: ChurnModel
    accuracy: DataFrame
    confusion: DataFrame
    report: DataFrame
    importance: DataFrame | None
    scored: DataFrame


def analyse(tx: DataFrame, churn_days: int = 90, settings: forests.Settings = forests.Settings()) -> ChurnReport:
    features = labelled(tx, churn_days)
    model = train(features, settings)
    part, held_out = ops.split(features)
    judged = model.predict(held_out)
    return ChurnReport(
        model=model,
        accuracy=metrics.accuracy(judged),
        confusion=metrics.confusion(judged),
        report=metrics.classification_report(judged),
        importance=forests.importance(part, model.forest) if model.forest else None,
        scored=model.predict(features),
    )
