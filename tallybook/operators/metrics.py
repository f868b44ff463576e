"""Quality of predictions, for any table of (label, prediction) or (Actual, Predicted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.expressions import ratio


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        ratio(F.count_if(F.col("label") == F.col("prediction")), F.count(F.lit(1))).alias("Accuracy")
    )


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts of actual (rows) against predicted classes: always both of each, 0 where nothing falls."""

    def cell(actual: int, predicted: int):
        return F.count_if((F.col("label") == actual) & (F.col("prediction") == predicted))

    rows = [F.struct(F.lit(a).alias("Actual"), *[F.col(f"c{a}{p}").alias(f"Predicted_{p}") for p in (0, 1)]) for a in (0, 1)]
    cells = predictions.agg(*[cell(a, p).alias(f"c{a}{p}") for a in (0, 1) for p in (0, 1)])
    return cells.select(F.inline(F.array(*rows)))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    One pass counts the (label, prediction) cells; all else works on those few rows.
    A ratio without cases is 0.
    """
    cells = predictions.groupBy(
        F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))
    # each cell counts once for its actual class and once for its predicted class
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("Class"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("Hits"),
                    F.col("n").alias("Support"),
                    F.lit(0).cast("bigint").alias("Predicted"),
                ),
                F.struct(
                    F.col("prediction").alias("Class"),
                    F.lit(0).cast("bigint").alias("Hits"),
                    F.lit(0).cast("bigint").alias("Support"),
                    F.col("n").alias("Predicted"),
                ),
            )
        ).alias("s")
    ).select("s.*")
    zero = F.lit(0.0)
    per_class = (
        sides.groupBy("Class")
        .agg(F.sum("Hits").alias("Hits"), F.sum("Support").alias("Support"), F.sum("Predicted").alias("Predicted"))
        .select(
            F.col("Class").cast("string").alias("Class"),
            F.coalesce(ratio(F.col("Hits"), F.col("Predicted")), zero).alias("Precision"),
            F.coalesce(ratio(F.col("Hits"), F.col("Support")), zero).alias("Recall"),
            F.coalesce(ratio(2 * F.col("Hits"), F.col("Support") + F.col("Predicted")), zero).alias("F1"),
            "Support",
            "Hits",
        )
    )
    total = F.sum("Support")

    def weighted(c: str):
        return ratio(F.sum(F.col(c) * F.col("Support")), total)

    def line(name: str, precision, recall, f1):
        return F.struct(
            F.lit(name).alias("Class"),
            precision.alias("Precision"),
            recall.alias("Recall"),
            f1.alias("F1"),
            total.alias("Support"),
        )

    none = F.lit(None).cast("double")
    summary = per_class.agg(
        F.array(
            line("accuracy", none, none, ratio(F.sum("Hits"), total)),
            line("macro avg", F.avg("Precision"), F.avg("Recall"), F.avg("F1")),
            line("weighted avg", weighted("Precision"), weighted("Recall"), weighted("F1")),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_class.drop("Hits").unionByName(summary)


def regression_metrics(predictions: DataFrame) -> DataFrame:
    """RMSE and R2 of (Actual, Predicted) in one aggregate; R2 is null when the actuals are constant."""
    error = F.col("Actual") - F.col("Predicted")
    return predictions.agg(
        F.sqrt(F.avg(error * error)).alias("RMSE"),
        (1 - ratio(F.sum(error * error), F.var_pop("Actual") * F.count("Actual"))).alias("R2"),
    )
