"""Exact quantiles of a large column without sorting it in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, column: str, quantiles: list[float], accuracy: int = 10_000) -> DataFrame:
    """Quantiles with linear interpolation between neighbours, one row: Q (array, in the given order).

    Spark's exact `percentile` gathers all distinct values in one task. Here a quantile sketch
    gives a bracket that is sure to hold the wanted positions (its rank error is at most
    rows / accuracy); lines below the bracket are only counted, and only the few inside are ranked.
    """
    values = df.select(F.col(column).cast("double").alias("v"))
    slack = 2.0 / accuracy
    marks = [min(max(q + side * slack, 0.0), 1.0) for q in quantiles for side in (-1, 1)]
    sketch = values.agg(
        F.struct(
            F.percentile_approx("v", marks, accuracy).alias("marks"),
            F.count("v").alias("n"),
        )
    ).scalar()
    marks_of, rows = F.col("s.marks"), F.col("s.n")
    many = rows > accuracy
    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                # few values need no bracket, and the first and last quantile none on their outer side
                F.when(many & F.lit(marks[2 * i] > 0), marks_of[2 * i]).alias("from"),
                F.when(many & F.lit(marks[2 * i + 1] < 1), marks_of[2 * i + 1]).alias("to"),
                ((rows - 1) * F.lit(float(q))).alias("position"),
            )
            for i, q in enumerate(quantiles)
        ]
    )
    # per quantile: values below the bracket become one count, values inside stay apart
    counted = (
        values.select("v", sketch.alias("s"))
        .select("v", F.inline(brackets))
        .filter(F.col("to").isNull() | (F.col("v") <= F.col("to")))
        .select("i", "position", "v", F.when(F.col("from").isNull() | (F.col("v") >= F.col("from")), F.col("v")).alias("inside"))
        .groupBy("i", "position", "inside")
        .agg(F.count("v").alias("n"))
    )
    up_to_here = Window.partitionBy("i").orderBy(F.asc_nulls_first("inside"))
    ranked = counted.withColumn("End", F.sum("n").over(up_to_here)).filter(F.col("inside").isNotNull())

    def at(position):
        # the value whose run of equal values covers this zero-based position
        return F.min(F.when(F.col("End") > position, F.col("inside")))

    low, high = at(F.floor("position")), at(F.ceil("position"))
    return (
        ranked.groupBy("i", "position")
        .agg((low + (high - low) * (F.col("position") - F.floor("position"))).alias("q"))
        .agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("rows"))  # one row per quantile
        .select(F.when(F.size("rows") == len(quantiles), F.col("rows.q")).alias("Q"))
    )
