"""States by day or month and country that merge: distinct counts and quantiles of any range without the lines.

A state is small and of a fixed size, whatever the number of lines. Days and countries are merged by Spark's own
aggregates, so that a report over a year reads a few hundred states for each country instead of the log.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.expressions import money

# 2 ** HLL_LOG_K registers for each distinct count, and the size of each quantile sketch
HLL_LOG_K = 12
KLL_K = 200

DISTINCT = {"Customers": "CustomerID", "Products": "StockCode", "Invoices": "InvoiceNo"}


def distinct_error(deviations: float = 3.0) -> float:
    """The relative error of a merged distinct count that is exceeded as rarely as so many standard deviations."""
    return deviations * 1.04 / math.sqrt(1 << HLL_LOG_K)


def rank_error() -> float:
    """The error in rank of a merged quantile, kept in 99 of 100 cases: 1.65 % for the default size."""
    return 2.446 / KLL_K**0.9433


def distinct_states(tx: DataFrame) -> DataFrame:
    """Per day and country: lines, revenue, and a state for each distinct count. Lines without a date have a null day."""
    states = [F.hll_sketch_agg(c, F.lit(HLL_LOG_K)).alias(name) for name, c in DISTINCT.items()]
    return tx.groupBy(F.to_date("InvoiceDate").alias("Date"), "Country").agg(
        F.count(F.lit(1)).alias("Records"), F.sum("TotalPrice").alias("Revenue"), *states
    )


def merge_distinct(states: DataFrame, *by: str | Column) -> DataFrame:
    """Union the states of each group, in the same form, for further unions. Without groups, one row."""
    merged = [F.hll_union_agg(name).alias(name) for name in DISTINCT]
    return states.groupBy(*by).agg(F.sum("Records").alias("Records"), F.sum("Revenue").alias("Revenue"), *merged)


def distinct_counts(merged: DataFrame) -> DataFrame:
    """Numbers in place of the states; `distinct_error` bounds what they are off."""
    numbers = {name: F.hll_sketch_estimate(name) for name in DISTINCT}
    return merged.withColumns(numbers | {"Revenue": money(F.col("Revenue"))})


def quantile_states(values: DataFrame, column: str, *by: str | Column) -> DataFrame:
    """Per group the number of values and a quantile sketch of them; nulls are left out."""
    return (
        values.filter(F.col(column).isNotNull())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("Values"), F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(KLL_K)).alias("Sketch"))
    )


def merge_quantiles(states: DataFrame, *by: str | Column) -> DataFrame:
    return states.groupBy(*by).agg(F.sum("Values").alias("Values"), F.kll_merge_agg_double("Sketch", F.lit(KLL_K)).alias("Sketch"))


def quantiles(merged: DataFrame, at: dict[str, float]) -> DataFrame:
    """Columns of quantiles in place of the sketch: values whose rank is off by `rank_error` at most."""
    found = [F.kll_sketch_get_quantile_double("Sketch", F.lit(q)).alias(name) for name, q in at.items()]
    return merged.select(*[c for c in merged.columns if c != "Sketch"], *found)
