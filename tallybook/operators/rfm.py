"""Recency, frequency and monetary value of customers, and profiles of their clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.constants import RFM_METRICS, SEGMENT_NAMES
from tallybook.functions.expressions import money, ratio, whole_days
from tallybook.sources.staging import stage


def rfm(tx: DataFrame) -> DataFrame:
    """Days since the last purchase (counted from one day after the log ends), invoices and spend.

    Spark plans the distinct count over (customer, invoice) first, so even a customer with a large
    share of all lines is spread over the tasks and combined before the shuffle on CustomerID. The
    log is read once: its last date is the latest of the customers' last dates.
    """
    per_customer = stage(
        tx.groupBy("CustomerID").agg(
            F.max("InvoiceDate").alias("LastPurchase"),
            F.count_distinct("InvoiceNo").alias("Frequency"),
            money(F.sum("TotalPrice")).alias("Monetary"),
        )
    )
    snapshot = per_customer.agg(F.max("LastPurchase") + F.expr("INTERVAL 1 DAY")).scalar()
    recency = whole_days(snapshot, F.col("LastPurchase")).alias("Recency")
    return per_customer.select("CustomerID", recency, "Frequency", "Monetary")


def scale(customers: DataFrame, columns: list[str] = RFM_METRICS) -> DataFrame:
    """Add `<column>_Scaled`: zero mean, unit population deviation; a constant column becomes 0."""
    moments = customers.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns]
        )
    ).scalar()

    def scaled(c: str):
        z = F.try_divide(F.col(c) - F.col(f"Moments.{c}_mean"), F.col(f"Moments.{c}_std"))
        return F.coalesce(z, F.lit(0.0)).alias(f"{c}_Scaled")

    return customers.select("*", moments.alias("Moments")).select(*customers.columns, *[scaled(c) for c in columns])


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """Means, size and share of each cluster.

    The window spans one row per cluster (ten at most), after the aggregation.
    """
    return (
        clustered.groupBy("Cluster")
        .agg(
            F.avg("Recency").alias("Avg_Recency"),
            F.avg("Frequency").alias("Avg_Frequency"),
            F.avg("Monetary").alias("Avg_Monetary"),
            F.count("CustomerID").alias("Customer_Count"),
        )
        .withColumn(
            "Percentage",
            F.bround(ratio(F.col("Customer_Count"), F.sum("Customer_Count").over(Window.partitionBy())) * 100, 2),
        )
    )


def name_clusters(profile: DataFrame) -> DataFrame:
    """Name clusters by their rank of average spend (one row per cluster)."""
    rank = F.row_number().over(Window.orderBy(F.desc("Avg_Monetary"), "Cluster"))
    names = F.array(*[F.lit(name) for name in SEGMENT_NAMES])
    return (
        profile.withColumn("Rank", rank)
        .withColumn(
            "Segment",
            F.coalesce(F.try_element_at(names, F.col("Rank")), F.concat(F.lit("Segment "), F.col("Rank").cast("string"))),
        )
        .drop("Rank")
    )


def assign_segments(clustered: DataFrame, named_profile: DataFrame) -> DataFrame:
    """Put the segment name on each customer.

    The names are one row per cluster; Spark sees that size and broadcasts them.
    """
    return clustered.join(named_profile.select("Cluster", "Segment"), "Cluster", "left")


def radar(named_profile: DataFrame) -> DataFrame:
    """Cluster means on a 0 to 1 scale; recency is turned round so that 1 is best.

    Null when all clusters have the same mean.
    """
    everything = Window.partitionBy()

    def low_to_high(c: str):
        low, high = F.min(c).over(everything), F.max(c).over(everything)
        return ratio(F.col(c) - low, high - low)

    return named_profile.select(
        "*",
        (1 - low_to_high("Avg_Recency")).alias("Avg_Recency_Norm"),
        low_to_high("Avg_Frequency").alias("Avg_Frequency_Norm"),
        low_to_high("Avg_Monetary").alias("Avg_Monetary_Norm"),
    )


def segment_sizes(named_profile: DataFrame) -> DataFrame:
    return named_profile.select("Segment", "Customer_Count")


def segment_points(segmented: DataFrame) -> DataFrame:
    return segmented.select("CustomerID", *RFM_METRICS, "Segment")
