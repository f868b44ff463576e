"""Churn features, labels, rates and the list of customers at risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.expressions import money, ratio, whole_days


def period(tx: DataFrame, churn_days: int = 90) -> DataFrame:
    """The last date of the log (Snapshot) and the date `churn_days` before it (Boundary), one row."""
    last = F.max("InvoiceDate")
    return tx.agg(last.alias("Snapshot"), (last - F.make_dt_interval(F.lit(churn_days))).alias("Boundary"))


def _boundary(tx: DataFrame, churn_days: int) -> Column:
    return period(tx, churn_days).select("Boundary").scalar()


def history(tx: DataFrame, churn_days: int = 90) -> DataFrame:
    return tx.filter(F.col("InvoiceDate") <= _boundary(tx, churn_days))


def outcome(tx: DataFrame, churn_days: int = 90) -> DataFrame:
    return tx.filter(F.col("InvoiceDate") > _boundary(tx, churn_days))


def churn_features(tx: DataFrame, churn_days: int = 90) -> DataFrame:
    """Eleven features of each customer's history and whether the customer stayed away afterwards.

    History and outcome are read in one pass: each measure looks at history lines only, and the
    label counts outcome lines, so no join with the outcome period is needed. Customers without
    history get no row. AvgOrderValue and OrderValueStd are per line.
    """
    boundary = F.col("Boundary")
    measures = F.struct("InvoiceDate", "InvoiceNo", "TotalPrice", "Quantity")
    marked = (
        tx.filter(F.col("InvoiceDate").isNotNull())
        .withColumn("Boundary", _boundary(tx, churn_days))
        .select(
            "CustomerID",
            "Boundary",
            (F.col("InvoiceDate") > boundary).alias("IsOutcome"),
            F.when(F.col("InvoiceDate") <= boundary, measures).alias("h"),
        )
    )
    spend, items = F.col("h.TotalPrice"), F.col("h.Quantity")
    lines = F.count("h.InvoiceDate")
    return (
        marked.groupBy("CustomerID")
        .agg(
            F.max("Boundary").alias("Boundary"),
            F.max("h.InvoiceDate").alias("Last"),
            F.min("h.InvoiceDate").alias("First"),
            lines.alias("TotalTransactions"),
            F.count_distinct("h.InvoiceNo").alias("OrderCount"),
            money(F.sum(spend)).alias("TotalSpend"),
            ratio(F.sum(spend), F.count(spend)).alias("AvgOrderValue"),
            F.stddev_samp(money(spend)).alias("OrderValueStd"),
            F.sum(items).alias("TotalItems"),
            ratio(F.sum(items), F.count(items)).alias("AvgItems"),
            F.stddev_samp(items).alias("ItemsStd"),
            (F.count_if("IsOutcome") == 0).alias("Churned"),
        )
        .filter(F.col("TotalTransactions") > 0)
        .select(
            "CustomerID",
            whole_days(boundary, F.col("Last")).alias("Recency"),
            whole_days(F.col("Last"), F.col("First")).alias("CustomerAge"),
            "TotalTransactions",
            "OrderCount",
            "TotalSpend",
            "AvgOrderValue",
            F.coalesce("OrderValueStd", F.lit(0.0)).alias("OrderValueStd"),
            "TotalItems",
            "AvgItems",
            F.coalesce("ItemsStd", F.lit(0.0)).alias("ItemsStd"),
            "Churned",
        )
        .withColumn("PurchaseFrequency", ratio(F.col("OrderCount"), F.col("CustomerAge") + 1))
    )


def churn_rate(features: DataFrame) -> DataFrame:
    churned = F.count_if("Churned")
    return features.agg(
        churned.alias("Churned"),
        (F.count(F.lit(1)) - churned).alias("Retained"),
        (ratio(churned, F.count(F.lit(1))) * 100).alias("ChurnRate"),
    )


def recency_histogram(features: DataFrame, bin_days: int = 30) -> DataFrame:
    return features.groupBy(
        "Churned", (F.floor(F.col("Recency") / bin_days) * bin_days).cast("bigint").alias("BinStart")
    ).agg(F.count(F.lit(1)).alias("Customers"))


def split(features: DataFrame, train_percent: int = 75, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test part by a hash of the key: the same split however the rows are laid out."""
    bucket = F.pmod(F.xxhash64("CustomerID", F.lit(seed)), F.lit(100))
    return features.filter(bucket < train_percent), features.filter(bucket >= train_percent)


def at_risk(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Customers whose churn probability reaches the threshold, most endangered first, with value scores."""
    p = F.col("Churn_Probability")
    return (
        scored.filter(p >= threshold)
        .withColumn("CLV_Estimation", F.col("TotalSpend") / (1 + p))
        .withColumn("Prioritization_Score", F.col("CLV_Estimation") * p)
        .orderBy(F.desc("Churn_Probability"), "CustomerID")
        .select(
            "CustomerID",
            "Churn_Probability",
            "Recency",
            "TotalSpend",
            "OrderCount",
            "CLV_Estimation",
            "Prioritization_Score",
        )
    )
