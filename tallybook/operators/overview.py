"""Headline figures, daily revenue and best sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.expressions import money, ratio


def preview(tx: DataFrame, n: int = 5) -> DataFrame:
    """The n earliest lines, in a full order so that the same lines come back on any layout."""
    return tx.orderBy(
        "InvoiceDate", "InvoiceNo", "StockCode", "Quantity", "UnitPrice", "CustomerID", "Country", "Description"
    ).limit(n)


def kpis(tx: DataFrame) -> DataFrame:
    """One row of headline figures from one pass.

    The mean over invoices of the invoice sum is the revenue of numbered invoices over their
    number, so no second grouping is needed. Distinct counts are exact.
    """
    numbered = F.when(F.col("InvoiceNo").isNotNull(), F.col("TotalPrice"))
    return tx.agg(
        F.count(F.lit(1)).alias("Records"),
        F.count_distinct("CustomerID").alias("Customers"),
        F.count_distinct("StockCode").alias("Products"),
        F.count_distinct("Country").alias("Countries"),
        F.to_date(F.min("InvoiceDate")).alias("FirstDate"),
        F.to_date(F.max("InvoiceDate")).alias("LastDate"),
        money(F.sum("TotalPrice")).alias("TotalRevenue"),
        ratio(F.sum(numbered), F.count_distinct("InvoiceNo")).alias("AvgOrderValue"),
    )


def daily_revenue(tx: DataFrame) -> DataFrame:
    """Revenue of each day that has sales."""
    return (
        tx.filter(F.col("InvoiceDate").isNotNull())
        .groupBy(F.to_date("InvoiceDate").alias("Date"))
        .agg(money(F.sum("TotalPrice")).alias("Revenue"))
    )


def top_countries(tx: DataFrame, n: int = 10) -> DataFrame:
    return (
        tx.filter(F.col("Country").isNotNull())
        .groupBy("Country")
        .agg(money(F.sum("TotalPrice")).alias("TotalPrice"))
        .orderBy(F.desc("TotalPrice"), "Country")
        .limit(n)
    )


def top_products(tx: DataFrame, n: int = 10) -> DataFrame:
    return (
        tx.filter(F.col("StockCode").isNotNull() & F.col("Description").isNotNull())
        .groupBy("StockCode", "Description")
        .agg(money(F.sum("TotalPrice")).alias("TotalPrice"))
        .orderBy(F.desc("TotalPrice"), "StockCode", "Description")
        .limit(n)
    )
