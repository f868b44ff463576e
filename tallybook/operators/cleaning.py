"""Typing and cleaning of raw transaction lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.constants import DATE_FORMATS


# types for figures that arrive as text: room for any price in use, and for goods sold by weight
WIDE_PRICE = "decimal(30,12)"
WIDE_QUANTITY = "decimal(18,4)"


def conform(raw: DataFrame, date_formats: Sequence[str] = DATE_FORMATS, keep: Sequence[str] = ()) -> DataFrame:
    """Give every column its type; text that cannot be read becomes null (`unreadable` counts it).

    Columns that already have the right type pass through untouched, so that filters on them still
    reach a Parquet scan. Dates are read in ISO form first and then in each of `date_formats`, in order. Columns to
    `keep` follow as they are.
    """
    found = dict(raw.dtypes)

    customer = F.col("CustomerID")
    if found["CustomerID"] != "bigint":
        # "17850.0" and 17850.0 are customer 17850; whole numbers do not pass through a double, which would round them
        customer = F.coalesce(customer.try_cast("bigint"), customer.try_cast("double").try_cast("bigint"))
        if found["CustomerID"] in ("double", "float"):
            customer = F.col("CustomerID").try_cast("bigint")
    date = F.col("InvoiceDate")
    if found["InvoiceDate"] == "string":
        date = F.coalesce(
            date.try_cast("timestamp_ntz"),
            *[F.try_to_timestamp(date, F.lit(f)).cast("timestamp_ntz") for f in date_formats],
        )
    elif found["InvoiceDate"] != "timestamp_ntz":
        date = date.cast("timestamp_ntz")
    quantity = F.col("Quantity")
    if found["Quantity"] not in ("int", "smallint", "tinyint", "bigint") and not found["Quantity"].startswith("decimal"):
        quantity = quantity.try_cast(WIDE_QUANTITY)
    price = F.col("UnitPrice")
    if not found["UnitPrice"].startswith("decimal"):
        price = price.try_cast(WIDE_PRICE)

    return raw.select(
        F.col("InvoiceNo").cast("string").alias("InvoiceNo"),
        F.col("StockCode").cast("string").alias("StockCode"),
        "Description",
        quantity.alias("Quantity"),
        date.alias("InvoiceDate"),
        price.alias("UnitPrice"),
        customer.alias("CustomerID"),
        "Country",
        *keep,
    )


def unreadable(raw: DataFrame, date_formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """For each typed column the number of values that are present in the raw table and null after `conform`."""
    columns = ("Quantity", "InvoiceDate", "UnitPrice", "CustomerID")
    counts = [
        table.agg(*[F.count(c).alias(c) for c in columns]).select(F.lit(side).alias("Side"), *columns)
        for side, table in (("given", raw), ("read", conform(raw, date_formats)))
    ]
    per_column = counts[0].union(counts[1]).agg(
        *[F.sum(F.when(F.col("Side") == "given", F.col(c)).otherwise(-F.col(c))).alias(c) for c in columns]
    )
    pairs = [F.struct(F.lit(c).alias("Column"), F.col(c).alias("Unreadable")) for c in columns]
    return per_column.select(F.inline(F.array(*pairs)))


def drop_anonymous(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("CustomerID").isNotNull())


def drop_cancelled(raw: DataFrame) -> DataFrame:
    """An upper-case C anywhere in the number marks a cancelled invoice; a missing number does not."""
    return raw.filter(~F.coalesce(F.col("InvoiceNo").contains("C"), F.lit(False)))


def with_total_price(raw: DataFrame) -> DataFrame:
    """Quantity times price; figures of a wide type keep a wide total, so that none is rounded away."""
    narrow = raw.schema["UnitPrice"].dataType.simpleString() == "decimal(12,4)"
    total = (F.col("Quantity") * F.col("UnitPrice")).cast("decimal(18,4)" if narrow else "decimal(38,8)")
    return raw.withColumn("TotalPrice", total)


def drop_returns(raw: DataFrame) -> DataFrame:
    return raw.filter((F.col("Quantity") > 0) & (F.col("UnitPrice") > 0))


def clean(raw: DataFrame, date_formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Typed lines of identified customers, without cancellations, returns and free items."""
    return with_total_price(drop_returns(drop_cancelled(drop_anonymous(conform(raw, date_formats)))))
