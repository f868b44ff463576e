"""Sources of the transaction relation: CSV logs, a staged Parquet table, a star schema, example rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.constants import DATE_FORMATS, TRANSACTION_COLUMNS
from tallybook.operators.cleaning import conform

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.IntegerType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("UnitPrice", T.DecimalType(12, 4)),
        T.StructField("CustomerID", T.LongType()),
        T.StructField("Country", T.StringType()),
    ]
)


def choose_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line is valid UTF-8, else ISO-8859-1.

    The scan stops at the first invalid line, and no line leaves the executors.
    """
    invalid = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return "UTF-8" if invalid.isEmpty() else "ISO-8859-1"


def read_transactions(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    multi_line: bool = False,
    date_formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """Read a transaction CSV with a header row; columns are found by name, in any order that all files share.

    A file with another header is an error. Without `encoding` a log that is valid UTF-8 is scanned once more;
    name the encoding of a large log.

    Everything is read as text and typed by `conform`, so one odd value becomes null instead of
    changing the type of its column. Keep `multi_line` off unless descriptions hold line breaks:
    such files cannot be split between tasks.
    """
    raw = (
        spark.read.option("header", True)
        .option("encoding", encoding or choose_encoding(spark, path))
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .csv(path)
    )
    return conform(raw.select(*TRANSACTION_COLUMNS), date_formats)


REASONS = {
    "quotes": "a quote that is opened and not closed",
    "fields": "too many or too few fields",
    "CustomerID": "text that is no number of a customer",
    "InvoiceDate": "text that is no date in a known form",
    "Quantity": "text that is no quantity",
    "UnitPrice": "text that is no price",
}


def read_with_reasons(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    date_formats: Sequence[str] = DATE_FORMATS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """All lines of a transaction CSV, typed as in `read_transactions`, with Reason and Line.

    Reason names what is wrong with a line (see REASONS; the first that holds, in that order) and is null for a good
    one; Line is the text of a line that is not good, so that nothing of it is lost: as it stands in the file where its
    fields are at fault, its given values otherwise. A value that is missing is no fault. Files without a header
    row need the names of their `columns`.
    """
    options = {"encoding": encoding or choose_encoding(spark, path), "escape": '"', "multiLine": False}
    reader = spark.read.options(**options).option("header", columns is None)
    # only the first line is read for the names; all files must have the same
    names = list(columns or reader.csv(path).columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_line"]])
    raw = (
        reader.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line")
        # with fewer columns in use, the parser would not look at the others
        .option("columnPruning", False)
        .option("enforceSchema", columns is not None)
        .csv(path)
    )
    given = F.struct(*[F.col(f"`{c}`").alias(f"given_{c}") for c in TRANSACTION_COLUMNS])
    kept = raw.select(*TRANSACTION_COLUMNS, "_line", given.alias("_given"))
    typed = conform(kept, date_formats, keep=("_line", "_given"))
    open_quote = F.length(F.regexp_replace("_line", '[^"]', "")) % 2 == 1
    reason = F.when(F.col("_line").isNotNull(), F.when(open_quote, "quotes").otherwise("fields"))
    for name in list(REASONS)[2:]:
        present = F.trim(F.col(f"_given.given_{name}")) != ""
        reason = reason.when(present & F.col(name).isNull(), name)
    line = F.coalesce("_line", F.to_csv("_given", {"escape": '"'}))
    return typed.withColumn("Reason", reason).select(
        *TRANSACTION_COLUMNS, "Reason", F.when(F.col("Reason").isNotNull(), line).alias("Line")
    )


def quarantine(lines: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Good lines (the transaction columns) and bad ones (Reason, Line), both written by one scan of the log."""
    lines.withColumn("Bad", F.col("Reason").isNotNull()).write.mode("overwrite").partitionBy("Bad").parquet(path)
    schema = T.StructType([*lines.schema.fields, T.StructField("Bad", T.BooleanType())])
    written = lines.sparkSession.read.schema(schema).parquet(path)
    return written.filter("NOT Bad").select(*TRANSACTION_COLUMNS), written.filter("Bad").select("Reason", "Line")


def example_transactions(spark: SparkSession) -> DataFrame:
    """Five example rows that show the expected columns."""
    # The example data.
    rows = [
        ("536365", "85123A", "WHITE HANGING HEART T-LIGHT HOLDER", 6, "12/1/2010 8:26", "2.55", 17850, "United Kingdom"),
        ("536365", "71053", "WHITE METAL LANTERN", 6, "12/1/2010 8:26", "3.39", 17850, "United Kingdom"),
        ("536366", "84406B", "CREAM CUPID HEARTS COAT HANGER", 8, "12/1/2010 8:28", "2.75", 17851, "United Kingdom"),
        ("536367", "84029G", "KNITTED UNION FLAG HOT WATER BOTTLE", 6, "12/1/2010 8:34", "3.39", 13047, "United Kingdom"),
        ("536368", "84029E", "RED WOOLLY HOTTIE WHITE HEART", 6, "12/1/2010 8:34", "3.39", 13047, "United Kingdom"),
    ]
    return conform(
        spark.createDataFrame(
            rows,
            "InvoiceNo string, StockCode string, Description string, Quantity int, "
            "InvoiceDate string, UnitPrice string, CustomerID bigint, Country string",
        )
    )


STAR_SCHEMA = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_retailprice double",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
}


def star_schema_transactions(spark: SparkSession, directory: str) -> DataFrame:
    """The transaction relation of a lineitem/orders/customer/nation/part star schema in Parquet.

    Orders in status `P` become cancelled invoices (`C` before the number). No join is hinted:
    Spark broadcasts a dimension only while its size stays under the session's threshold, and
    otherwise sort-merges it, with adaptive skew splitting. The schemas are stated, so that no
    job reads footers first.
    """

    def table(name: str) -> DataFrame:
        return spark.read.schema(STAR_SCHEMA[name]).parquet(f"{directory}/{name}.parquet")

    # the join with orders deals lines by their order in any case; dealt first, they are not joined in a task per file
    lines = table("lineitem").repartition("l_orderkey")
    orders, customers = table("orders"), table("customer")
    nations, parts = table("nation"), table("part")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, customers.c_nationkey == nations.n_nationkey)
        .select(
            F.concat(
                F.when(F.col("o_orderstatus") == "P", "C").otherwise(""), F.col("o_orderkey").cast("string")
            ).alias("InvoiceNo"),
            F.col("l_partkey").cast("string").alias("StockCode"),
            F.col("p_name").alias("Description"),
            F.col("l_quantity").cast("int").alias("Quantity"),
            F.col("o_orderdate").alias("InvoiceDate"),
            F.col("p_retailprice").cast("decimal(12,4)").alias("UnitPrice"),
            F.col("o_custkey").alias("CustomerID"),
            F.col("n_name").alias("Country"),
        )
    )


def stage_transactions(tx: DataFrame, path: str) -> None:
    """Write the cleaned log once as Parquet by month, so that every analysis can start from it.

    The rebalance hint gathers each month into few files, and adaptive execution splits a month
    that holds much more than the others.
    """
    (
        tx.withColumn("InvoiceMonth", F.date_format("InvoiceDate", "yyyy-MM"))
        .hint("rebalance", "InvoiceMonth")
        .write.mode("overwrite")
        .partitionBy("InvoiceMonth")
        .parquet(path)
    )


def read_staged_transactions(spark: SparkSession, path: str) -> DataFrame:
    """The table written by `stage_transactions`; filters on InvoiceMonth prune directories."""
    return spark.read.parquet(path)
