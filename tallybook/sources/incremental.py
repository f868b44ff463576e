"""A cleaned log kept by month, refreshed only where it changed, and tables by month derived from it.

A store is a folder with two tables: `months`, the rows by InvoiceMonth, and `manifest`, which holds for each version
the months, their number of rows and their checksums. A refresh compares the checksums of the log with the latest
version, overwrites the months that differ, and then appends a version. When it is lost on the way, the next one finds
the same months changed and writes them again. Lines without a date make up a month of their own, with the name "".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "InvoiceMonth"
MANIFEST = f"Version bigint, {MONTH} string, Lines bigint, Sum decimal(38,0), Mix bigint"
_SAME = ["Lines", "Sum", "Mix"]


def _month() -> Column:
    return F.coalesce(F.date_format("InvoiceDate", "yyyy-MM"), F.lit(""))


def checksums(by_month: DataFrame) -> DataFrame:
    """One row per month: rows, and two sums over the rows' digests that do not depend on their order.

    A repeated row changes the sum, where the exclusive or alone would cancel it.
    """
    columns = [c for c in by_month.columns if c != MONTH]
    return by_month.groupBy(MONTH).agg(
        F.count(F.lit(1)).alias("Lines"),
        F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("decimal(38,0)").alias("Sum"),
        F.bit_xor(F.xxhash64(F.lit("second"), *columns)).alias("Mix"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The months of the latest version of a store; no rows before the first."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    versions = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    latest = versions.agg(F.max("Version")).first()[0]
    return versions.filter(F.col("Version") == latest)


def _write(rows: DataFrame, sums: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """Overwrite the months of `rows` whose checksums differ from the known ones, and append a version."""
    spark = rows.sparkSession
    latest = known.agg(F.max("Version")).first()[0]
    old = known.filter(f"{MONTH} IS NOT NULL").select(MONTH, *[F.col(c).alias(f"Old{c}") for c in _SAME])
    compared = sums.join(old, MONTH, "full").select(
        MONTH, *_SAME, F.col("OldLines").isNotNull().alias("Known"),
        F.coalesce(F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"Old{c}")) for c in _SAME]), lambda same: same), F.lit(False)).alias("Same"),
    )
    # one row per month of the log
    months = compared.collect()
    changed = [m[MONTH] for m in months if m["Lines"] is not None and not m["Same"]]
    if changed:
        (
            rows.filter(F.col(MONTH).isin(changed))
            .hint("rebalance", MONTH)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(MONTH)
            .parquet(f"{path}/months")
        )
    version = 0 if latest is None else latest + 1
    if changed or len(months) != sum(1 for m in months if m["Same"]):
        held = [(version, m[MONTH], *[m[c] for c in _SAME]) for m in months if m["Lines"] is not None]
        # a version without months still has a row, which has no lines
        held = held or [(version, None, 0, None, None)]
        spark.createDataFrame(held, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")

    def what(m) -> str:
        return "gone" if m["Lines"] is None else "same" if m["Same"] else "changed" if m["Known"] else "new"

    return spark.createDataFrame([(m[MONTH], m["Lines"], what(m)) for m in months], f"{MONTH} string, Lines bigint, State string")


def refresh(tx: DataFrame, path: str) -> DataFrame:
    """Bring a store up to a log. One row per month: InvoiceMonth, Lines, State (new, changed, same or gone).

    The whole log is read for its checksums, of which one row per month is shuffled; only months that
    changed are shuffled and written. A month that is gone leaves the manifest, and readers no longer see it.
    """
    by_month = tx.withColumn(MONTH, _month())
    return _write(by_month, checksums(by_month), manifest(tx.sparkSession, path), path)


def read(spark: SparkSession, path: str, months: DataFrame | None = None) -> DataFrame:
    """The rows of a store, or of some of its months; other months are pruned by their folders."""
    wanted = manifest(spark, path) if months is None else months
    names = [r[MONTH] for r in wanted.filter(f"{MONTH} IS NOT NULL").select(MONTH).collect()]
    rows = spark.read.option("basePath", f"{path}/months").parquet(f"{path}/months")
    # the folder's own name for an empty value reads back as null, and names of months as text
    month = F.coalesce(F.col(MONTH).cast("string"), F.lit(""))
    given = F.col(MONTH).isin([n for n in names if n])
    return rows.filter(given | F.col(MONTH).isNull() if "" in names else given).withColumn(MONTH, month)


def refresh_derived(spark: SparkSession, source: str, path: str, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bring a derived store up to its source: `derive` runs on the rows of changed months alone.

    It must keep InvoiceMonth and make no row from two months. The derived manifest holds the checksums of the source
    it was made from. Returns the state of each month.
    """
    now, known = manifest(spark, source), manifest(spark, path)
    held = now.filter(f"{MONTH} IS NOT NULL")
    same = held.join(known.select(MONTH, *_SAME), [MONTH, *_SAME], "left_semi").select(MONTH)
    changed = held.join(same, MONTH, "left_anti")
    if not _exists(spark, f"{source}/months"):
        raise ValueError("the source has no months yet")
    made = derive(read(spark, source, changed))
    return _write(made, held.select(MONTH, *_SAME), known, path)
