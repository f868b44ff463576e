"""Tables written once to the folder that all executors share, for results that a job reads several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path under `spark.checkpoint.dir`.

    Where the setting is missing, a local session gets a temporary folder; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallybook-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


# a setting of Spark: whether the shuffle files of a query go once it has run
CLEANS_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame) -> DataFrame:
    """Write a table and read it back: later steps start from files, not from its whole lineage.

    Losing an executor then costs no recomputation, and the files' size tells the optimizer which
    joins may be broadcast. The files stay until the shared folder is emptied; the shuffle files
    behind them go at once, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(CLEANS_UP)
    spark.conf.set(CLEANS_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANS_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later step reads."""
    for df in tables:
        files = df.inputFiles()
        if files:
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
