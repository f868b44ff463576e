"""K-means segments of customers by recency, frequency and spend."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.constants import RFM_METRICS
from tallybook.operators import rfm as ops
from tallybook.sources.staging import stage


MOST_ROUNDS = 300
# the scaled metrics have variance 1: centres that move by less than this are at rest
AT_REST = 0.01


def scaled_vectors(customers: DataFrame) -> DataFrame:
    """Customers with their scaled metrics as a vector; staged, because k-means reads them many times."""
    assembler = VectorAssembler(inputCols=[f"{c}_Scaled" for c in RFM_METRICS], outputCol="features")
    return assembler.transform(stage(ops.scale(customers)))


def _k_means(k: int, seed: int, most_rounds: int, at_rest: float) -> KMeans:
    return KMeans(k=k, seed=seed, maxIter=most_rounds, tol=at_rest, featuresCol="features", predictionCol="Cluster")


def elbow(
    customers: DataFrame,
    largest_k: int = 10,
    seed: int = 42,
    parallelism: int = 4,
    most_rounds: int = MOST_ROUNDS,
    at_rest: float = AT_REST,
) -> DataFrame:
    """Sum of squared distances to the nearest centre for 1 to `largest_k` clusters.

    The fits do not depend on each other: `parallelism` of them run at the same time.
    """
    spark = customers.sparkSession
    vectors = scaled_vectors(customers)

    @inheritable_thread_target(spark)
    def inertia(k: int) -> tuple[int, float]:
        return k, _k_means(k, seed, most_rounds, at_rest).fit(vectors).summary.trainingCost

    squares = sum(F.var_pop(f"{c}_Scaled") for c in RFM_METRICS) * F.count(F.lit(1))
    rows = [(1, vectors.agg(squares).first()[0])]
    with ThreadPool(parallelism) as pool:
        rows += pool.map(inertia, range(2, largest_k + 1))
    return spark.createDataFrame(rows, "k int, inertia double")


def cluster(
    customers: DataFrame, k: int = 4, seed: int = 42, most_rounds: int = MOST_ROUNDS, at_rest: float = AT_REST
) -> DataFrame:
    """Customers with their Cluster."""
    vectors = scaled_vectors(customers)
    return _k_means(k, seed, most_rounds, at_rest).fit(vectors).transform(vectors).select("CustomerID", *RFM_METRICS, "Cluster")


def segment(tx: DataFrame, k: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(customers with Cluster and Segment, one profile row per segment)."""
    clustered = cluster(ops.rfm(tx), k, seed)
    profile = ops.name_clusters(ops.cluster_profile(clustered))
    return ops.assign_segments(clustered, profile), profile
