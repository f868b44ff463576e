"""Approximate nearest neighbours by inner product with shifted space-filling curves.

Vectors are put on the unit sphere, with one more component that makes up for shorter ones, and projected to a few
random directions. A randomly shifted Hilbert curve orders the projections; several such orders are made, and
Spark range-partitions and numbers the rows of each. A query is compared with the rows within a window of its
place in every order, the windows are merged, and the nearest are ranked by the exact product. A bounded sample
of queries, held against all rows, tells how wide the window must be for the target recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.sources.staging import stage

ORDERS = 16
DIRECTIONS, BITS = 8, 7
TARGET_RECALL = 0.96
SAMPLE_QUERIES = 96
BLOCK = 4096
NEIGHBOURS = 20
EVERY = 20


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of rows of cell numbers below 2**bits (columns times bits: at most 63)."""
    x = cells.T.astype(np.int64).copy()
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for row in x:
            turned = (row & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(turned, low, swap)
            row ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> level & 1)
    return key


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists(v, lambda x: x != 0)
    )
    return rows.select("vec_id", "v")


def _as_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _curves(dimensions: int):
    random = np.random.default_rng(11)
    directions = random.normal(size=(ORDERS, dimensions + 1, DIRECTIONS))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    shifts = random.uniform(0, 0.5, (ORDERS, DIRECTIONS))
    return directions, shifts


def _places(rows: DataFrame, dimensions: int, longest: float) -> DataFrame:
    """uid, asks, ordering, key: every distinct vector's place on each curve, and that of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, shifts = _curves(dimensions)
        reach = 3.5 / math.sqrt(dimensions + 1)
        for batch in batches:
            v, uid = _as_matrix(batch.column(1)), np.asarray(batch.column(0))
            norms = np.linalg.norm(v, axis=1)
            asks = np.asarray(batch.column(2).to_pylist(), bool)
            rest = np.sqrt(np.maximum(0, 1 - (norms / longest) ** 2))
            found = np.column_stack([v / longest, rest])
            asked = np.column_stack([v / norms[:, None], np.zeros(len(v))])[asks]
            for points, ids, query in ((found, uid, False), (asked, uid[asks], True)):
                for k in range(ORDERS):
                    unit = np.clip(points @ directions[k] / reach, -1, 1) / 4 + 0.25 + shifts[k]
                    key = hilbert(np.minimum(unit * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)
                    n = len(key)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids), pa.array([query] * n, pa.bool_()), pa.array([k] * n, pa.int32()), pa.array(key)],
                        names=["uid", "asks", "ordering", "key"],
                    )

    return rows.select("uid", "v", "asks").mapInArrow(run, "uid long, asks boolean, ordering int, key long")


def _numbered(places: DataFrame) -> DataFrame:
    """The same rows with their position; range partitions are sorted apart and counted, then offset."""
    columns = ["ordering", "key", "uid", "asks"]
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stage(
        places.repartitionByRange(n, *columns)
        .sortWithinPartitions(*columns)
        .select(*columns, F.monotonically_increasing_id().alias("at"))
    ).withColumn("part", F.shiftright("at", 33))
    # one row for each partition
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    mask = (1 << 33) - 1
    return ordered.join(offsets, "part").select(
        "uid", "asks", "ordering", (F.col("before") + F.col("at").bitwiseAND(F.lit(mask))).alias("position")
    )


def _nearest(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in any order."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def _compare(queries: np.ndarray, ids: np.ndarray, v: np.ndarray, uid: np.ndarray, k: int) -> pa.Table:
    """The k nearest rows of each query, each product summed for its pair alone, the same wherever the pair meets."""
    chosen = _nearest(queries @ v.T, k)
    scores = np.stack([(v[c] * q).sum(axis=1) for q, c in zip(queries, chosen, strict=True)])
    return pa.table({"query": np.repeat(ids, chosen.shape[1]), "uid": uid[chosen].ravel(), "score": scores.ravel()})


def _search_block(k: int):
    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks").to_pylist(), bool)
        uid, v = np.asarray(table.column("uid")), _as_matrix(table.column("v"))
        if asks.all() or not asks.any():
            return pa.table({"query": pa.array([], pa.int64()), "uid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return _compare(v[asks], uid[asks], v[~asks], uid[~asks], k)

    return run


def _window(distinct: DataFrame, positions: DataFrame, k: int, recall: float) -> int:
    """Positions to either side that reach the recall on a bounded sample of queries."""
    sample = (
        distinct.filter("asks").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE_QUERIES).select("uid", "v").collect()
    )
    if not sample:
        return k
    ids, queries = np.array([r["uid"] for r in sample]), np.array([r["v"] for r in sample])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _compare(queries, ids, _as_matrix(batch.column(1)), np.asarray(batch.column(0)), k).to_batches()

    best = Window.partitionBy("query").orderBy(F.desc("score"), "uid")
    truth = (
        distinct.select("uid", "v")
        .mapInArrow(brute, "query long, uid long, score double")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )
    asked = positions.filter("asks").select(F.col("uid").alias("query"), "ordering", F.col("position").alias("from"))
    found = positions.filter("NOT asks").select("uid", "ordering", "position")
    gaps = (
        truth.select("query", "uid")
        .join(found, "uid")
        .join(asked, ["query", "ordering"])
        .groupBy("query", "uid")
        .agg(F.min(F.abs(F.col("position") - F.col("from"))).alias("gap"))
        .collect()  # at most SAMPLE_QUERIES * k rows
    )
    return max(k, int(np.quantile([r["gap"] for r in gaps], recall)) + 1)


def search(
    vectors: DataFrame, asked: Column | None = None, k: int = NEIGHBOURS, recall: float = TARGET_RECALL
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row for which `asked` holds.

    The measure is the inner product in double precision; ties go to the smaller vec_id. Rows without an id, null
    and zero vectors, and vectors that hold a null or a value that is not finite take no part; of unlike lengths the
    commonest takes part (ties: the longest). Rows that repeat an id and its vector count once. Equal vectors are
    searched once, and only their k + 1 smallest ids can be in any answer. An empty table gives no rows.
    """
    asked = (F.col("vec_id") % EVERY == 0) if asked is None else asked
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimensions = lengths["size"]
    # adding 0.0 makes both zeros equal
    rows = stage(
        rows.filter(F.size("v") == dimensions)
        .withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
        .withColumn("asks", asked)
        .withColumn("group", F.unhex(F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"))))
        .dropDuplicates(["vec_id", "group"])
    )
    place = Window.partitionBy("group").orderBy("vec_id")
    smallest = rows.select("group", "vec_id").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1)
    ids = stage(smallest.groupBy("group").agg(F.min("vec_id").alias("uid"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asking = rows.groupBy("group").agg(F.max("asks").alias("asks"))
    distinct = stage(
        ids.join(asking, "group")
        .join(rows.select("group", "vec_id", "v"), "group")
        .filter("uid = vec_id")
        .select("group", F.xxhash64("group").alias("uid"), "v", "asks", "ids")
    )
    longest = distinct.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    positions = stage(_numbered(stage(_places(distinct, dimensions, longest * (1 + 1e-12)))))
    width = _window(distinct, positions, k, recall)
    block = min(width, BLOCK)
    reach = math.ceil(width / block)
    mine = F.floor(F.col("position") / block).cast("long")
    near = positions.withColumn(
        "block",
        F.explode(F.when(F.col("asks"), F.sequence(mine - reach, mine + reach)).otherwise(F.array(mine))),
    ).select("ordering", "block", "uid", "asks")
    found = (
        near.join(distinct.select("uid", "v"), "uid")
        .groupBy("ordering", "block")
        .applyInArrow(_search_block(k + 1), "query long, uid long, score double")
        .groupBy("query", "uid")
        .agg(F.max("score").alias("score"))
    )
    # k + 1 groups hold as many rows, and one of them may be the query's own
    groups = found.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).filter(
        F.col("place") <= k + 1
    )
    by_row = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    nearest = (
        groups.join(distinct.select("uid", F.explode("ids").alias("vec_id")), "uid")
        .withColumn("place", F.row_number().over(by_row))
        .filter(F.col("place") <= k + 1)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("nearest"))
    )
    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.xxhash64("group").alias("query"))
    # the answer of a group without the query itself
    answers = queries.join(nearest, "query").select(
        "query_id",
        F.posexplode(F.slice(F.filter("nearest", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("rank", "near"),
    )
    return answers.select("query_id", (F.col("rank") + 1).alias("rank"), "near.vec_id", "near.score")
