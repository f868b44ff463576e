"""Similarity join of texts on five-word shingles by chosen paths.

Texts with equal words in equal order and spacing are one text with several copies. Each distinct text has a
fixed number of min-hashes of its shingles. Every run starts a tree: the texts that share the min-hash at a
sampled position go into one bucket, a large bucket is split again at positions sampled for its path, and small
buckets are compared by brute force on the min-hashes, with room for their error. Runs are repeated until a pair
at the threshold shares a small bucket with the target probability. A bucket that a split hardly shrinks holds
like texts and is linked whole. The components of these links are candidates only: within each one every two
texts are compared on their shingles themselves, in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.batches import add_columns, id_and_text, quoted, whole_text
from tallybook.llm.components import components, fewer_links
from tallybook.llm.shingles import Hasher, exact_ids
from tallybook.sources.staging import stage

# similarity of 4/5 as whole numbers, so that ties at the threshold are exact
SIMILARITY = (4, 5)
TARGET_RECALL = 0.999_99
HASHES = 64
SMALL = 200
PICKS = 2
BLOCK_TEXTS, BLOCK_BYTES = 500, 2_000_000


def runs_for(recall: float, similarity: float, picks: int = PICKS) -> int:
    """Runs after which a pair at the threshold is missed with less than 1 - recall, two splits deep."""
    survives = similarity * (1 - (1 - similarity) ** picks) ** 2
    return math.ceil(math.log(1 - recall) / math.log(1 - survives))


def text_key(docs: DataFrame):
    return F.unhex(F.md5(whole_text(docs).cast("binary")))


def _row_key(key: Column, doc_id: Column) -> Column:
    """Text and id of a row; a null id is like no number."""
    return F.concat(key, F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def _sketcher():
    random = np.random.default_rng(20)
    a = random.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
    b = random.integers(0, 1 << 63, HASHES, np.uint64)
    hasher = Hasher()

    def sketch(text: str) -> list[int] | None:
        h = hasher(text)
        if not len(h):
            return None
        best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(h), 4096):
            np.minimum(best, (h[i : i + 4096, None] * a + b).min(axis=0), out=best)
        return (best >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()

    return lambda texts: [[sketch(t) for t in texts], [len(t.encode()) for t in texts]]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """key, first (smallest id), copies, bytes, sketch of every distinct text with words."""
    rows = id_and_text(docs)
    keyed = rows.select("doc_id", text_key(rows).alias("key"), "text")
    sketched = add_columns(keyed, _sketcher, "sketch array<int>, bytes long", ["doc_id", "key"])
    return sketched.filter("sketch IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("first"),
        F.count(F.lit(1)).alias("copies"),
        F.max("bytes").alias("bytes"),
        F.first("sketch").alias("sketch"),
    )


def _match(sketches: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which texts agree in so many min-hashes that they may reach the threshold: four deviations below it."""
    p = SIMILARITY[0] / SIMILARITY[1]
    least = HASHES * p - 4 * math.sqrt(HASHES * p * (1 - p))
    return np.stack([(others == s).sum(axis=1) >= least for s in sketches])


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links from one member of each component of a symmetric matrix to its others."""
    free, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not free[start]:
            continue
        free[start], queue = False, [start]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(linked[i] & free)
            free[found] = False
            out += [(start, int(j)) for j in found]
            queue += found.tolist()
    return out


def _bucket_links(table: pa.Table) -> pa.Table:
    keys = table.column("key").to_pylist()
    sketches = np.array(table.column("sketch").to_pylist(), np.int32)
    links = _forest(_match(sketches, sketches))
    return pa.table(
        {"a": pa.array([keys[i] for i, _ in links], pa.binary()), "b": pa.array([keys[j] for _, j in links], pa.binary())}
    )


def candidate_links(texts: DataFrame, runs: int) -> DataFrame:
    """Links (a, b) between distinct texts whose components hold every pair at the threshold, with the recall of `runs`."""
    positions = np.random.default_rng(runs).integers(0, HASHES, runs)
    roots = [
        F.xxhash64(F.lit(run), F.lit(int(i)), F.col("sketch")[int(i)]) for run, i in enumerate(positions)
    ]
    rows = texts.select("key", F.explode(F.array(*roots)).alias("path"), F.lit(None).cast("long").alias("parent"))
    sketches = texts.select("key", "sketch")
    small, dense = None, None
    while True:
        rows = stage(rows)
        sizes = rows.groupBy("path").agg(
            F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent"), F.min("key").alias("centre")
        )
        sizes = stage(sizes.filter("n > 1"))
        few = rows.join(sizes.filter(F.col("n") <= SMALL).select("path"), "path").select("path", "key")
        small = few if small is None else small.union(few)
        large = sizes.filter(F.col("n") > SMALL)
        if large.isEmpty():
            break
        # a bucket of more than half its parent's texts holds like texts: more splits would not part them
        like = F.coalesce(2 * F.col("n") > F.col("parent"), F.lit(False))
        star = rows.join(large.filter(like).select("path", "centre"), "path").select(
            F.col("centre").alias("a"), F.col("key").alias("b")
        )
        dense = star if dense is None else dense.union(star)
        again = rows.join(large.filter(~like).select("path", "n"), "path").join(sketches, "key")
        # the sampled positions depend on the path alone, so that all texts of a bucket use the same
        picks = F.array(
            *[F.pmod(F.xxhash64("path", F.lit(k)), F.lit(HASHES)).cast("int") for k in range(PICKS)]
        )
        rows = again.select("key", F.col("n").alias("parent"), "path", "sketch", F.explode(picks).alias("i")).select(
            "key", F.xxhash64("path", "i", F.get("sketch", F.col("i"))).alias("path"), "parent"
        )
    # many runs find the same bucket: it is compared once
    buckets = small.groupBy("path").agg(F.sort_array(F.collect_set("key")).alias("keys")).select("keys").distinct()
    members = buckets.filter(F.size("keys") > 1).select(F.xxhash64("keys").alias("bucket"), F.explode("keys").alias("key"))
    links = (
        members.join(sketches, "key").groupBy("bucket").applyInArrow(_bucket_links, "a binary, b binary")
    )
    return links if dense is None else links.union(dense)


def _verified(table: pa.Table) -> pa.Table:
    """Exact links within a block, or between two: per text the copies it is linked to, and a spanning forest."""
    keys, blocks = table.column("key").to_pylist(), np.array(table.column("block").to_pylist())
    copies = np.array(table.column("copies").to_pylist(), np.int64)
    sets = [np.unique(ids) for ids in exact_ids(table.column("text").to_pylist())]
    sizes = np.array([len(s) for s in sets], np.int64)
    shared, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = shared[counts > 1]
    both = np.zeros((len(keys), len(keys)), np.float32)
    rows = np.repeat(np.arange(len(sets)), sizes)
    columns = np.concatenate(sets)
    held = np.isin(columns, shared, assume_unique=False)
    rows, columns = rows[held], np.searchsorted(shared, columns[held])
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for start in range(0, len(shared), 4096):
        low, high = np.searchsorted(columns, [start, start + 4096])
        part = np.zeros((len(keys), 4096), np.float32)
        part[rows[low:high], columns[low:high] - start] = 1
        both += part @ part.T
    both = np.rint(both).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    linked = both * SIMILARITY[1] >= union * SIMILARITY[0]
    np.fill_diagonal(linked, False)
    if blocks.min() != blocks.max():
        # pairs within one block are compared by that block's own task
        linked &= blocks[:, None] != blocks[None, :]
    forest = _forest(linked)
    return pa.table(
        {
            "a": pa.array(keys + [keys[i] for i, _ in forest], pa.binary()),
            "b": pa.array([None] * len(keys) + [keys[j] for _, j in forest], pa.binary()),
            "links": pa.array((linked @ copies).tolist() + [0] * len(forest), pa.int64()),
        }
    )


def verified_links(docs: DataFrame, texts: DataFrame, clusters: DataFrame) -> DataFrame:
    """a, b, links: the links of every text (b null), and links that span the components of the exact relation."""
    members = clusters.join(texts.select("key", "first", "copies", "bytes"), clusters["node"] == texts["key"]).select(
        "key", "first", "copies", "bytes", F.col("root").alias("cluster")
    )
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    placed = members.join(sizes, "cluster").select(
        _row_key(F.col("key"), F.col("first")).alias("row"),
        "copies",
        "cluster",
        "blocks",
        F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"),
    )
    rows = id_and_text(docs)
    keyed = rows.select(text_key(rows).alias("key"), "doc_id", "text")
    # one row of each text, told by its id: its copies lie in many partitions and do not come to one task. The same
    # join at every size: a broadcast of small components saved a shuffle on small inputs only
    texts_of = (
        keyed.withColumn("row", _row_key(F.col("key"), F.col("doc_id")))
        .join(placed.hint("merge"), "row")
        .dropDuplicates(["row"])
        .select("cluster", "block", "key", "copies", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    )
    return (
        texts_of.withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .groupBy("cluster", "low", "high")
        .applyInArrow(_verified, "a binary, b binary, links long")
    )


def _classes(docs: DataFrame, recall: float) -> DataFrame:
    """key, root, links, copies, first of every distinct text with words; staged."""
    texts = stage(distinct_texts(docs))
    found = candidate_links(texts, runs_for(recall, SIMILARITY[0] / SIMILARITY[1]))
    verified = stage(verified_links(docs, texts, components(fewer_links(found))))
    roots = components(verified.filter("b IS NOT NULL"))
    links = verified.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    return stage(
        texts.select("key", "first", "copies")
        .join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
        .join(links, "key", "left")
        .select(
            "key",
            "first",
            "copies",
            F.coalesce("root", "key").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )


def join(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, n_links, class_size for every row.

    Two rows are linked when the Jaccard similarity of their sets of five-word shingles is at least 0.8 (ties
    count); classes are the components of the links, named by their smallest doc_id. `n_links` counts the other
    rows linked to this one, copies included. A text of fewer than five words is one shingle. Null, empty and
    blank texts have none and stay in classes of their own. Repeated rows count as copies, null ids are kept, other
    columns are not read.
    """
    texts = _classes(docs, recall)
    classes = texts.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("key"))
    found = rows.join(texts.join(classes, "root").select("key", "class_id", "class_size", "links"), "key", "left")
    return found.select(
        "doc_id",
        # a class may consist of rows without ids
        F.when(F.col("links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def keep_one_per_class(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """One row of each class, the one of the smallest id, with all its columns; rows without words stay."""
    texts = _classes(docs, recall)
    order = F.struct(F.col("first").isNull().alias("unnamed"), "first", "key")
    chosen = texts.groupBy("root").agg(F.min(order).alias("one")).select(F.col("one.key").alias("key"), F.lit(True).alias("stays"))
    fate = texts.join(chosen, "key", "left").select("key", F.col("first").alias("of"), F.coalesce("stays", F.lit(False)).alias("stays"))
    rows = docs.select(
        F.struct(*[docs[c] for c in quoted(docs.columns)]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(docs).alias("key"),
    )
    kept = rows.join(fate, "key", "left").filter(
        F.col("stays").isNull() | (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("of")))
    )
    # of rows that repeat text and id one stays; a text without words has no class and is never a repeat
    repeat = kept.withColumn("single", F.when(F.col("stays").isNull(), F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy("key", "doc_id", "single").orderBy("key"))
    return repeat.withColumn("place", place).filter("place = 1").select("row.*")
