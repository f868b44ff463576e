"""Helpers shared by the operators of this package: Arrow batches in, columns out."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# texts handled together inside a task: a bound on memory, never on the rows handled
SLICE_BYTES = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that most operators need, so that no other column can clash; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(docs).alias("text"))


def whole_text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def id_digest(doc_id: Column) -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose texts stay within `size` bytes, but for single texts above it."""
    for batch in batches:
        start, held_bytes = 0, 0
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
        for i, n in enumerate(lengths):
            if held_bytes and held_bytes + (n or 0) > size:
                yield batch.slice(start, i - start)
                start, held_bytes = i, 0
            held_bytes += n or 0
        if start < len(lengths):
            yield batch.slice(start)


def add_columns(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list[list]]],
    schema: str,
    keep: list[str],
    text: str = "text",
) -> DataFrame:
    """The columns `keep` of every row, and the columns of `schema` computed from its text.

    `make` runs once per task and gives the function from a list of texts to a list of columns.
    """
    added = _parse_datatype_string(schema)
    out = to_arrow_schema(StructType([df.schema[c] for c in keep] + list(added)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in slices(batches, text):
            columns = compute(batch.column(batch.schema.get_field_index(text)).to_pylist())
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [pa.array(c, type=out.field(len(keep) + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(
                [k.cast(out.field(i).type) for i, k in enumerate(kept)] + made, schema=out
            )

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, StructType([df.schema[c] for c in keep] + list(added)))


_held: list = [None, None]


def held(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, kept by the worker for all tasks of one operator.

    Workers outlive a job, so only one operator's tables are held: another key frees them.
    """
    if _held[0] != key:
        _held[:] = None, None
        # before the new tables grow
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[:] = key, make()
    return _held[1]


def quoted(names: Iterable[str]) -> list[str]:
    """Names of columns as they can be looked up, whatever characters they have."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


class Memo(dict):
    """Values by key, computed for all missing keys at once; emptied when it would grow past `limit` entries.

    The limit bounds a worker's memory; a key that returns later is computed again, with the same value. Only the
    keys of one call may exceed it, and these come from one slice of texts.
    """

    def __init__(self, compute: Callable[[list], list], limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def learn(self, keys: Iterable) -> None:
        wanted = set(keys)
        missing = [k for k in wanted if k not in self]
        if missing and len(self) + len(missing) > self.limit:
            self.clear()
            missing = list(wanted)
        if missing:
            # the collector would walk over all entries again and again; none of them form cycles
            collects = gc.isenabled()
            gc.disable()
            try:
                self.update(zip(missing, self.compute(missing), strict=True))
            finally:
                if collects:
                    gc.enable()
