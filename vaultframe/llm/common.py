"""What the training-data operators share: the tables' folder, scratch tables, Arrow batches.

Scratch tables replace lineage cuts: an operator that needs an intermediate result
twice writes it once as Parquet under the cluster's ``spark.checkpoint.dir``, so a lost
executor costs the re-run of single tasks and never the whole chain.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultframe.sources.scratch import clear as clear_scratch
from vaultframe.sources.scratch import discard, shared_dir, written

__all__ = ["LOWER", "SPACES", "TEXT_ROWS", "as_bytes", "clear_scratch", "discard", "releasing", "shared_dir", "slices", "table", "two_level_position", "with_batches", "written"]

#: Rows of an Arrow batch of whole texts, where the operator runs the job itself. Batches lie
#: outside the JVM's heap, twice while they grow.
TEXT_ROWS = 1000
#: Bytes that separate words; identical for bytes.split() without an argument.
SPACES = b" \t\n\x0b\x0c\r"
#: A-Z to a-z on UTF-8 bytes; every other byte, so every other character, stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_batches(df: DataFrame, read: str, fn: Callable[[list], Sequence[pa.Array]], fields: Sequence[T.StructField]) -> DataFrame:
    """All columns of ``df`` and the columns that ``fn`` makes of column ``read``, batch by batch.

    ``fn`` gets a string column as UTF-8 bytes. A column of ``df`` that has one of the new
    names is replaced.
    """
    fields = list(fields)
    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`") for c in keep])
    if read not in keep:
        raise ValueError(f"no column {read}")
    at = keep.index(read)
    schema = T.StructType([*source.schema.fields, *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(at)
            if pa.types.is_string(cells.type) or pa.types.is_large_string(cells.type):
                cells = cells.view(pa.binary() if pa.types.is_string(cells.type) else pa.large_binary())
            made = [fn(cells.slice(i, 1000).to_pylist()) for i in range(0, max(1, len(cells)), 1000)]
            new = made[0] if len(made) == 1 else [pa.concat_arrays(c) for c in zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return source.mapInArrow(releasing(run), schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that what is made of one part is gone before the next."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def release() -> None:
    """Freed memory of this worker goes back to the system, where the C library can do it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and what it freed is released at a task's end: workers wait for later tasks
    beside their executor, and what they keep counts with it."""
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return released


def as_bytes(column: str = "text") -> F.Column:
    return F.col(column).cast("string").cast("binary")


def two_level_position(df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[F.Column], size: F.Column, start: str, index: str | None = None) -> DataFrame:
    """``start``: the sum of ``size`` over the rows before this one in its group.

    Rows of a group are ordered by ``bucket``, then by ``order``. Only one bucket of one
    group is ever sorted in one task; the buckets' totals, one row each, carry the sums on.
    ``index``, if named, is the number of the row within its group.
    """
    from pyspark.sql import Window as W

    keys = [*groups, bucket]
    inner = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sized = df.withColumn("_size", size)
    if not groups:
        sized, groups, keys = sized.withColumn("_all", F.lit(0)), ["_all"], ["_all", bucket]
        inner = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = sized.groupBy(*keys).agg(F.sum("_size").alias("_t"), F.count(F.lit(1)).alias("_n"))
    outer = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_base"), F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_nbase"))
    rows = sized.withColumn("_in", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    if index:
        rows = rows.withColumn("_i", F.coalesce(F.count(F.lit(1)).over(inner), F.lit(0)))
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    out = rows.join(bases, on, "left").withColumn(start, F.col("_base") + F.col("_in"))
    if index:
        out = out.withColumn(index, F.col("_nbase") + F.col("_i"))
    return out.drop("_size", "_in", "_i", "_base", "_nbase", "_all", *[f"_k{i}" for i in range(len(keys))])
