"""Intermediate tables in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="vaultframe-")
    return f"file://{_local[app]}"


def _folder(spark: SparkSession) -> str:
    """Each application has a folder of its own below the shared one, and so has each scope."""
    return "/".join([shared_dir(spark), "vaultframe", spark.sparkContext.applicationId, *_scopes.get()])


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows that pass to and from Python at a time, where the session says so.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files go when the job that made them is done, not when the driver collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Files that a task keeps open, so rows of few kinds are parted without a sort.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def written(df: DataFrame, name: str, batch_rows: int | None = None, path: str | None = None, kinds: str | None = None, codec: str = "zstd") -> DataFrame:
    """The rows of ``df`` as a table in the shared folder, read back with the same schema.

    It cuts the lineage: a lost executor costs single tasks, not the chain before.
    ``batch_rows`` bounds Arrow batches while it is written, for rows that are large.
    ``path``: a place other than the present scope's. ``kinds``: a column of few values; each
    is stored apart, so a reader of one doesn't see the others. ``codec``: hashes don't get
    smaller, so for tables of them a faster one does.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    before = {k: spark.conf.get(k) for k in (BATCH_ROWS, SHUFFLES_GO, WRITERS)}
    try:
        spark.conf.set(SHUFFLES_GO, "true")
        if batch_rows:
            now = int(before[BATCH_ROWS])
            spark.conf.set(BATCH_ROWS, min(batch_rows, now) if now > 0 else batch_rows)
        writer = df.write.option("compression", codec)
        if kinds:
            spark.conf.set(WRITERS, "4")
            writer = writer.partitionBy(kinds)
        writer.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Deletes a table that ``written`` gave, once all that is made of it is written too."""
    _delete(table.sparkSession, table.scratch_path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; write what is to stay outside of it."""
    token = _scopes.set((*_scopes.get(), uuid.uuid4().hex))
    try:
        yield
    finally:
        path = _folder(spark)
        _scopes.reset(token)
        _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes the scratch tables of this application alone; call it when results are stored."""
    _delete(spark, _folder(spark))
