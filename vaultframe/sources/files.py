"""File listings, packs and JSON records from any store that Spark reads; a local source."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from vaultframe.schemas import SOURCE_ENTRIES


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path, name, size, last_write`` of the files below ``path``; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("last_write"))


def packs(spark: SparkSession, root: str) -> DataFrame:
    """``pack_id, content, sha256`` of the pack files of a repository."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pack").load(f"{root}/data")
    return rows.select(F.regexp_extract("path", r"([^/]+)\.pack$", 1).alias("pack_id"), "content", F.sha2("content", 256).alias("sha256"))


def json_record(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records of JSON files; what can't be parsed gives a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def partitions(self) -> list[_Part]:
        """The root's own entries, and each of its directories as one partition."""
        below = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [_Part(self.root), *map(_Part, below)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import datetime

        stack = [partition.path]
        while stack:
            for e in sorted(os.scandir(stack.pop()), key=lambda e: e.name):
                s, link = e.stat(follow_symlinks=False), e.is_symlink()
                folder = e.is_dir(follow_symlinks=False)
                yield e.path, e.name, folder, 0 if folder else s.st_size, datetime.datetime.fromtimestamp(s.st_mtime, datetime.UTC), 0x10 if folder else 0x20, link, False
                if folder and partition.path != self.root:
                    stack.append(e.path)


class FileTree(DataSource):
    """``spark.read.format("filetree").load(path)``: entries of a folder that every executor
    mounts; links are listed and not followed."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> StructType:
        return SOURCE_ENTRIES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TreeReader(self.options)


def tree(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").load(path)
