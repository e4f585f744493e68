"""The catalog's eight tables as versioned Parquet folders, for one or many repositories.

Plain Parquet has no UPDATE or DELETE. A change writes the table's next version beside the
old one, then moves a pointer; readers follow the pointer, so they see the old table or the
new one. Old versions go last.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.schemas import CATALOG, KEYS


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._path(self.root))

    def version(self, table: str) -> int:
        """0 if the table was never written. The pointer is the greatest ``_v<n>`` marker."""
        top = self._path(f"{self.root}/{table}")
        if not self._fs.exists(top):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return max((int(n[2:]) for n in names if n.startswith("_v")), default=0)

    def read(self, table: str) -> DataFrame:
        schema = CATALOG[table]
        if not (v := self.version(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/v{v}")

    def replace(self, table: str, rows: DataFrame) -> int:
        """Writes the next version and moves the pointer; returns its number."""
        schema, v = CATALOG[table], self.version(table) + 1
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        typed.write.mode("overwrite").parquet(f"{self.root}/{table}/v{v}")
        self._fs.create(self._path(f"{self.root}/{table}/_v{v}"), True).close()
        for old in range(1, v - 1):  # a reader may still be on the version before
            self._fs.delete(self._path(f"{self.root}/{table}/v{old}"), True)
            self._fs.delete(self._path(f"{self.root}/{table}/_v{old}"), True)
        return v

    def append(self, table: str, rows: DataFrame) -> int:
        return self.replace(table, self.read(table).unionByName(rows, allowMissingColumns=True))

    def upsert(self, table: str, rows: DataFrame) -> int:
        """Rows of the same key are replaced, others added."""
        key = KEYS[table]
        return self.replace(table, self.read(table).join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True))

    def delete(self, table: str, gone: DataFrame) -> int:
        """Deletes by key; a pack takes its blobs along, a snapshot its paths, a job its logs."""
        key = KEYS[table]
        below = {"packs": "blobs", "snapshots": "snapshot_paths", "jobs": "job_logs"}.get(table)
        v = self.replace(table, self.read(table).join(gone.select(key), key, "left_anti"))
        if below and self.version(below):
            self.replace(below, self.read(below).join(gone.select(key), key, "left_anti"))
        return v

    def audit(self, action: str, details: str | None, at: str, actor: str = "system") -> int:
        top = self.read("audit_logs").agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
        row = top.select((F.col("m") + 1).alias("id"), F.lit(at).cast("timestamp_ntz").alias("timestamp"), F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.lit(details).cast("string").alias("details"))
        return self.append("audit_logs", row)


def across(spark: SparkSession, roots: Mapping[str, str], table: str) -> DataFrame:
    """One table of all repositories (name -> folder) with ``repo``; missing ones are skipped."""
    out = spark.createDataFrame([], CATALOG[table]).withColumn("repo", F.lit(""))
    for name, root in roots.items():
        catalog = Catalog(spark, root)
        if catalog.exists():
            out = out.unionByName(catalog.read(table).withColumn("repo", F.lit(name)))
    return out
