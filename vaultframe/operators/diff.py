"""Comparing versions of a file tree: change detection, diff, anomaly scoring, counters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.functions.paths import ends_with_any

#: Endings that encrypting malware leaves. Fixed values.
SUSPICIOUS = (".locked", ".encrypted", ".crypt", ".crypted", ".locky", ".cerber", ".zepto", ".enc", ".vault", ".ransom", ".wcry", ".wncry", ".ryk", ".conti")
SAMPLES = 5


@dataclass(frozen=True)
class AnomalyPolicy:
    threshold: float = 0.5
    least_files: int = 20
    endings: Sequence[str] = SUSPICIOUS


def changes(current: DataFrame, parent: DataFrame, on: Sequence[str] = ("size", "mtime", "attributes")) -> DataFrame:
    """``current`` files with status new, changed or unchanged against ``parent`` files."""
    old = parent.select(F.col("path").alias("_path"), *[F.col(c).alias(f"_{c}") for c in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = F.when(F.col("_path").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return current.join(old, F.col("path") == F.col("_path"), "left").select(*current.columns, status.alias("status"))


def deletions(current: DataFrame, parent: DataFrame) -> DataFrame:
    return parent.join(current.select("path"), "path", "left_anti")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``path, mark``: + only in b, - only in a, ~ size or time differs; equal ones go."""
    x = a.select("path", F.col("size").alias("sa"), F.col("mtime").alias("ma"), F.lit(True).alias("ia"))
    y = b.select("path", F.col("size").alias("sb"), F.col("mtime").alias("mb"), F.lit(True).alias("ib"))
    differs = ~F.col("sa").eqNullSafe(F.col("sb")) | ~F.col("ma").eqNullSafe(F.col("mb"))
    mark = F.when(F.col("ia").isNull(), "+").when(F.col("ib").isNull(), "-").when(differs, "~")
    return x.join(y, "path", "full_outer").select("path", mark.alias("mark")).where("mark is not null")


def anomaly_columns(parent_files: Column, changed: Column, deleted: Column, suspicious: Column, samples: Column, policy: AnomalyPolicy) -> Column:
    """(detected, reasons) of counts; the tests are strict, a small parent isn't judged.

    ``changed`` counts new files too, so the ratio may exceed 1.
    """
    ratio = (changed + deleted) / parent_files
    high = (parent_files >= policy.least_files) & (ratio > policy.threshold)
    first = F.concat(F.lit("ratio "), F.round(ratio * 100).cast("int").cast("string"), F.lit("%"))
    second = F.concat(F.lit("suspicious "), suspicious.cast("string"), F.lit(": "), F.array_join(samples, ", "), F.when(suspicious > SAMPLES, ", ...").otherwise(""))
    found = F.array_compact(F.array(F.when(high, first), F.when(suspicious > 0, second)))
    return F.struct((F.size(found) > 0).alias("detected"), found.alias("reasons"))


def anomaly(changed: DataFrame, deleted: DataFrame, parent: DataFrame, policy: AnomalyPolicy = AnomalyPolicy()) -> DataFrame:
    """One row for the run: counts, suspicious names and the verdict.

    ``changed``: output of ``changes``. Samples are the least names, so equal on every run;
    each task keeps SAMPLES of them only.
    """
    touched = changed.where("status <> 'unchanged'")
    bad = touched.where(ends_with_any(F.col("name"), policy.endings))
    sample = bad.select("name").orderBy("name").limit(SAMPLES).agg(F.array_sort(F.collect_list("name")).alias("samples"))
    n = F.count(F.lit(1))
    parts = [touched.agg(n.alias("changed")), bad.agg(n.alias("suspicious")), deleted.agg(n.alias("deleted")), parent.agg(n.alias("parent_files")), sample]
    rows = parts[0]
    for part in parts[1:]:  # a row of each figure; together one row without a join
        rows = rows.unionByName(part, allowMissingColumns=True)
    counts = rows.agg(*[F.max(c).alias(c) for c in ("changed", "suspicious", "deleted", "parent_files", "samples")])
    verdict = anomaly_columns(F.col("parent_files"), F.col("changed"), F.col("deleted"), F.col("suspicious"), F.col("samples"), policy)
    return counts.withColumn("v", verdict).select("parent_files", "changed", "deleted", "suspicious", F.col("v.detected").alias("detected"), F.col("v.reasons").alias("reasons"))


def counters(changed: DataFrame) -> DataFrame:
    """Files and bytes by status, as columns of one row."""
    by = lambda s: F.count_if(F.col("status") == s)
    return changed.agg(by("new").alias("new_files"), by("changed").alias("changed_files"), by("unchanged").alias("unchanged_files"), F.coalesce(F.sum(F.when(F.col("status") != "unchanged", F.col("size"))), F.lit(0)).alias("bytes_to_read"))
