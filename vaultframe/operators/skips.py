"""Entries that a run can't read: left out, counted, and named in samples for the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.functions.paths import is_placeholder

#: Samples of one audit record; the count is of all.
SAMPLES = 20


def reason(attributes: Column, error: Column) -> Column:
    """Why an entry is skipped, null if it is read: a cloud placeholder is never opened, so
    its content isn't fetched; otherwise the kind of error that opening it gave."""
    return F.when(F.coalesce(is_placeholder(attributes), F.lit(False)), "IOException").otherwise(error)


def split(entries: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(entries that are read, ``path, reason`` of the others), both without an exchange."""
    why = reason(F.col("attributes"), F.col(error))
    return entries.where(why.isNull()), entries.where(why.isNotNull()).select("path", why.alias("reason"))


def summary(skipped: DataFrame) -> DataFrame:
    """One row: ``entries_skipped`` and ``samples``, "path (reason)" of the SAMPLES least
    paths. Zero and an empty list if nothing was skipped."""
    first = skipped.select(F.concat_ws("", "path", F.lit(" ("), "reason", F.lit(")")).alias("sample"), "path").orderBy(F.asc_nulls_last("path"), "sample").limit(SAMPLES)
    rows = skipped.groupBy().agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("array<string>").alias("s")).unionByName(
        first.groupBy().agg(F.lit(None).cast("long").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("path", "sample"))), lambda x: x["sample"]).alias("s")))
    return rows.groupBy().agg(F.max("n").alias("entries_skipped"), F.max("s").alias("samples"))
