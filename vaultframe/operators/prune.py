"""Mark and sweep: live blobs, what becomes of each pack, bytes freed, catalog rewrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pack with a smaller share of live blobs is repacked.
LIVENESS = 0.70


def live_blobs(refs: DataFrame, kept: DataFrame) -> DataFrame:
    """Distinct blobs that a kept snapshot refers to."""
    return refs.join(kept.select("snapshot_id"), "snapshot_id", "left_semi").select("blob_id").distinct()


def reachable(edges: DataFrame, roots: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``id`` of all nodes that ``roots`` (id) reach over ``edges`` (parent, child).

    Each round joins only the newest nodes, so a shared subtree is walked once however many
    paths lead to it. ``store`` cuts the lineage, such as by a checkpoint in the folder of
    spark.checkpoint.dir; it is called once a level.
    """
    frontier = store(roots.select("id").distinct())
    seen = frontier
    while frontier.limit(1).count():
        found = edges.join(frontier, edges["parent"] == frontier["id"], "left_semi").select(F.col("child").alias("id")).where("id is not null").distinct()
        frontier = store(found.join(seen, "id", "left_anti"))
        seen = store(seen.unionByName(frontier))
    return seen


def classify_packs(packs: DataFrame, blobs: DataFrame, live: DataFrame, threshold: float = LIVENESS) -> DataFrame:
    """``pack_id, total, live, size_bytes, action`` for each of ``packs`` (pack_id, size_bytes).

    Liveness is a share of blobs, not bytes: none live is deleted, which a pack without
    blobs is too; below the threshold is repacked, at or above it stays. The size is that
    of the file, with its salt, header and tags.
    """
    marked = blobs.select("pack_id", "blob_id").join(live.select("blob_id").withColumn("_live", F.lit(True)), "blob_id", "left")
    per = marked.groupBy("pack_id").agg(F.count(F.lit(1)).alias("total"), F.count("_live").alias("live"))
    each = packs.select("pack_id", "size_bytes").join(per, "pack_id", "left").select("pack_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("live", F.lit(0)).alias("live"), "size_bytes")
    action = F.when(F.col("live") == 0, "delete").when(F.col("live") / F.col("total") < threshold, "repack").otherwise("keep")
    return each.withColumn("action", action)


def freed(packs: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row: packs by action and gross bytes of deleted and repacked packs, 0 if dry."""
    gone = F.col("action") != "keep"
    return packs.agg(
        F.count_if(F.col("action") == "delete").alias("packs_deleted"), F.count_if(F.col("action") == "repack").alias("packs_repacked"), F.count_if(~gone).alias("packs_kept"),
        (F.lit(0).cast("bigint") if dry_run else F.coalesce(F.sum(F.when(gone, F.col("size_bytes"))), F.lit(0))).alias("bytes_freed"),
    )


def swept(rows: DataFrame, packs: DataFrame) -> DataFrame:
    """``rows``, blobs or packs, without those of packs that are deleted."""
    return rows.join(packs.where("action = 'delete'").select("pack_id"), "pack_id", "left_anti")


def carried(blobs: DataFrame, packs: DataFrame, live: DataFrame) -> DataFrame:
    """Live blobs that a repack takes over."""
    return blobs.join(packs.where("action = 'repack'").select("pack_id"), "pack_id", "left_semi").join(live, "blob_id", "left_semi")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with rows of ``new`` in place of those of the same key, and added."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def new_blobs(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidate blobs that aren't stored yet, one row for each id: the least by (seq)."""
    first = candidates.groupBy("blob_id").agg(F.min("seq").alias("seq"))
    return first.join(existing.select("blob_id"), "blob_id", "left_anti")
