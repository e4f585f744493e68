"""Directory trees: walks, listings, pruned scans, Merkle ids from the leaves up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.functions.crypto import hmac_sha256


def walk(edges: DataFrame, roots: DataFrame, store: Callable[[DataFrame], DataFrame], descend: str = "true", visit: str = "true") -> DataFrame:
    """``path, name, kind, depth, sub`` of everything below ``roots`` (id, prefix), level by
    level, for trees of any size and depth.

    ``edges``: (parent, name, kind, sub); ``sub`` names a directory's own tree. ``visit``
    and ``descend`` are SQL conditions on the columns of an entry: what isn't visited is
    left out with all below it, so pruning happens before the next level is read. Each
    level is one join whose result ``store`` writes, so a lost executor costs part of a
    level, and no plan holds more than one.
    """
    start = roots.select(F.col("id").alias("_id"), F.col("prefix").alias("_prefix"))
    depth, out = 1, None
    while True:
        path = F.when(F.col("_prefix") == "", F.col("name")).otherwise(F.concat_ws("/", "_prefix", "name"))
        level = store(edges.join(start, edges["parent"] == start["_id"]).select(path.alias("path"), "name", "kind", F.lit(depth).alias("depth"), "sub").where(visit))
        out = level if out is None else out.unionByName(level)
        start = level.where("sub is not null").where(descend).select(F.col("sub").alias("_id"), F.col("path").alias("_prefix"))
        if not start.limit(1).count():
            return out
        depth += 1


def merkle(edges: DataFrame, key: bytes, leaf: Column, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``parent, tree_id`` of every directory: a keyed hash of its entries, from the leaves
    up to the roots.

    An entry is its name, kind and either ``leaf`` (an expression over ``edges``) or its
    subtree's id; entries are ordered by name, so equal directories get equal ids, and one
    without entries that of none. A level takes a join and an aggregation over the
    directories that are still open; ``store`` writes what it leaves. Directories that
    contain themselves never get an id.
    """
    kept = [c for c in edges.columns if c in ("parent", "name", "kind", "sub")]
    open_ = store(edges.select(*kept, F.when(F.col("sub").isNull(), leaf).alias("value")))
    empty = edges.where("sub is not null").select(F.col("sub").alias("parent")).distinct().join(edges.select("parent"), "parent", "left_anti")
    new = store(empty.select("parent", hmac_sha256(F.lit("").cast("binary"), key).alias("tree_id")))
    out = new
    while True:
        below = new.select(F.col("parent").alias("_sub"), "tree_id")
        open_ = store(open_.join(below, F.col("sub") == F.col("_sub"), "left").withColumn("value", F.coalesce("value", "tree_id")).select(*kept, "value"))
        line = F.concat_ws("|", F.col("name"), F.col("kind"), F.col("value"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), "\n")
        ready = open_.groupBy("parent").agg(text.alias("text"), F.count_if(F.col("value").isNull()).alias("missing")).where("missing = 0")
        new = store(ready.select("parent", hmac_sha256(F.col("text").cast("binary"), key).alias("tree_id")))
        if not new.limit(1).count():
            return out
        out = out.unionByName(new)
        open_ = open_.join(new.select("parent"), "parent", "left_anti")


def listing(walked: DataFrame, path: str = "") -> DataFrame:
    """Entries right below ``path``, directories marked d, by name."""
    here = walked.where(F.col("path").startswith(f"{path}/") if path else F.lit(True))
    depth = path.count("/") + 2 if path else 1
    return here.where(F.size(F.split("path", "/")) == depth).select(F.when(F.col("kind") == "dir", "d").otherwise("-").alias("mark"), "name", "path").orderBy("name")
