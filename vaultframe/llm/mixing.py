"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents, in an order shuffled by a hash, are cut into blocks of equal size.
Block i of a source with weight w is released at slot floor(i / w) and due by
ceil((i + 1) / w); in each slot the released block with the earliest deadline runs. As the
weights sum to 1, every block meets its window, so at any slot each source has had its
share to within less than one block.

The driver runs this once for all blocks, with the weights as exact fractions, and writes
down each block's slot: a row for a run of blocks, three numbers for each block of
BLOCK_CHARS characters, so about a thousandth of the corpus. When a source is used up, a
new phase begins in which the others keep their proportions.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, two_level_position, written

BLOCK_CHARS = 32_768
#: Blocks whose slots stand in one row, and as many as are broadcast at most.
RUN_BLOCKS, MAX_BROADCAST = 1024, 4_000_000
#: Without weights, a source's target is its size to this power: below 1 lifts small ones.
EXPONENT = 0.7


def shares(weights: Sequence[float], period: int) -> list[int]:
    """Whole parts of ``period`` in proportion to ``weights``, at least 1 each; the largest
    remainders are rounded up, the first of equals before others."""
    total = math.fsum(weights)
    ideal = [w / total * period for w in weights]
    n = [max(1, math.floor(x)) for x in ideal]
    order = sorted(range(len(n)), key=lambda i: (n[i] - ideal[i], i))
    i = 0
    while (gap := period - sum(n)) != 0:
        if gap > 0:
            n[order[i % len(n)]] += 1
        else:
            n[max(range(len(n)), key=lambda j: (n[j], -j))] -= 1
        i += 1
    return n


def edf(n: Sequence[int], period: int) -> list[int]:
    """The source that runs in each slot of a period in which source i has n[i] blocks."""
    done, out = [0] * len(n), []
    for t in range(period):
        ready = [(-(-(done[i] + 1) * period // n[i]), i) for i in range(len(n)) if done[i] < n[i] and done[i] * period // n[i] <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


def phases(blocks: Sequence[int], weights: Sequence[float], period: int) -> list[dict]:
    """For each phase: its first slot, and for each source still there the block that it
    begins with, the end of its blocks, its parts of the period and their slots."""
    left, start, slot, out = list(blocks), [0] * len(blocks), 0, []
    while any(left):
        live = [i for i, n in enumerate(left) if n]
        n = dict(zip(live, shares([weights[i] for i in live], period), strict=True))
        plan = [live[j] for j in edf([n[i] for i in live], period)]
        whole = min(left[i] // n[i] for i in live)
        used = {i: whole * n[i] for i in live}
        length = whole * period
        for i in plan:  # the last period ends where a source has no block left
            if used[i] == left[i]:
                break
            used[i] += 1
            length += 1
        where: dict[int, list[int]] = {i: [] for i in live}
        for t, i in enumerate(plan):
            where[i].append(t)
        out.append({"slot": slot, "sources": {i: {"start": start[i], "end": start[i] + used[i], "n": n[i], "at": where[i]} for i in live}})
        for i in live:
            start[i] += used[i]
            left[i] -= used[i]
        slot += length
    return out


def exact(blocks: Sequence[int], weights: Sequence[float]) -> list[tuple[array, array, array]]:
    """Slot, release and deadline of each block of each source, by the weights as they are."""
    parts = [Fraction(w) for w in weights]
    scale = math.lcm(*[f.denominator for f in parts])
    n = [int(f * scale) for f in parts]
    left, begin, out = list(blocks), 0, [(array("q"), array("q"), array("q")) for _ in blocks]
    while live := [i for i, b in enumerate(left) if b]:
        total, done, t = sum(n[i] for i in live), dict.fromkeys(live, 0), 0
        later: list[tuple[int, int]] = []  # (release, source) and (deadline, source) of next blocks
        ready = [(-(-total // n[i]), i) for i in live]
        heapq.heapify(ready)
        while True:
            while later and later[0][0] <= t:
                i = heapq.heappop(later)[1]
                heapq.heappush(ready, (-(-(done[i] + 1) * total // n[i]), i))
            if not left[ready[0][1]]:
                break
            due, i = heapq.heappop(ready)
            for column, x in zip(out[i], (t, done[i] * total // n[i], due), strict=True):
                column.append(begin + x)
            done[i] += 1
            left[i] -= 1
            heapq.heappush(later, (done[i] * total // n[i], i))
            t += 1
        begin += t
    return out


def periodic(blocks: Sequence[int], weights: Sequence[float], period: int) -> list[tuple[array, array, array]]:
    """The same by weights in whole parts of ``period``."""
    out = [(array("q"), array("q"), array("q")) for _ in blocks]
    for p in phases(blocks, weights, period):
        for i, s in p["sources"].items():
            n = s["n"]
            for b in range(s["end"] - s["start"]):
                turn, j = p["slot"] + b // n * period, b % n
                for column, x in zip(out[i], (s["at"][j], j * period // n, -(-(j + 1) * period // n)), strict=True):
                    column.append(turn + x)
    return out


def _runs(queues: Sequence[int], plan: Sequence[tuple[array, array, array]]) -> Iterator[dict]:
    for q, columns in zip(queues, plan, strict=True):
        for k, lo in enumerate(range(0, len(columns[0]), RUN_BLOCKS)):
            yield {"pq": q, "prun": k} | {c: x[lo : lo + RUN_BLOCKS].tolist() for c, x in zip(("pslot", "prelease", "pdeadline"), columns, strict=True)}


def _size() -> F.Column:
    """Characters of a text and its end."""
    return F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1


def _by_source(docs: DataFrame) -> DataFrame:
    """(h, n, rows): size and rows of each source, by the hash of its name."""
    return docs.groupBy(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("\0"))).alias("h")).agg(F.sum(_size()).alias("n"), F.count(F.lit(1)).alias("rows"))


def targets(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> dict[int, float]:
    """The default target weights, by the hash of the source's name: those of ``scheduled``."""
    return {r["h"]: (-(-r["n"] // block_chars)) ** EXPONENT for r in _by_source(docs).collect()}


def scheduled(docs: DataFrame, weights: Mapping[str, float] | None = None, block_chars: int = BLOCK_CHARS, period: int | None = None) -> DataFrame:
    """``docs`` with block, release, deadline, slot and block_offset; order by slot, then by
    block_offset, is the mix. A document belongs to the block in which it begins.

    Every row stays. ``weights``: target by source; a source that it doesn't name has the
    least weight that is named. ``period``: round targets to whole parts of a period, at
    least 1 each; the bound then holds for the rounded ones. Null sources are a source. Null or empty texts count one character,
    as does the end of each text. Rows of a source are ordered by a hash of id and text, so
    repeated rows stand together and are interchangeable. Columns of ``docs`` with a result's name are replaced.
    """
    if weights is not None and (not weights or min(weights.values()) <= 0):
        raise ValueError("targets must be positive")
    spark, new = docs.sparkSession, ("block", "release", "deadline", "slot", "block_offset")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    size = _size()
    totals = sorted(_by_source(docs).collect(), key=lambda r: r["h"])  # each has a block at least
    blocks = [-(-r["n"] // block_chars) for r in totals]
    if weights is None:
        target = [b**EXPONENT for b in blocks]
    else:
        names = sorted(weights)
        found = spark.range(1).select(*[F.xxhash64(F.lit(s)).alias(f"h{i}") for i, s in enumerate(names)]).first()
        of = {h: weights[s] for s, h in zip(names, found, strict=True)}
        target = [of.get(r["h"], min(weights.values())) for r in totals]
    plan = periodic(blocks, target, max(period, len(totals))) if period else exact(blocks, target)
    lists = [(c, pa.list_(pa.int64())) for c in ("pslot", "prelease", "pdeadline")]
    rows = pa.Table.from_pylist(list(_runs([r["h"] for r in totals], plan)), schema=pa.schema([("pq", pa.int64()), ("prun", pa.int64()), *lists]))
    slots = written(spark.createDataFrame(rows), "slots")
    if sum(blocks) <= MAX_BROADCAST:
        slots = F.broadcast(slots)
    buckets = max(1, math.isqrt(sum(r["rows"] for r in totals)))
    key = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text").cast("string")).cast("binary"))
    bucket = F.expr(f"cast(conv(substring(_key, 1, 8), 16, 10) as bigint) * {buckets} div 4294967296")
    keyed = docs.withColumn("_q", F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit("\0")))).withColumn("_key", key).withColumn("_bucket", bucket)
    at = two_level_position(keyed, ["_q"], "_bucket", [F.col("_key")], size, "_at")
    block = F.expr(f"_at div {block_chars}")
    placed = at.withColumn("block", block).join(slots, (F.col("_q") == F.col("pq")) & (F.expr(f"block div {RUN_BLOCKS}") == F.col("prun")))
    of = lambda c: F.expr(f"{c}[cast(block % {RUN_BLOCKS} as int)]")
    return (
        placed.withColumn("release", of("prelease"))
        .withColumn("deadline", of("pdeadline"))
        .withColumn("slot", of("pslot"))
        .withColumn("block_offset", F.expr(f"_at % {block_chars}"))
        .select(*docs.columns, *new)
    )


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The rows of ``docs`` in mixed order: range-partitioned by slot and sorted within, so
    files written from it, read in order, are the mix."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = {names[docs.columns.index(c)]: c for c in ("doc_id", "source", "text")}
    done = scheduled(docs.toDF(*names).withColumnsRenamed(own), weights)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = done.repartitionByRange(n, "slot", "block_offset").sortWithinPartitions("slot", "block_offset")
    return ordered.select(*[own.get(c, c) for c in names]).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 over all documents, with the default targets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return scheduled(docs).drop("text")
