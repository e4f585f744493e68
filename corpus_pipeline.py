"""From raw documents to packed training sequences.

Each stage gets what the stage before it kept and returns the columns of documents; the
last returns the pieces of the packed sequences. All stages accept empty tables, nulls and
repeated rows as their operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaultframe.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from vaultframe.llm.common import table
from vaultframe.sources import scratch


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is high enough; accuracies are those on ``docs``."""
    return quality_rules.filtered(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that three or more share but for one copy."""
    return line_dedup.filtered(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group at 0.8 of five-word shingles."""
    return near_dedup.filtered(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the Pfair schedule to the default targets; packing
    keeps each source's order and deals the sources by the same targets."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; each window's tokens are in proportion to the
    mixing targets of the sources that still have tokens."""
    return packing.packed(docs, targets=mixing.targets(docs)).drop("queue")


STAGES = [
    ("quality_rules", reject_by_rules),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Expectation-maximisation and tokenizers are beyond SQL; tests hold each stage against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote for itself goes when its result is stored, and a
    stage's result when the next one's is. The last stage's tables stay for the caller to
    read; ``scratch.clear`` deletes them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch.scratch_path(spark, name)
        with scratch.scope(spark):
            docs = scratch.written(stage(spark, docs, sf_dir), name, path=path)
        if before is not None:
            scratch.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
