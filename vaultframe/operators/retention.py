"""Retention: which snapshots a policy keeps and why, protections, manual deletes.

One window per bucket kind over the snapshots' (plan, time) columns gives all rules'
verdicts in one pass; a plan's snapshots, at most one a few minutes over years, are what a
task sorts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RetentionPolicy:
    """None: no such rule. A rule of 0 is a rule, and keeps nothing."""

    last: int | None = None
    hourly: int | None = None
    daily: int | None = None
    weekly: int | None = None
    monthly: int | None = None
    yearly: int | None = None
    within: timedelta | None = None
    tags: Sequence[str] = ()

    @property
    def is_empty(self) -> bool:
        return not self.tags and all(v is None for v in (self.last, self.hourly, self.daily, self.weekly, self.monthly, self.yearly, self.within))


@dataclass(frozen=True)
class Protection:
    """Append-only forbids every delete; otherwise snapshots younger than ``window`` stay."""

    append_only: bool = False
    window: timedelta | None = None


BUCKETS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


def newest_per_bucket(bucket: Column, count: int, by: Sequence[str], ts: str = "started_at", key: str = "snapshot_id") -> Column:
    """Whether a row is the newest of one of the ``count`` newest non-empty buckets.

    Ties in time go to the greater id.
    """
    first = F.row_number().over(W.partitionBy(*by, bucket).orderBy(F.col(ts).desc(), F.col(key).desc())) == 1
    return first & (F.dense_rank().over(W.partitionBy(*by).orderBy(bucket.desc())) <= count)


def reasons(policy: RetentionPolicy, now: datetime, by: Sequence[str] = (), ts: str = "started_at", key: str = "snapshot_id") -> dict[str, Column]:
    """A boolean for each rule of the policy."""
    out: dict[str, Column] = {}
    if policy.last is not None:
        out["last"] = F.row_number().over(W.partitionBy(*by).orderBy(F.col(ts).desc(), F.col(key).desc())) <= policy.last
    for name, unit in BUCKETS.items():
        if (n := getattr(policy, name)) is not None:
            out[name] = newest_per_bucket(F.date_trunc(unit, F.col(ts)), n, by, ts, key)
    if policy.within is not None:
        out["within"] = F.col(ts) >= F.lit(now - policy.within).cast("timestamp_ntz")
    if policy.tags:
        wanted = F.array(*[F.lit(t.lower()) for t in policy.tags])
        out["tags"] = F.coalesce(F.arrays_overlap(F.transform("tags", F.lower), wanted), F.lit(False))
    return out


def evaluate(snapshots: DataFrame, policy: RetentionPolicy, now: datetime, by: Sequence[str] = ()) -> DataFrame:
    """``snapshots`` with ``keep_reasons`` (rule names) and ``keep``; rules are united.

    An empty policy keeps everything. ``by``: columns within which rules count, such as the
    plan; without, all rows are one history.
    """
    if policy.is_empty:
        return snapshots.withColumn("keep_reasons", F.array(F.lit("no-policy"))).withColumn("keep", F.lit(True))
    each = reasons(policy, now, by)
    return snapshots.withColumn("keep_reasons", F.array_compact(F.array(*[F.when(c, n) for n, c in each.items()]))).withColumn("keep", F.size("keep_reasons") > 0)


def protect(evaluated: DataFrame, protection: Protection, now: datetime) -> DataFrame:
    """Adds the reason of a protection; append-only goes before the window."""
    if protection.append_only:
        forced = F.lit("append-only")
    elif protection.window is not None:
        forced = F.when(F.col("started_at") >= F.lit(now - protection.window).cast("timestamp_ntz"), "immutable")
    else:
        return evaluated
    return evaluated.withColumn("keep_reasons", F.array_compact(F.array_append("keep_reasons", forced))).withColumn("keep", F.size("keep_reasons") > 0)


def scoped(snapshots: DataFrame, policy: RetentionPolicy, now: datetime, plan: object) -> DataFrame:
    """Judges one plan's snapshots; all others are kept as out of scope."""
    own = F.col("plan_id").eqNullSafe(F.lit(plan))
    judged = evaluate(snapshots.where(own), policy, now)
    return judged.unionByName(snapshots.where(~own).withColumn("keep_reasons", F.array(F.lit("other-plan"))).withColumn("keep", F.lit(True)))


def manual_delete(requested: DataFrame, snapshots: DataFrame, protection: Protection, now: datetime) -> DataFrame:
    """For each distinct requested id: deleted, or refused with a reason."""
    known = protect(snapshots.select("snapshot_id", "started_at").withColumn("keep_reasons", F.array().cast("array<string>")), protection, now)
    if "keep" not in known.columns:
        known = known.withColumn("keep", F.lit(False))
    joined = requested.select("snapshot_id").distinct().join(known, "snapshot_id", "left")
    reason = F.when(F.col("started_at").isNull(), "not-found").when(F.col("keep"), F.get("keep_reasons", F.lit(0)))
    return joined.select("snapshot_id", F.when(reason.isNull(), "deleted").otherwise("refused").alias("outcome"), reason.alias("reason"))


def with_previous(snapshots: DataFrame) -> DataFrame:
    """Adds ``parent_snapshot_id``: the snapshot of the same plan before this one."""
    return snapshots.withColumn("parent_snapshot_id", F.lag("snapshot_id").over(W.partitionBy("plan_id").orderBy("started_at", "snapshot_id")))
