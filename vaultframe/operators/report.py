"""Job history: calendars, latest rows, dashboards, alerts, due plans."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.functions import cron as schedules
from vaultframe.functions import text


def day_health(jobs: DataFrame, today: datetime, days: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``day, health`` of the last days, oldest first: Err if any job failed, Ok if any ran,
    None without jobs. With ``by``, for each of its values."""
    span = F.sequence(F.lit(today.date() - timedelta(days=days - 1)), F.lit(today.date()))
    spine = (jobs.select(*by).distinct() if by else jobs.sparkSession.range(1).select()).select(*by, F.explode(span).alias("day"))
    per = jobs.where("started_at is not null").groupBy(*by, F.to_date("started_at").alias("day")).agg(F.bool_or(F.col("status") == "Failed").alias("failed"))
    health = F.when(F.col("failed"), "Err").when(~F.col("failed"), "Ok").otherwise("None")
    return spine.join(per, [*by, "day"], "left").select(*by, "day", health.alias("health"))


def latest(jobs: DataFrame, by: tuple[str, ...], ts: str = "started_at", key: str = "job_id") -> DataFrame:
    """The newest row for each group; rows without a time are the oldest, ties go to the id."""
    cols = [c for c in jobs.columns if c not in by]
    best = F.max_by(F.struct(*cols), F.struct(F.coalesce(ts, F.lit("0001-01-01").cast("timestamp_ntz")), key)).alias("_r")
    return jobs.groupBy(*by).agg(best).select(*by, "_r.*")


def counts(jobs: DataFrame, now: datetime, by: tuple[str, ...] = ()) -> DataFrame:
    """Jobs of the last 24 hours that succeeded and failed, active and failed ones in all."""
    recent = F.col("started_at") >= F.lit(now - timedelta(hours=24)).cast("timestamp_ntz")
    s = F.col("status")
    return jobs.groupBy(*by).agg(F.count_if(recent & (s == "Succeeded")).alias("succeeded_24h"), F.count_if(recent & (s == "Failed")).alias("failed_24h"), F.count_if(s.isin("Pending", "Running")).alias("active"), F.count_if(s == "Failed").alias("failed"))


def band(last: DataFrame, overdue: DataFrame, by: str = "repo") -> DataFrame:
    """State of each repository: Err if its last job failed, Warn if a plan is overdue."""
    late = overdue.select(by).distinct().withColumn("_late", F.lit(True))
    state = F.when(F.col("status") == "Failed", "Err").when(F.col("_late"), "Warn").otherwise("Ok")
    return last.join(late, by, "left").select(by, state.alias("state"))


def overdue(jobs: DataFrame, crons: DataFrame, now: datetime, by: str = "repo") -> DataFrame:
    """Repositories in which any schedule of ``crons`` (by, cron) is due: no job succeeded
    yet, or the first slot after the start of the last one that did has come."""
    last = jobs.groupBy(by).agg(F.max(F.when(F.col("status") == "Succeeded", F.col("started_at"))).alias("last"))
    timed = schedules.with_next(crons.select(by, "cron").distinct().join(last, by), "cron", "last")
    return timed.where(F.col("last").isNull() | (F.col("next_slot") <= F.lit(now).cast("timestamp_ntz"))).select(by).distinct()


def overall(bands: DataFrame) -> DataFrame:
    """One row: worst state, repositories, and those without an error."""
    level = F.when(F.col("state") == "Err", 2).when(F.col("state") == "Warn", 1).otherwise(0)
    worst = F.max(level)
    return bands.agg(F.when(worst == 2, "Err").when(worst == 1, "Warn").otherwise("Ok").alias("state"), F.count(F.lit(1)).alias("repositories"), F.count_if(F.col("state") != "Err").alias("protected"))


def alerts(jobs: DataFrame) -> DataFrame:
    """Failed jobs in words, newest first."""
    raw = F.coalesce("error_message", F.lit(text.NO_ERROR))
    return jobs.where("status = 'Failed'").select("job_id", "repo", text.error_title(raw).alias("title"), text.error_explanation(raw).alias("explanation"), raw.alias("raw"), "started_at").orderBy(F.desc_nulls_last("started_at"), F.desc("job_id"))


def recent(jobs: DataFrame, n: int = 8) -> DataFrame:
    return jobs.orderBy(F.desc_nulls_last("started_at"), F.desc("job_id")).limit(n)


def last_success(jobs: DataFrame) -> DataFrame:
    """``plan_id, kind, last_success``: when the newest success of each ended."""
    return jobs.where("status = 'Succeeded'").groupBy("plan_id", "kind").agg(F.max("finished_at").alias("last_success"))


def not_queued(due: DataFrame, jobs: DataFrame) -> DataFrame:
    """Due (plan_id, kind) without a pending or running job: at most one is ever queued."""
    return due.join(jobs.where(F.col("status").isin("Pending", "Running")).select("plan_id", "kind"), ["plan_id", "kind"], "left_anti")


def stopped(jobs: DataFrame, plans: DataFrame, now: datetime) -> DataFrame:
    """``jobs`` as a stop at ``now`` leaves them: the queue is drained, so that no job stays
    pending or running.

    A pending job of a known plan starts and is cancelled at once, a running one is cancelled;
    jobs of plans that are gone can't be run and stay as they are. Ended jobs don't change.
    Rows without a status or plan stay. Which job of the queue is drained first doesn't show
    in the result.
    """
    known = plans.select(F.col("plan_id").alias("_plan")).where("_plan is not null").distinct()
    at = F.lit(now).cast("timestamp_ntz")
    hit = F.coalesce(F.col("status").isin("Pending", "Running"), F.lit(False)) & F.col("_plan").isNotNull()
    new = {"status": F.lit("Cancelled"), "started_at": F.when(F.col("status") == "Pending", at).otherwise(F.col("started_at")), "finished_at": at, "error_message": F.lit(text.STOPPED)}
    rows = jobs.join(known, F.col("plan_id") == F.col("_plan"), "left")
    return rows.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def latest_state(events: DataFrame) -> DataFrame:
    """Current status of each job from its transitions (job_id, status, at)."""
    order = F.struct("at", F.when(F.col("status") == "Pending", 0).when(F.col("status") == "Running", 1).otherwise(2))
    return events.groupBy("job_id").agg(F.max_by("status", order).alias("status"), F.max("at").alias("at"), F.count(F.lit(1)).alias("transitions"))


def throttle(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """Waits that a token bucket imposes on (stream, seq, at seconds, n): continuous refill,
    debt allowed. A stream's requests are one row's array, folded in order."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.col("at").cast("double").alias("at"), F.col("n").cast("double").alias("n"))))
    start = F.struct(F.lit(float(burst)).alias("avail"), F.lit(0.0).alias("last"), F.lit(0.0).alias("waited"))

    def step(s, x):
        free = F.least(F.lit(float(burst)), s["avail"] + F.greatest(x["at"] - s["last"], F.lit(0.0)) * rate) - x["n"]
        return F.struct(free.alias("avail"), F.greatest(x["at"], s["last"]).alias("last"), (s["waited"] + F.greatest(F.lit(0.0), -free / rate)).alias("waited"))

    done = F.aggregate(ordered, start, step)
    return requests.groupBy("stream").agg(done.alias("s"), F.count(F.lit(1)).alias("requests")).select("stream", "requests", F.round(F.col("s.avail"), 4).alias("available"), F.round(F.col("s.waited"), 4).alias("waited"))
