"""Job transitions as a stream: current states, and at most one queued job for each plan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vaultframe.sources.scratch import scratch_path


def feed(spark: SparkSession, path: str, schema, pattern: str, files_a_trigger: int = 64) -> DataFrame:
    """Files of ``path`` as they arrive; the rate is bounded by files for each trigger."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def _admitted(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Requests of one plan and kind that find no job queued or running."""
    rows = pd.concat(list(frames)).sort_values(["at", "job_id"], kind="stable")
    (busy,) = state.get if state.exists else (False,)
    taken = []
    for i, event in enumerate(rows["event"]):
        if event == "ask" and not busy:
            taken.append(i)
        busy = event == "ask"
    if busy:
        state.update((True,))
    elif state.exists:
        state.remove()
    yield rows.iloc[taken][["plan_id", "kind", "job_id"]]


def once_queued(events: DataFrame) -> DataFrame:
    """``plan_id, kind, job_id`` of the requests that are let into the queue: at most one job
    of each plan and kind is pending or running at a time.

    ``events``: (plan_id, kind, job_id, event, at); "ask" requests a job, any other event
    ends the one that is there. The state of a plan and kind is one flag, held only while a
    job is there, so it is bounded by the jobs in flight however long the stream runs. A
    batch's events of one plan are taken in order of time.
    """
    schema = events.schema
    out = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in ("plan_id", "kind", "job_id"))
    return events.groupBy("plan_id", "kind").applyInPandasWithState(_admitted, out, "busy boolean", "append", GroupStateTimeout.NoTimeout)


def hourly(jobs: DataFrame, ts: str, late: str = "2 hours") -> DataFrame:
    """Jobs by hour and status; hours close as the watermark passes them."""
    timed = jobs.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "status").agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, name: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs the stream over what is there and stops; the result as a table.

    In update mode each batch writes the groups that it changed, and the last row of each
    of ``keys`` counts, so state can go as the watermark passes.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:
        writer = stream.writeStream.foreachBatch(lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}"))
    query = writer.outputMode(mode).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    if mode == "append":
        return rows
    values = [c for c in rows.columns if c not in (*keys, "_batch", "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")
