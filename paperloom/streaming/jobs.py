"""The job queue as streams: de-duplicated intake, idempotent runs, retries with delay, sweeps, rate windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How long a job id is remembered, attempts, and the bounds of the delay in seconds.
KEEP, MAX_ATTEMPTS, BASE_DELAY, MAX_DELAY = "3600 seconds", 3, 2.0, 60.0
#: Milliseconds that a settled job is remembered, so that a redelivery is a no-op.
FORGET = 3_600_000


def deduplicated(jobs: DataFrame, time: str = "ts", keep: str = KEEP) -> DataFrame:
    """At-least-once deliveries as one row for each job id within the time it is remembered."""
    return jobs.withWatermark(time, keep).dropDuplicatesWithinWatermark(["job_id"])


def rate_windows(requests: DataFrame, limit: int, window: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """Requests over the limit by identity and fixed window; a window is final once the watermark is past it."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", window), "identity").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "identity", "n", F.greatest(F.col("n") - limit, F.lit(0)).cast("long").alias("refused"))


def merge_once(done_path: str):  # noqa: ANN201
    """A foreachBatch sink keyed by epoch: a batch that is replayed writes over itself, and reads nothing of what is there."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(["job_id"]).write.mode("overwrite").parquet(f"{done_path}/epoch={epoch}")

    return put


def once(spark: SparkSession, done_path: str) -> DataFrame:
    """What merge_once recorded: of a job that several epochs, or several sinks, delivered the first."""
    rows = spark.read.parquet(done_path)
    own = [F.col(f"`{c}`") for c in rows.columns if c not in ("job_id", "epoch")]
    return rows.groupBy("job_id").agg(F.min_by(F.struct(F.lit(0).alias("__"), *own), "epoch").alias("r")).select("job_id", *(F.col("r")[c].alias(c) for c in rows.columns if c not in ("job_id", "epoch")))


def _retry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State is (attempts, due ms). A failure waits at most base * 2**(n-1) seconds; the last one is dead-lettered."""
    attempts = state.get[0] if state.exists else 0
    out: list[tuple[str, int, str, float]] = []
    if state.hasTimedOut:
        state.remove()
        if attempts >= 0:  # else a settled job, now forgotten
            out.append((key[0], attempts, "retry", 0.0))
            state.update((attempts, 0))
    else:
        for frame in frames:
            for ok in frame.sort_values("ts")["ok"].tolist():
                if attempts < 0:
                    continue  # settled: a redelivery is a no-op
                attempts += 1
                if ok:
                    out.append((key[0], attempts, "succeeded", 0.0))
                    attempts = -1
                elif attempts >= MAX_ATTEMPTS:
                    out.append((key[0], attempts, "dead_lettered", 0.0))
                    attempts = -1
                else:
                    out.append((key[0], attempts, "waiting", min(MAX_DELAY, BASE_DELAY * 2 ** (attempts - 1))))
        state.update((attempts, 0))
        if attempts < 0:
            state.setTimeoutDuration(FORGET)
        elif out and out[-1][2] == "waiting":
            state.setTimeoutDuration(int(out[-1][3] * 1000))
    yield pd.DataFrame(out, columns=["job_id", "attempt", "decision", "delay_s"])


def retries(attempts: DataFrame) -> DataFrame:
    """attempts (job_id, ts, ok) -> (job_id, attempt, decision, delay_s) as they are decided."""
    return attempts.groupBy("job_id").applyInPandasWithState(_retry, "job_id string, attempt long, decision string, delay_s double", "attempts long, due long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def settled(attempts: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """The batch form of retries(): attempts (job_id, ts, event_id, ok) -> (job_id, last), by a fold over ordered attempts.

    Only the first `most` attempts of a job decide, so no more are ever gathered for it.
    """
    nth = Window.partitionBy("job_id").orderBy("ts", "event_id")
    firsts = attempts.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= most)
    done = firsts.groupBy("job_id").agg(F.bool_or("ok").alias("ok"), F.max("n").alias("n"))
    return done.select("job_id", F.when(F.col("ok"), "succeeded").when(F.col("n") >= most, "dead_lettered").otherwise("waiting").alias("last"))


def sweep(docs: DataFrame, every: str = "5 minutes"):  # noqa: ANN201
    """A writer that looks for stale documents on a schedule; give it a foreachBatch and start it."""
    return docs.writeStream.trigger(processingTime=every)
