"""Streaming operators run to completion over the events table, held against their batch meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources import storage
from paperloom.session import ship
from paperloom.streaming import jobs, timed

from .registry import query


def finished(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream over files at rest gives, by way of a table in the shared folder."""
    at = storage.scratch(spark, "stream")
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    else:
        def put(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out")

        run = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("str01_dedupe", "SELECT CAST(user_id AS VARCHAR) AS job_id, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def dedupe(spark, d):  # noqa: ANN001, ANN201
    rows = events(spark, d).select(F.col("user_id").cast("string").alias("job_id"), "ts")
    return finished(spark, jobs.deduplicated(rows, keep="60 days")).groupBy("job_id").agg(F.count("*").alias("n"))


@query("str02_idempotent_sink", "SELECT CAST(user_id AS VARCHAR) AS job_id, 1::BIGINT AS n FROM events GROUP BY 1")
def idempotent_sink(spark, d):  # noqa: ANN001, ANN201
    at, put = storage.scratch(spark, "done"), None
    put = jobs.merge_once(at)
    rows = events(spark, d).select(F.col("user_id").cast("string").alias("job_id"))
    for _ in range(2):  # the second run replays everything
        rows.writeStream.foreachBatch(put).option("checkpointLocation", storage.scratch(spark, "done-state")).trigger(availableNow=True).start().awaitTermination()
    return jobs.once(spark, at).groupBy("job_id").agg(F.count("*").alias("n"))


@query("str03_retries", """WITH a AS (SELECT user_id, event_type <> 'error' AND event_type <> 'view' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, min(n) FILTER (ok) AS first, count(*) AS total FROM a GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS job_id, CASE WHEN coalesce(first, 99) <= 3 THEN 'succeeded' WHEN total >= 3 THEN 'dead_lettered' ELSE 'waiting' END AS last FROM f""")
def retry_states(spark, d):  # noqa: ANN001, ANN201
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("job_id"), "ts", "event_id", (~F.col("event_type").isin("error", "view")).alias("ok"))
    return jobs.settled(rows)


@query("str04_sweep", "SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 1800 SECONDS GROUP BY 1")
def swept(spark, d):  # noqa: ANN001, ANN201
    stale = events(spark, d).where(F.col("ts") < F.lit("2024-01-20").cast("timestamp") - F.expr("INTERVAL 1800 SECONDS")).select("event_type", "event_id")
    return finished(spark, stale).groupBy("event_type").agg(F.count("*").alias("n"))


def timed_run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """finished(), with the state store that timers need."""
    ship(spark)
    before = {k: spark.conf.get(k, None) for k in timed.ROCKS}
    try:
        for k, v in timed.ROCKS.items():
            spark.conf.set(k, v)
        return finished(spark, stream)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: What the last watermark of a stream over all events decides: their last time, in milliseconds, less ten minutes.
_DECIDED = "(SELECT epoch_ms(epoch_ms(max(ts))) - INTERVAL 10 MINUTES FROM events)"


@query("str03_timed_retries", f"""WITH RECURSIVE a AS (SELECT user_id, ts, event_type NOT IN ('error', 'view', 'click') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE ts <= {_DECIDED}),
walk AS (
  SELECT user_id, 0::BIGINT AS i, 0 AS n, NULL::TIMESTAMP AS settled, NULL::TIMESTAMP AS t, NULL::VARCHAR AS decision FROM a GROUP BY 1
  UNION ALL
  SELECT user_id, i, CASE WHEN decision = 'waiting' THEN n ELSE 0 END, CASE WHEN decision IN ('succeeded', 'dead_lettered') THEN t WHEN decision = 'waiting' THEN NULL ELSE settled END, t, decision
  FROM (SELECT a.user_id, a.i, a.ts AS t, w.settled, CASE WHEN w.settled IS NOT NULL AND a.ts <= w.settled + INTERVAL 3600 SECONDS THEN w.n ELSE CASE WHEN w.settled IS NOT NULL THEN 1 ELSE w.n + 1 END END AS n,
      CASE WHEN w.settled IS NOT NULL AND a.ts <= w.settled + INTERVAL 3600 SECONDS THEN 'ignored' WHEN a.ok THEN 'succeeded' WHEN CASE WHEN w.settled IS NOT NULL THEN 1 ELSE w.n + 1 END >= 3 THEN 'dead_lettered' ELSE 'waiting' END AS decision
    FROM walk w JOIN a ON a.user_id = w.user_id AND a.i = w.i + 1)),
said AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY i) AS following, CASE WHEN decision = 'waiting' THEN n END AS waits FROM walk WHERE i > 0),
due AS (SELECT user_id, 'retry' AS decision, t + to_seconds(2 * waits) AS t, following FROM said WHERE decision = 'waiting')
SELECT CAST(user_id AS VARCHAR) AS job_id, decision, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS at FROM said WHERE decision <> 'ignored'
UNION ALL SELECT CAST(user_id AS VARCHAR), decision, strftime(t, '%Y-%m-%d %H:%M:%S.%f') FROM due WHERE t <= {_DECIDED} AND (following IS NULL OR following > t)""")
def timed_retries(spark, d):  # noqa: ANN001, ANN201
    """Attempts of each user as a job: what is decided of each, and when a retry falls due."""
    rows = events(spark, d).select(F.col("user_id").cast("string").alias("job_id"), "ts", F.col("event_id").alias("id"), (~F.col("event_type").isin("error", "view", "click")).alias("ok"))
    return timed_run(spark, timed.retries(rows)).select("job_id", "decision", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query("str04_heartbeats", f"""SELECT CAST(user_id AS VARCHAR) AS job_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS last, strftime(ts + INTERVAL 1800 SECONDS, '%Y-%m-%d %H:%M:%S.%f') AS at
FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events WHERE ts <= {_DECIDED})
WHERE ts + INTERVAL 1800 SECONDS <= {_DECIDED} AND (following IS NULL OR following > ts + INTERVAL 1800 SECONDS)""")
def heartbeats(spark, d):  # noqa: ANN001, ANN201
    """Users not heard of for half an hour, as a stream."""
    rows = events(spark, d).select(F.col("user_id").cast("string").alias("job_id"), "ts", F.col("event_id").alias("id"), F.lit(True).alias("ok"))
    return timed_run(spark, timed.stale(rows)).select("job_id", F.date_format("last", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last"), F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query("str06_rate_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS identity, count(*) AS n, greatest(count(*) - 3, 0) AS refused FROM events GROUP BY 1, 2")
def rate_windows(spark, d):  # noqa: ANN001, ANN201
    rows = events(spark, d).select("ts", F.col("event_type").alias("identity"))
    done = finished(spark, jobs.rate_windows(rows, 3, "1 hour"), "complete")
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "identity", "n", "refused")
