"""Registered queries that run a stream over a table to its end and return what it holds then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.plans.telemetry_queries import ACCEPTED, COOL
from tidemark.sources import projections as P
from tidemark.sources.folders import new_folder
from tidemark.streaming import jobs as J


#: Files in a batch, which bounds the rows of a key that a batch brings.
FILES = 64


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream."""
    schema = P.read(spark, d, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{d}/events.parquet*")


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all there is and reads what it wrote; the shared folder holds its files and its log."""
    base = new_folder(spark, "stream")
    before = spark.conf.get(J.STORE[0], None)
    spark.conf.set(*J.STORE)
    try:
        if mode == "append":
            q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start()
        else:
            last = lambda df, n: df.withColumn("epoch", F.lit(n)).write.mode("append").parquet(f"{base}/out")
            q = stream.writeStream.foreachBatch(last).option("checkpointLocation", f"{base}/log").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(J.STORE[0]) if before is None else spark.conf.set(J.STORE[0], before)
    return spark.read.parquet(f"{base}/out").drop("epoch") if mode == "append" else spark.read.parquet(f"{base}/out")


def _latest(df: DataFrame, *keys: str) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("epoch")))).where("r = 1").drop("r", "epoch")


def _log(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("request_id"), "ts", F.concat(F.lit("p"), (F.col("user_id") % 6).cast("string")).alias("provider"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.round(F.col("value") * 100, 2).alias("latency_ms"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 997).alias("input_tokens"), (F.col("event_id") % 331).alias("output_tokens"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query("SELECT user_id AS video_id, arg_max(event_type, ts) AS status, max(ts)::TIMESTAMP AS ts, arg_max(event_type, ts) IN ('READY_FOR_SELECTION', 'COMPLETED', 'FAILED') AS done FROM events GROUP BY user_id")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """T1."""
    return _latest(_drained(spark, J.progress(_stream(spark, d).select(F.col("user_id").alias("video_id"), F.col("event_type").alias("status"), "ts")), "update"), "video_id")


@query(P.sql("", "SELECT user_id, action, t AS at, rejected FROM walk", "actions AS (SELECT user_id, event_type AS action, ts FROM events)", ACCEPTED.format(actions="actions")))
def stream_limiter(spark: SparkSession, d: str) -> DataFrame:
    """The live twin of rate_limit_accepted."""
    a = _stream(spark, d).select("user_id", F.col("event_type").alias("action"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return _drained(spark, J.limiter(a, 2, 86_400), "append")


@query("SELECT provider, CAST(t AS DATE) AS quota_day, count(*) AS requests, sum(tokens)::BIGINT AS tokens FROM (SELECT 'p' || (user_id % 6) AS provider, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS t, event_id % 997 + event_id % 331 AS tokens FROM events) WHERE CAST(t AS DATE) < (SELECT CAST(max(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles') - INTERVAL 1 HOUR AS DATE) FROM events) GROUP BY 1, 2")
def stream_quota(spark: SparkSession, d: str) -> DataFrame:
    """Closed days."""
    return _drained(spark, J.daily_quota(_log(_stream(spark, d))), "append")


@query()
def stream_rolling(spark: SparkSession, d: str) -> DataFrame:
    """T4: the live twin of provider_rolling."""
    return _latest(_drained(spark, J.rolling(_log(_stream(spark, d))), "update"), "provider", "model")


@query()
def stream_summary(spark: SparkSession, d: str) -> DataFrame:
    """T5."""
    return _latest(_drained(spark, J.log_summary(_log(_stream(spark, d))), "update"), "provider", "hour")


@query("SELECT DISTINCT 'video_' || user_id AS job_id FROM events")
def stream_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs seen in one run, a user's events being the same job."""
    return _drained(spark, J.unique_jobs(_stream(spark, d).select(F.concat(F.lit("video_"), F.col("user_id").cast("string")).alias("job_id"), "ts")), "append").select("job_id").distinct()


@query(P.sql("llm_requests", """SELECT provider, coalesce(failures, 0) AS failures, until AS cooldown_until_us, CASE WHEN coalesce(failures, 0) < 3 THEN 'CLOSED' WHEN (until + 999) // 1000 <= watermark THEN 'HALF_OPEN' ELSE 'OPEN' END AS state, coalesce((until + 999) // 1000 <= watermark, true) AS can_execute
FROM (SELECT DISTINCT provider FROM llm_requests) LEFT JOIN ends USING (provider), (SELECT epoch_ms(max(ts)) - 600000 AS watermark FROM llm_requests)""", COOL))
def stream_health(spark: SparkSession, d: str) -> DataFrame:
    """As provider_cooldowns, and whether a provider may be tried at the watermark that the stream ends with."""
    log = _log(_stream(spark, d)).withColumn("rate_limited", ~F.col("success") & (F.col("request_id") % 4 == 0))
    return _latest(_drained(spark, J.breaker(log), "update"), "provider")


@query()
def stream_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """T5: p95 of each provider from hourly sketches of the stream; within the sketch's rank error of A6 (tested)."""
    hours = _latest(_drained(spark, J.latency_sketches(_log(_stream(spark, d))), "update"), "provider", "hour")
    return J.merged_quantile(hours, "provider").withColumnRenamed("quantile", "p95_ms")
