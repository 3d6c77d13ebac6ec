"""Registered queries over the library and the request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import library as L
from tidemark.operators import telemetry as T
from tidemark.plans.registry import query
from tidemark.sources import projections as P

NOW = "1998-08-02 00:00:00"
QUOTA_SQL = "policies(provider, model, rpd, tpd) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::BIGINT" for x in row) + ")" for row in T.QUOTAS) + ")"
MODEL_SQL = "models(provider, model, tier, vision, context_window) AS (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in T.FALLBACKS) + ")"
ACTIONS = "actions AS (SELECT DISTINCT user_id, event_type AS action, ts FROM events)"


def _actions(spark: SparkSession, d: str) -> DataFrame:
    return P.read(spark, d, "events").select("user_id", F.col("event_type").alias("action"), "ts").dropDuplicates()


SUMMARY = "count(*) AS total_requests, round(count(*) FILTER (success) / greatest(count(*), 1), 3) AS success_rate, coalesce(round(sum(latency_ms::DECIMAL(18,2)) FILTER (success)::DOUBLE / greatest(count(*) FILTER (success), 1), 1), 0) AS mean_latency_ms, coalesce(sum(input_tokens + output_tokens), 0)::BIGINT AS total_tokens"


@query(P.sql("llm_requests", f"SELECT provider, {SUMMARY} FROM llm_requests GROUP BY provider"))
def provider_summary(spark: SparkSession, d: str) -> DataFrame:
    """A4."""
    return T.summary(P.llm_requests(spark, d), "provider")


@query(P.sql("llm_requests", f"SELECT {SUMMARY} FROM llm_requests"))
def request_summary(spark: SparkSession, d: str) -> DataFrame:
    """A3."""
    return T.summary(P.llm_requests(spark, d))


@query(P.sql("llm_requests", f"SELECT {SUMMARY} FROM llm_requests WHERE task = 'nothing'"))
def request_summary_empty(spark: SparkSession, d: str) -> DataFrame:
    """A5: one row for an empty log."""
    return T.summary(P.llm_requests(spark, d).where("task = 'nothing'"))


@query(P.sql("llm_requests", "SELECT provider, latency_ms AS p95_ms FROM r WHERE k = floor(n * 0.95)", "r AS (SELECT provider, latency_ms, row_number() OVER (PARTITION BY provider ORDER BY latency_ms) - 1 AS k, count(*) OVER (PARTITION BY provider) AS n FROM llm_requests WHERE success)"))
def provider_p95(spark: SparkSession, d: str) -> DataFrame:
    """A6 by group."""
    return T.p95_by(P.llm_requests(spark, d), "provider")


@query(P.sql("llm_requests", "SELECT latency_ms AS p95_ms FROM r WHERE k = floor(n * 0.95)", "r AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS k, count(*) OVER () AS n FROM llm_requests WHERE success)"))
def request_p95(spark: SparkSession, d: str) -> DataFrame:
    """A6 over the whole log."""
    return T.p95(P.llm_requests(spark, d))


@query(P.sql("llm_requests", "SELECT provider, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS DATE) AS quota_day, count(*) AS requests, sum(input_tokens + output_tokens)::BIGINT AS tokens FROM llm_requests GROUP BY 1, 2"))
def quota_usage(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    return T.usage(P.llm_requests(spark, d))


@query(P.sql("llm_requests", "SELECT l.request_id, l.provider, CASE WHEN e.provider IS NOT NULL THEN e.rpd ELSE q.rpd END AS rpd, CASE WHEN e.provider IS NOT NULL THEN e.tpd ELSE q.tpd END AS tpd FROM llm_requests l LEFT JOIN policies e ON e.provider = l.provider AND e.model = l.model LEFT JOIN policies q ON q.provider = l.provider AND q.model IS NULL", QUOTA_SQL))
def quota_policy(spark: SparkSession, d: str) -> DataFrame:
    """J14."""
    return T.policy_of(P.llm_requests(spark, d), T.quotas(spark)).select("request_id", "provider", "rpd", "tpd")


@query(
    P.sql(
        "llm_requests",
        "SELECT request_id, provider, before, tokens_before, coalesce(before < rpd, true) AND coalesce(tokens_before < tpd, true) AS allowed FROM u",
        QUOTA_SQL,
        """u AS (SELECT l.request_id, l.provider, CASE WHEN e.provider IS NOT NULL THEN e.rpd ELSE q.rpd END AS rpd, CASE WHEN e.provider IS NOT NULL THEN e.tpd ELSE q.tpd END AS tpd, count(*) OVER w AS before,
        coalesce(sum(input_tokens + output_tokens) OVER w, 0)::BIGINT AS tokens_before FROM llm_requests l LEFT JOIN policies e ON e.provider = l.provider AND e.model = l.model LEFT JOIN policies q ON q.provider = l.provider AND q.model IS NULL
        WINDOW w AS (PARTITION BY l.provider, CAST(ts AS DATE) ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    )
)
def quota_running(spark: SparkSession, d: str) -> DataFrame:
    """W11 with J14."""
    return T.running_quota(P.llm_requests(spark, d), T.quotas(spark))


@query(P.sql("", "SELECT event_id AS request_id, date_diff('microsecond', t, date_trunc('day', t) + INTERVAL 1 DAY) // 1000000 AS seconds_to_reset FROM (SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS t FROM events)"))
def quota_reset(spark: SparkSession, d: str) -> DataFrame:
    """W12."""
    return T.seconds_to_reset(P.llm_requests(spark, d))


@query(P.sql("", "SELECT user_id, action, ts, count(*) OVER w AS in_window, count(*) OVER w > 2 AS rejected FROM actions WINDOW w AS (PARTITION BY user_id, action ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)", ACTIONS))
def rate_limit_sliding(spark: SparkSession, d: str) -> DataFrame:
    """W9, with a day's window and two attempts."""
    return T.attempts_limit(_actions(spark, d), 2, 86_400)


ACCEPTED = """attempts AS (SELECT user_id, action, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, action ORDER BY ts) AS no FROM {actions}),
walk AS (SELECT user_id, action, ts, t, no, [t] AS kept, false AS rejected FROM attempts WHERE no = 1
UNION ALL SELECT user_id, action, ts, t, no, CASE WHEN len(held) >= 2 THEN held ELSE list_append(held, t) END, len(held) >= 2 FROM (SELECT a.*, list_filter(w.kept, lambda x: x > a.t - 86400000000) AS held FROM walk w JOIN attempts a ON a.user_id = w.user_id AND a.action = w.action AND a.no = w.no + 1))"""


@query(P.sql("", "SELECT user_id, action, ts, rejected FROM walk", ACTIONS, ACCEPTED.format(actions="actions")))
def rate_limit_accepted(spark: SparkSession, d: str) -> DataFrame:
    """A fold."""
    return T.accepted_limit(_actions(spark, d), 2, 86_400)


ROLLING = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, model ORDER BY ts DESC, request_id DESC) AS rank FROM llm_requests) WHERE rank <= 100),
stats AS (SELECT provider, model, count(*) FILTER (success) / count(*) AS rate, sum(latency_ms::DECIMAL(18,2))::DOUBLE / count(*) AS latency, count(*) AS samples FROM last GROUP BY 1, 2),
scored AS (SELECT *, round(0.7::DOUBLE * rate * 100 + 0.3::DOUBLE * greatest(0.0, 100 - 10 * (latency / 1000)), 2) AS score FROM stats)"""


@query(P.sql("llm_requests", "SELECT provider, model, round(rate, 4) AS success_rate, round(latency, 2) AS mean_latency_ms, samples, score FROM scored", ROLLING))
def provider_rolling(spark: SparkSession, d: str) -> DataFrame:
    """W6, A25, F24."""
    return T.provider_stats(P.llm_requests(spark, d))


@query(P.sql("llm_requests", "SELECT m.provider, m.model, coalesce(round(rate, 4), 1.0) AS success_rate, coalesce(round(latency, 2), 0.0) AS mean_latency_ms, coalesce(samples, 0) AS samples FROM models m LEFT JOIN stats USING (provider, model)", ROLLING, MODEL_SQL))
def model_stats(spark: SparkSession, d: str) -> DataFrame:
    """A25 of every model, tested or not."""
    return T.stats_of(T.fallbacks(spark).select("provider", "model"), T.provider_stats(P.llm_requests(spark, d)))


COOL = """marked AS (SELECT *, NOT success AND request_id % 4 = 0 AS limited FROM llm_requests),
back AS (SELECT *, sum(success::INT) OVER (PARTITION BY provider ORDER BY ts DESC, request_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS good_after FROM marked),
nth AS (SELECT *, count(*) FILTER (NOT success AND NOT limited) OVER (PARTITION BY provider ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM back WHERE good_after = 0),
rests AS (SELECT *, epoch_us(ts) + CASE WHEN limited THEN 60000000 WHEN k >= 3 THEN 120000000 END AS until FROM nth),
ends AS (SELECT provider, count(*) FILTER (NOT limited) AS failures, arg_max(until, (ts, request_id)) FILTER (until IS NOT NULL) AS until FROM rests GROUP BY 1)"""


@query(P.sql("llm_requests", "SELECT provider, coalesce(failures, 0) AS failures, coalesce(failures, 0) >= 3 AS is_open, until AS cooldown_until_us FROM (SELECT DISTINCT provider FROM llm_requests) LEFT JOIN ends USING (provider)", COOL))
def provider_cooldowns(spark: SparkSession, d: str) -> DataFrame:
    """Rests of 120 s after an opened breaker, of 60 s after a rate limit (every fourth failure is taken for one)."""
    log = P.llm_requests(spark, d)
    return T.cooldowns(log.withColumn("rate_limited", ~F.col("success") & (F.col("request_id") % 4 == 0)))


@query(P.sql("llm_requests", "SELECT m.provider, m.model, tier, vision, context_window, coalesce(score, 50.0) AS score, row_number() OVER (ORDER BY tier, coalesce(score, 50.0) DESC, m.provider, m.model) AS rank FROM models m LEFT JOIN scored USING (provider, model)", ROLLING, MODEL_SQL))
def fallback_order(spark: SparkSession, d: str) -> DataFrame:
    """O3."""
    return T.fallback_order(T.fallbacks(spark), T.provider_stats(P.llm_requests(spark, d)))


HEALTH = """newest AS (SELECT *, sum(success::INT) OVER (PARTITION BY {by} ORDER BY ts DESC, request_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS good_after FROM llm_requests),
health AS (SELECT {by}, count(*) AS requests, count(*) FILTER (success) AS successes, count(*) FILTER (good_after = 0 AND NOT success) AS consecutive_failures, max(ts) FILTER (success) AS last_success, max(ts) FILTER (NOT success) AS last_failure, count(*) FILTER (good_after = 0 AND NOT success) >= 3 AS is_open FROM newest GROUP BY {by})"""


@query(P.sql("llm_requests", "SELECT * FROM health", HEALTH.format(by="provider")))
def provider_health(spark: SparkSession, d: str) -> DataFrame:
    """W13."""
    return T.health(P.llm_requests(spark, d), "provider")


@query(P.sql("llm_requests", "SELECT * FROM health", HEALTH.format(by="provider, model, task")))
def provider_health_detail(spark: SparkSession, d: str) -> DataFrame:
    """N12."""
    return T.health(P.llm_requests(spark, d), "provider", "model", "task")


WEIGHT_SQL = f"weights(task, {', '.join('w_' + p for p in T.PARTS)}) AS (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in row) + ")" for row in T.WEIGHTS) + ")"
PARTED = """clock AS (SELECT max(ts) AS now, epoch_us(max(ts)) AS now_us FROM llm_requests),
spent AS (SELECT provider, count(*) AS used, sum(input_tokens + output_tokens) AS used_tokens FROM llm_requests, clock WHERE CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS DATE) = CAST(now AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS DATE) GROUP BY 1),
bounds AS (SELECT m.provider, m.model, m.tier, CASE WHEN x.provider IS NULL THEN p.rpd ELSE x.rpd END AS rpd, CASE WHEN x.provider IS NULL THEN p.tpd ELSE x.tpd END AS tpd FROM models m LEFT JOIN policies x ON x.provider = m.provider AND x.model = m.model LEFT JOIN policies p ON p.provider = m.provider AND p.model IS NULL),
rested AS (SELECT provider, coalesce(failures, 0) AS failed, until FROM (SELECT DISTINCT provider FROM llm_requests) LEFT JOIN ends USING (provider)),
parts AS (SELECT b.provider, b.model, b.tier, (5 - b.tier) / 4::DOUBLE AS quality, CASE WHEN coalesce(failed, 0) < 3 THEN 1.0::DOUBLE WHEN coalesce(until > now_us, false) THEN 0.0 ELSE 0.5 END AS health,
greatest(0.0::DOUBLE, coalesce(1 - round(latency, 2) / 10000, 0.5)) AS speed, least(CASE WHEN rpd IS NULL THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - coalesce(used, 0) / rpd::DOUBLE) END, CASE WHEN tpd IS NULL THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - coalesce(used_tokens, 0) / tpd::DOUBLE) END) AS quota,
coalesce(round(rate, 4), 0.5) AS reliability, least(1.0::DOUBLE, coalesce(failed, 0) / 3::DOUBLE) AS failures, CASE WHEN coalesce(until > now_us, false) THEN 1.0::DOUBLE ELSE 0.0 END AS cooldown
FROM bounds b CROSS JOIN clock LEFT JOIN stats USING (provider, model) LEFT JOIN rested r ON r.provider = b.provider LEFT JOIN spent s ON s.provider = b.provider),
candidate_scores AS (SELECT task, provider, model, tier, round(w_quality * quality + w_health * health + w_speed * speed + w_quota * quota + w_reliability * reliability - w_failures * failures - w_cooldown * cooldown, 4) AS score FROM parts, weights)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    log = P.llm_requests(spark, d)
    now = log.agg(F.max("ts").alias("now")).first()["now"]
    usage = T.usage(log).where(F.col("quota_day") == F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("America/Los_Angeles"), F.lit(now).cast("timestamp_ntz"))))
    models = T.fallbacks(spark).withColumn("quality", (5 - F.col("tier")) / 4)
    cooled = T.cooldowns(log.withColumn("rate_limited", ~F.col("success") & (F.col("request_id") % 4 == 0)))
    return T.candidate_parts(models, T.provider_stats(log), cooled, usage, T.quotas(spark), F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp")))


@query(P.sql("llm_requests", "SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, tier, provider, model) AS rank FROM candidate_scores", ROLLING, MODEL_SQL, QUOTA_SQL, COOL, WEIGHT_SQL, PARTED))
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every model for every task by what the log says of it at its end; the weights are parameters."""
    return T.candidate_scores(_parts(spark, d), T.weights(spark))


TODAY = "today AS (SELECT provider, count(*) AS requests FROM llm_requests WHERE CAST(ts AS DATE) = DATE '2024-01-30' GROUP BY provider)"
FIT = "fit AS (SELECT m.provider, m.model, m.tier FROM models m LEFT JOIN health h USING (provider) LEFT JOIN today t USING (provider) LEFT JOIN policies q ON q.provider = m.provider AND q.model IS NULL WHERE context_window >= 16000 AND NOT coalesce(is_open, false) AND coalesce(coalesce(t.requests, 0) < q.rpd, true))"


def _fit(spark: SparkSession, d: str) -> DataFrame:
    log = P.llm_requests(spark, d)
    today = log.where(F.to_date("ts") == F.lit("2024-01-30").cast("date")).groupBy("provider").agg(F.count("*").alias("requests"))
    return T.candidates(T.fallbacks(spark), T.health(log, "provider"), today, T.quotas(spark), vision=False, context=16_000)


@query(P.sql("llm_requests", "SELECT * FROM fit", HEALTH.format(by="provider"), QUOTA_SQL, MODEL_SQL, TODAY, FIT))
def routing_candidates(spark: SparkSession, d: str) -> DataFrame:
    """J15."""
    return _fit(spark, d)


@query(P.sql("llm_requests", "SELECT provider, model, tier, row_number() OVER (ORDER BY CASE WHEN provider = 'p3' THEN 0 ELSE 1 END, tier, provider, model) AS position FROM fit", HEALTH.format(by="provider"), QUOTA_SQL, MODEL_SQL, TODAY, FIT))
def preferred_first(spark: SparkSession, d: str) -> DataFrame:
    """J16, U4."""
    return T.preferred_first(_fit(spark, d), "p3")


@query(P.sql("llm_requests", "SELECT task, sum(n)::BIGINT AS requests, sum(failed)::BIGINT AS failures, round((sum(n) - count(*)) / sum(n), 4) AS retry_rate, round(sum(ms)::DOUBLE / sum(n), 2) AS mean_latency_ms FROM calls GROUP BY task", "calls AS (SELECT task, video_id, count(*) AS n, count(*) FILTER (NOT success) AS failed, sum(latency_ms::DECIMAL(18,2)) AS ms FROM llm_requests GROUP BY 1, 2)"))
def stage_metrics(spark: SparkSession, d: str) -> DataFrame:
    """N7."""
    return T.stage_metrics(P.llm_requests(spark, d))


@query(P.sql("llm_requests", "SELECT request_id, ts, task FROM llm_requests ORDER BY ts DESC, request_id DESC LIMIT 100"))
def last_requests(spark: SparkSession, d: str) -> DataFrame:
    """The last records in append order."""
    return P.llm_requests(spark, d).select("request_id", "ts", "task").orderBy(F.desc("ts"), F.desc("request_id")).limit(100)


@query(P.sql("llm_requests", "SELECT model, CASE WHEN starts_with(model, 'm0') THEN 'alpha' WHEN starts_with(model, 'm1') THEN 'beta' ELSE 'other' END AS owner, count(*) AS n FROM llm_requests GROUP BY 1, 2"))
def provider_of_model(spark: SparkSession, d: str) -> DataFrame:
    """F25."""
    return P.llm_requests(spark, d).groupBy("model", T.provider_of(F.col("model")).alias("owner")).agg(F.count("*").alias("n"))


# The library


@query(P.sql("videos", "SELECT * FROM videos WHERE user_id = 7 ORDER BY created_at DESC, video_id"))
def owned_videos(spark: SparkSession, d: str) -> DataFrame:
    """P1, P23."""
    return L.owned(P.videos(spark, d), 7)


@query(P.sql("videos", f"SELECT video_id, user_id, created_at + retention_days * INTERVAL 1 DAY AS expires_at FROM videos WHERE created_at + retention_days * INTERVAL 1 DAY < TIMESTAMP '{NOW}'"))
def expired_videos(spark: SparkSession, d: str) -> DataFrame:
    """P2, P3, T8."""
    return L.expired(P.videos(spark, d), F.lit(NOW).cast("timestamp_ntz")).select("video_id", "user_id", "expires_at")


@query(P.sql("videos transcripts", f"SELECT (SELECT count(*) FROM gone) AS videos, (SELECT count(*) FROM transcripts SEMI JOIN gone USING (video_id)) AS transcripts, (SELECT coalesce(sum(file_size_bytes), 0)::BIGINT FROM gone) AS bytes", f"gone AS (SELECT * FROM videos WHERE created_at + retention_days * INTERVAL 1 DAY < TIMESTAMP '{NOW}')"))
def cleanup_counts(spark: SparkSession, d: str) -> DataFrame:
    """A26."""
    gone = L.expired(P.videos(spark, d), F.lit(NOW).cast("timestamp_ntz"))
    lost = P.transcripts(spark, d).join(gone, "video_id", "left_semi").agg(F.count("*").alias("transcripts"))
    return gone.agg(F.count("*").alias("videos"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes")).join(F.broadcast(lost), F.lit(True))  # a row each


@query(P.sql("videos", "SELECT video_id, CASE WHEN NOT retention_days BETWEEN 1 AND 30 THEN 'RETENTION_OUT_OF_RANGE' WHEN source_type NOT IN ('UPLOAD', 'YOUTUBE') THEN 'UNSUPPORTED_TYPE' WHEN file_size_bytes > 40000000 THEN 'FILE_TOO_LARGE' WHEN coalesce(duration_s > 7200, false) THEN 'TOO_LONG' END AS reject_reason FROM (SELECT video_id, file_size_bytes, CASE WHEN video_id % 9 = 0 THEN NULL ELSE duration_s + 500 END AS duration_s, CASE WHEN video_id % 13 = 0 THEN 'OTHER' ELSE source_type END AS source_type, retention_days + 1 AS retention_days FROM videos)"))
def admission(spark: SparkSession, d: str) -> DataFrame:
    """P4, P5, P6."""
    v = P.videos(spark, d)
    asked = v.withColumn("duration_s", F.when(F.col("video_id") % 9 == 0, None).otherwise(F.col("duration_s") + 500)).withColumn("source_type", F.when(F.col("video_id") % 13 == 0, "OTHER").otherwise(F.col("source_type"))).withColumn("retention_days", F.col("retention_days") + 1)
    return L.admission(asked, max_bytes=40_000_000).select("video_id", "reject_reason")


@query(P.sql("videos", "SELECT count(*) FILTER (user_id % 10 <> 0) AS kept, count(*) FILTER (user_id % 10 = 0) AS rejected FROM videos"))
def owner_required(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an owner go before one is required."""
    v = P.videos(spark, d).withColumn("user_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")))
    return v.agg(F.count("user_id").alias("kept"), F.count_if(F.col("user_id").isNull()).alias("rejected"))


@query(P.sql("videos", "SELECT video_id, status FROM videos WHERE status IN ('UPLOADING', 'QUEUED', 'PROCESSING')"))
def in_flight(spark: SparkSession, d: str) -> DataFrame:
    """P22."""
    return P.videos(spark, d).where(F.col("status").isin(*L.IN_FLIGHT)).select("video_id", "status")


@query(P.sql("videos", "SELECT user_id, count(*) AS n_videos, coalesce(sum(duration_s), 0)::BIGINT AS total_s, round_even(coalesce(sum(duration_s), 0) / 60, 0)::BIGINT AS minutes FROM videos GROUP BY user_id"))
def user_analytics(spark: SparkSession, d: str) -> DataFrame:
    """A1."""
    return L.user_totals(P.videos(spark, d))


@query(P.sql("videos", "SELECT user_id, sum(file_size_bytes)::BIGINT AS media_bytes, floor(sum(file_size_bytes) * 0.001::DOUBLE)::BIGINT AS transcript_bytes, (sum(file_size_bytes) + floor(sum(file_size_bytes) * 0.001::DOUBLE))::BIGINT AS total_bytes FROM videos GROUP BY user_id"))
def user_storage(spark: SparkSession, d: str) -> DataFrame:
    """A2."""
    return L.user_storage(P.videos(spark, d))


@query(P.sql("videos transcripts", "SELECT user_id, sum(word_count)::BIGINT AS words FROM videos JOIN transcripts USING (video_id) GROUP BY user_id"))
def user_words(spark: SparkSession, d: str) -> DataFrame:
    """J1."""
    return L.user_words(P.videos(spark, d), P.transcripts(spark, d))


@query(P.sql("videos transcripts", "SELECT video_id, user_id, status, word_count, word_count IS NOT NULL AS has_transcript FROM videos LEFT JOIN transcripts USING (video_id)"))
def video_details(spark: SparkSession, d: str) -> DataFrame:
    """J2."""
    return L.details(P.videos(spark, d), P.transcripts(spark, d))


@query(P.sql("videos", "SELECT video_id, created_at FROM videos ORDER BY created_at DESC, video_id DESC LIMIT 1"))
def latest_video(spark: SparkSession, d: str) -> DataFrame:
    """O4."""
    return P.videos(spark, d).select("video_id", "created_at").orderBy(F.desc("created_at"), F.desc("video_id")).limit(1)


@query(P.sql("videos", "SELECT video_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at + retention_days * INTERVAL 1 DAY, video_id) AS rank FROM videos"))
def videos_by_expiry(spark: SparkSession, d: str) -> DataFrame:
    """O7, within each owner."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("expires_at", "video_id")
    return L.with_expiry(P.videos(spark, d)).select("video_id", F.row_number().over(w).alias("rank"))


@query(P.sql("videos", "SELECT video_id, kind, status, error, is_new FROM merged", """state AS (SELECT video_id, 'quiz' AS kind, CASE WHEN video_id % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN video_id % 3 = 0 THEN 'timeout' END AS error FROM videos WHERE video_id % 2 = 0),
asked AS (SELECT video_id, 'quiz' AS kind, true AS asked FROM videos WHERE video_id % 5 = 0), merged AS (SELECT video_id, kind, CASE WHEN coalesce(asked, false) THEN 'PENDING' ELSE status END AS status, CASE WHEN coalesce(asked, false) THEN NULL ELSE error END AS error, status IS NULL AS is_new FROM state FULL JOIN asked USING (video_id, kind))"""))
def artifact_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A full outer join replaces the upsert."""
    v = P.videos(spark, d)
    bad = F.col("video_id") % 3 == 0
    state = v.where("video_id % 2 = 0").select("video_id", F.lit("quiz").alias("kind"), F.when(bad, "FAILED").otherwise("COMPLETED").alias("status"), F.when(bad, "timeout").alias("error"))
    return L.upsert_artifacts(state, v.where("video_id % 5 = 0").select("video_id", F.lit("quiz").alias("kind")))


@query(P.sql("videos", "SELECT video_id, regexp_replace(CAST(round(file_size_bytes / p, 1) AS VARCHAR), '\\.0$', '') || ' ' || unit AS size FROM (SELECT video_id, file_size_bytes, CASE WHEN file_size_bytes >= 1099511627776 THEN 1099511627776.0::DOUBLE WHEN file_size_bytes >= 1073741824 THEN 1073741824.0::DOUBLE WHEN file_size_bytes >= 1048576 THEN 1048576.0::DOUBLE WHEN file_size_bytes >= 1024 THEN 1024.0::DOUBLE ELSE 1.0::DOUBLE END AS p, CASE WHEN file_size_bytes >= 1099511627776 THEN 'TB' WHEN file_size_bytes >= 1073741824 THEN 'GB' WHEN file_size_bytes >= 1048576 THEN 'MB' WHEN file_size_bytes >= 1024 THEN 'KB' ELSE 'B' END AS unit FROM videos)"))
def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    """F27."""
    return P.videos(spark, d).select("video_id", L.human_bytes(F.col("file_size_bytes")).alias("size"))


@query(P.sql("videos", f"SELECT video_id, date_diff('microsecond', created_at, TIMESTAMP '{NOW}') // 1000000 AS elapsed_s FROM videos WHERE created_at <= TIMESTAMP '{NOW}'"))
def processing_time(spark: SparkSession, d: str) -> DataFrame:
    """F33."""
    now = F.lit(NOW).cast("timestamp_ntz")
    return P.videos(spark, d).where(F.col("created_at") <= now).select("video_id", F.timestamp_diff("SECOND", "created_at", now).alias("elapsed_s"))


@query(P.sql("videos", "SELECT video_id // 50 AS batch, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) AS jobs, CASE WHEN count(*) FILTER (status = 'COMPLETED') = count(*) THEN 'SUCCESS' WHEN count(*) FILTER (status = 'COMPLETED') > 0 THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS outcome FROM videos GROUP BY 1"))
def batch_rollup(spark: SparkSession, d: str) -> DataFrame:
    """N10."""
    done = F.count_if(F.col("status") == "COMPLETED")
    return P.videos(spark, d).groupBy(F.floor(F.col("video_id") / 50).alias("batch")).agg(done.alias("completed"), F.count("*").alias("jobs"), F.when(done == F.count("*"), "SUCCESS").when(done > 0, "PARTIAL_SUCCESS").otherwise("FAILED").alias("outcome"))
