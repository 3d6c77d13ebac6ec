"""Queries over the lecture library: ownership, retention, admission, storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of an upload.
MAX_DURATION_S = 7200
MAX_BYTES = 2 * 1024**3
MIN_RETENTION, MAX_RETENTION = 1, 30
IN_FLIGHT = ("UPLOADING", "QUEUED", "PROCESSING")


def owned(videos: DataFrame, user_id: int) -> DataFrame:
    """A user's videos, newest first."""
    return videos.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "video_id")


def with_expiry(videos: DataFrame) -> DataFrame:
    """expires_at, a whole number of days after created_at."""
    return videos.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(F.col("retention_days").cast("int")))


def expired(videos: DataFrame, now: Column) -> DataFrame:
    return with_expiry(videos).where(F.col("expires_at").isNotNull() & (F.col("expires_at") < now))


def admission(videos: DataFrame, kinds: tuple[str, ...] = ("UPLOAD", "YOUTUBE"), max_bytes: int = MAX_BYTES) -> DataFrame:
    """The first reason against each upload, null when it is let in. An unknown length passes."""
    reason = (
        F.when(~F.col("retention_days").between(MIN_RETENTION, MAX_RETENTION), "RETENTION_OUT_OF_RANGE")
        .when(~F.col("source_type").isin(*kinds), "UNSUPPORTED_TYPE")
        .when(F.col("file_size_bytes") > max_bytes, "FILE_TOO_LARGE")
        .when(F.coalesce(F.col("duration_s") > MAX_DURATION_S, F.lit(False)), "TOO_LONG")
    )
    return videos.withColumn("reject_reason", reason)


def user_totals(videos: DataFrame) -> DataFrame:
    """Count, seconds (0 when unknown) and whole minutes (halves to even) of each user."""
    seconds = F.coalesce(F.sum("duration_s"), F.lit(0))
    return videos.groupBy("user_id").agg(F.count("*").alias("n_videos"), seconds.alias("total_s"), F.bround(seconds / 60).cast("long").alias("minutes"))


def user_storage(videos: DataFrame) -> DataFrame:
    """Bytes of media, estimated bytes of transcripts (a thousandth, cut off) and their sum."""
    size = F.coalesce(F.sum("file_size_bytes"), F.lit(0))
    return videos.groupBy("user_id").agg(size.alias("media_bytes")).withColumn("transcript_bytes", F.floor(F.col("media_bytes") * 0.001).cast("long")).withColumn("total_bytes", F.col("media_bytes") + F.col("transcript_bytes"))


def user_words(videos: DataFrame, transcripts: DataFrame) -> DataFrame:
    return transcripts.join(videos, "video_id").groupBy("user_id").agg(F.sum("word_count").alias("words"))


def details(videos: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Videos with their transcript's word count, null without one."""
    return videos.join(transcripts, "video_id", "left").select("video_id", "user_id", "status", "word_count", F.col("word_count").isNotNull().alias("has_transcript"))


def upsert_artifacts(state: DataFrame, requests: DataFrame) -> DataFrame:
    """State after requests (video_id, kind): an artifact that is asked for is PENDING with its error cleared, a new one is added."""
    both = state.join(requests.select("video_id", "kind", F.lit(True).alias("asked")).distinct(), ["video_id", "kind"], "full_outer")
    asked = F.coalesce("asked", F.lit(False))
    return both.select("video_id", "kind", F.when(asked, "PENDING").otherwise(F.col("status")).alias("status"), F.when(asked, None).otherwise(F.col("error")).alias("error"), F.col("status").isNull().alias("is_new"))


def human_bytes(size: Column) -> Column:
    """1536 -> '1.5 KB'; 0 -> '0 B'."""
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB")))
    power = F.when(size >= 1 << 40, 4).when(size >= 1 << 30, 3).when(size >= 1 << 20, 2).when(size >= 1 << 10, 1).otherwise(0)
    value = F.round(size / F.pow(F.lit(1024.0), power), 1)
    return F.concat_ws(" ", F.regexp_replace(value.cast("string"), r"\.0$", ""), F.element_at(units, power + 1))
