"""The engine's record types, derived from the test tables.

Each function gives one record type of the data model (segments, frames, videos,
request log ...) from the driver's tables, by integer arithmetic, ``split`` and
windows within a key. ``VIEWS`` has the same definitions in ANSI SQL, by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed segments: a row for each line of a document, 16 characters a second, with pauses."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("video_id"), "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    lines = lines.withColumn("idx", (F.col("pos") + 1).cast("long")).withColumn("n", F.length("text").cast("long"))
    before = Window.partitionBy("video_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    step = F.col("n") + F.when((F.col("video_id") * 31 + F.col("idx")) % 7 == 0, 200).otherwise(0)
    start = F.coalesce(F.sum(step).over(before), F.lit(0))
    return lines.withColumn("at", start).select("video_id", "idx", (F.col("at") / 16).alias("start_s"), ((F.col("at") + F.col("n")) / 16).alias("end_s"), "text", "lang")


def raw_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption cues as they come: some blank, negative or of no length."""
    k = F.col("idx") % 50
    return segments(spark, sf_dir).select(
        "video_id", "idx", "lang",
        F.when(k == 7, F.lit("  ")).otherwise(F.col("text")).alias("text"),
        F.when(k == 13, F.lit(-1.0)).otherwise(F.col("start_s")).alias("start_s"),
        F.when(k == 21, F.lit(0.0)).otherwise(F.col("end_s") - F.col("start_s")).alias("duration_s"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each lecture: media length (unknown for some), requested and actual language, transcript source."""
    ends = segments(spark, sf_dir).groupBy("video_id", "lang").agg(F.max("end_s").alias("last"))
    v = F.col("video_id")
    length = F.when(v % 11 == 0, None).when(v % 3 == 0, F.col("last") * 2).when(v % 2 == 0, F.col("last") + 8).otherwise(F.col("last"))
    source = F.element_at(F.array(*map(F.lit, ("manual_caption", "generated_caption", "translated_caption", "stt"))), (v % 4 + 1).cast("int"))
    return ends.select("video_id", length.alias("media_s"), F.lit("en").alias("requested"), F.col("lang").alias("actual"), source.alias("source_type"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key frames: one for each odd segment, with recognised text, blur score and perceptual hash."""
    s = segments(spark, sf_dir).where("idx % 2 = 1")
    v, i = F.col("video_id"), F.col("idx")
    return s.select(
        "video_id", "idx", (F.floor((i - 1) / 4) + 1).alias("scene_number"), (F.col("start_s") * 1000 + 500).cast("long").alias("timestamp_ms"),
        ((F.col("end_s") - F.col("start_s")) * 1000).cast("long").alias("duration_ms"), F.col("text").alias("clean_text"),
        (((v * 7919 + i * 104729) % 1000) / 8).alias("blur_score"), F.substring(F.md5(F.concat_ws("-", v.cast("string"), F.floor(i / 3).cast("string"))), 1, 16).alias("phash"),
        (((v * 31 + i * 17) % 100) / 100).alias("average_confidence"),
    )


def scenes_of(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id", "scene_number").agg(F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"), F.count("*").alias("frame_count"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes_of(frames(spark, sf_dir))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library: a row for each order."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise("FAILED")
    return o.select(
        k.alias("video_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"), F.floor("o_totalprice").cast("long").alias("price"),
        (F.floor("o_totalprice") % 7200).alias("duration_s"), (k * 4096).alias("file_size_bytes"), (k % 30 + 1).alias("retention_days"), F.when(k % 2 == 0, "UPLOAD").otherwise("YOUTUBE").alias("source_type"),
    )


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript for each video that has lines; some videos have none."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("video_id")).agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("word_count"))


def llm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only request log."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("request_id"), "ts", F.concat(F.lit("p"), (F.col("user_id") % 6).cast("string")).alias("provider"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.col("event_type").alias("task"), F.round(F.col("value") * 100, 2).alias("latency_ms"), (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 997).alias("input_tokens"),
        (F.col("event_id") % 331).alias("output_tokens"), F.col("user_id").alias("video_id"),
    )


#: The same record types in SQL, for the oracle.
VIEWS = {
    "lines": "lines AS (SELECT video_id, lang, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS idx FROM (SELECT doc_id AS video_id, lang, string_split(text, chr(10)) AS ls FROM documents))",
    "segments": """placed AS (SELECT *, length(text) AS n, coalesce(sum(length(text) + CASE WHEN (video_id * 31 + idx) % 7 = 0 THEN 200 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at16 FROM lines),
        segments AS (SELECT video_id, idx, at16::DOUBLE / 16 AS start_s, (at16 + n)::DOUBLE / 16 AS end_s, text, lang FROM placed)""",
    "raw_cues": "raw_cues AS (SELECT video_id, idx, lang, CASE WHEN idx % 50 = 7 THEN '  ' ELSE text END AS text, CASE WHEN idx % 50 = 13 THEN -1.0::DOUBLE ELSE start_s END AS start_s, CASE WHEN idx % 50 = 21 THEN 0.0::DOUBLE ELSE end_s - start_s END AS duration_s FROM segments)",
    "media": """media AS (SELECT video_id, CASE WHEN video_id % 11 = 0 THEN NULL WHEN video_id % 3 = 0 THEN max(end_s) * 2 WHEN video_id % 2 = 0 THEN max(end_s) + 8 ELSE max(end_s) END AS media_s, 'en' AS requested, lang AS actual,
        ['manual_caption', 'generated_caption', 'translated_caption', 'stt'][video_id % 4 + 1] AS source_type FROM segments GROUP BY video_id, lang)""",
    "frames": """frames AS (SELECT video_id, idx, (idx - 1) // 4 + 1 AS scene_number, CAST(floor(start_s * 1000 + 500) AS BIGINT) AS timestamp_ms, CAST(floor((end_s - start_s) * 1000) AS BIGINT) AS duration_ms, text AS clean_text,
        ((video_id * 7919 + idx * 104729) % 1000)::DOUBLE / 8 AS blur_score, substr(md5(video_id || '-' || (idx // 3)), 1, 16) AS phash, ((video_id * 31 + idx * 17) % 100)::DOUBLE / 100 AS average_confidence FROM segments WHERE idx % 2 = 1)""",
    "scenes": "scenes AS (SELECT video_id, scene_number, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS frame_count FROM frames GROUP BY 1, 2)",
    "videos": """videos AS (SELECT o_orderkey AS video_id, o_custkey AS user_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'FAILED' END AS status, floor(o_totalprice)::BIGINT AS price, floor(o_totalprice)::BIGINT % 7200 AS duration_s,
        o_orderkey * 4096 AS file_size_bytes, o_orderkey % 30 + 1 AS retention_days, CASE WHEN o_orderkey % 2 = 0 THEN 'UPLOAD' ELSE 'YOUTUBE' END AS source_type FROM orders)""",
    "transcripts": "transcripts AS (SELECT l_orderkey AS video_id, arg_min(l_partkey, (l_linenumber, l_partkey)) AS word_count FROM lineitem GROUP BY 1)",
    "llm_requests": """llm_requests AS (SELECT event_id AS request_id, ts, 'p' || (user_id % 6) AS provider, 'm' || (user_id % 3) AS model, event_type AS task, round(value * 100, 2) AS latency_ms, event_type <> 'error' AS success, event_id % 997 AS input_tokens, event_id % 331 AS output_tokens, user_id AS video_id FROM events)""",
}
NEEDS = {"segments": ["lines"], "raw_cues": ["segments"], "media": ["segments"], "frames": ["segments"], "scenes": ["frames"]}


def sql(views: str, query: str, *more: str) -> str:
    """query with the named views, those they need, and more of its own before it."""
    names: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in names:
            names.append(name)

    for name in views.split():
        add(name)
    parts = [*(VIEWS[n] for n in names), *more]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + query
