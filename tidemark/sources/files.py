"""Readers and writers of the engine's files: request logs, transcripts, exports, lectures, stage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import folders

LOG = "ts timestamp, task string, provider string, model string, latency_ms double, input_tokens long, output_tokens long, total_tokens long, success boolean, error_type string, video_id long, request_id long"
SEGMENTS = "array<struct<text: string, start: double, end: double, duration: double>>"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A request log in JSON Lines."""
    return spark.read.schema(LOG).json(path)


def log_records(requests: DataFrame) -> DataFrame:
    """Requests as log records: tokens summed, latency rounded."""
    out = requests.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("latency_ms", F.round("latency_ms", 2)).withColumn("error_type", F.when(~F.col("success"), F.lit("ERROR")))
    return out.select(*[c.split()[0] for c in LOG.split(", ")])


def append_log(requests: DataFrame, path: str) -> None:
    log_records(requests).write.mode("append").json(path)


def read_transcripts(spark: SparkSession, path: str, name: str = r"([^/]+)\.[^.]+$") -> DataFrame:
    """Transcript files of either shape, a list of segments or an object with metadata and segments: a row a segment, keyed by what name finds in the path, by default the file name."""
    return _transcript_rows(spark.read.text(path, wholetext=True).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), name, 1)))


def _transcript_rows(whole: DataFrame) -> DataFrame:
    """The segments of transcripts (file, value)."""
    listed = F.from_json("value", SEGMENTS)
    held = F.from_json("value", f"struct<segments: {SEGMENTS}>")["segments"]
    rows = whole.select("file", F.posexplode(F.when(F.ltrim("value").startswith("["), listed).otherwise(held)).alias("pos", "s"))
    end = F.coalesce("s.end", F.col("s.start") + F.col("s.duration"), "s.start")
    return rows.select("file", (F.col("pos") + 1).cast("long").alias("idx"), F.coalesce("s.start", F.lit(0.0)).alias("start_s"), end.alias("end_s"), F.coalesce("s.text", F.lit("")).alias("text"))


def keep_transcripts(bodies: DataFrame, path: str) -> None:
    """The transcripts (file, value) of a whole library, thousands of lectures packed in a Parquet file: one file each takes longer to make than to fill."""
    bodies.select("file", "value").write.mode("overwrite").parquet(path)


def kept_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Packed transcripts, as read_transcripts."""
    return _transcript_rows(spark.read.parquet(path))


def write_exports(bodies: DataFrame, path: str) -> None:
    """A file for each lecture and format, to be handed out, in the folder that they name; it holds the body and ends with a line end. What a lecture had before in that format is replaced, all else stays."""
    rows = bodies.select("format", "video_id", F.regexp_replace("body", r"\n\z", "").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("format", "video_id").text(path)


def export_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, format, bytes, sha256, content) of the export files as they are on disk."""
    found = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, format string, video_id long").load(path)
    return found.select("video_id", "format", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def keep_exports(bodies: DataFrame, path: str, buckets: int | None = None) -> None:
    """The exports of a whole library, thousands of lectures packed in a Parquet file: one file each would be billions of small ones. All formats of the lectures given are replaced, others stay."""
    ended = F.concat(F.regexp_replace("body", r"\n\z", ""), F.lit("\n"))
    replace_frames(bodies, {"exports": bodies.select("video_id", "format", F.encode(ended, "UTF-8").alias("content"))}, path, buckets or BUCKETS, own=True)


def kept_exports(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, format, bytes, sha256, content) of packed exports, as export_files."""
    kept = read_frames(spark, path, "exports")
    return kept.select("video_id", "format", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def export_states(expected: DataFrame, found: DataFrame) -> DataFrame:
    """The manifest of expected exports (video_id, format): size and digest of the file, READY, or MISSING where there is none."""
    out = expected.select("video_id", "format").distinct().join(found.select("video_id", "format", "bytes", "sha256"), ["video_id", "format"], "left")
    return out.withColumn("status", F.when(F.col("sha256").isNull(), "MISSING").otherwise("READY"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Captured responses by provider and key, which a file (provider__key.json) or a folder (name=provider__key) names; a row a line of the latter."""
    place = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+?__[^/.]+)(?:/[^/]*|\.[^/.]+)$", 1)
    return spark.read.text(path).select(F.split_part(place, F.lit("__"), F.lit(1)).alias("provider"), F.split_part(place, F.lit("__"), F.lit(2)).alias("key"), F.col("value").alias("content"))


#: A saved lecture. Free-form metadata and statistics are maps.
LECTURE = (
    "video_id string, metadata map<string, string>, statistics map<string, double>, sections array<struct<section_id: string, start_time: double, end_time: double, scene_numbers: array<long>, "
    "transcript_segments: array<struct<text: string, start: double, end: double>>, frames: array<struct<frame_path: string, timestamp_sec: double, scene_number: long, ocr_text: string, importance_score: double, transcript_similarity: double>>>>"
)


def write_lectures(lectures: DataFrame, path: str) -> None:
    """Lectures by LECTURE as JSON, one a line, packed by gzip; empty values are left out and come back as defaults."""
    lectures.write.mode("overwrite").option("compression", "gzip").json(path)


def read_lectures(spark: SparkSession, path: str) -> DataFrame:
    """Saved lectures by LECTURE with ``fault``: a missing list or map is empty, a missing score is 0, at every depth; a lecture without
    its own id, a section without id or times, or a frame without path, time or scene has the fault MISSING_KEY; text that isn't JSON is UNREADABLE. A null counts as missing."""
    held = spark.read.schema(f"{LECTURE}, broken string").option("columnNameOfCorruptRecord", "broken").option("mode", "PERMISSIVE").json(path)
    none = lambda kind: F.array().cast(kind)
    types = {f.name: f.dataType for f in held.schema["sections"].dataType.elementType.fields}
    frame = lambda x: x.withField("importance_score", F.coalesce(x["importance_score"], F.lit(0.0))).withField("transcript_similarity", F.coalesce(x["transcript_similarity"], F.lit(0.0)))

    def section(x: Column) -> Column:
        for name in ("scene_numbers", "transcript_segments"):
            x = x.withField(name, F.coalesce(x[name], none(types[name])))
        return x.withField("frames", F.coalesce(F.transform(x["frames"], frame), none(types["frames"])))

    lacking = lambda x, *names: F.coalesce(*[F.when(x[n].isNull(), True) for n in names], F.lit(False))
    bad_section = lambda x: lacking(x, "section_id", "start_time", "end_time") | F.exists(x["frames"], lambda f: lacking(f, "frame_path", "timestamp_sec", "scene_number"))
    out = held.withColumn("sections", F.coalesce(F.transform("sections", section), none(held.schema["sections"].dataType)))
    for name in ("metadata", "statistics"):
        out = out.withColumn(name, F.coalesce(name, F.create_map().cast(held.schema[name].dataType)))
    fault = F.when(F.col("broken").isNotNull(), "UNREADABLE").when(F.col("video_id").isNull() | F.exists("sections", bad_section), "MISSING_KEY")
    return out.withColumn("fault", fault).drop("broken")


#: Folders of each frame table; a lecture's rows lie in one of them.
BUCKETS = 64


#: Lectures up to which their ids are sent to every task (16 bytes each), so that no table has to move; more are met by a shuffle.
SENT = 1_500_000


def replace_frames(lectures: DataFrame, tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS, own: bool = False) -> None:
    """Replaces all rows of the lectures (video_id) in each of the tables by those given, of which some lectures may have none; other lectures stay.
    Rows of other lectures are left out, unless own says that there are none.

    Tables are kept in folders by a hash of the lecture, of which only those with a lecture to replace are written again, by a dynamic
    overwrite: it is staged beside them and takes their place when it is complete, so doing it again, or after a failure, ends in the same rows.
    Each task writes its rows where they belong, so a folder has a file for each task at most and rows aren't shuffled to be written.
    """
    spark = lectures.sparkSession
    bucket = F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int")
    lectures = folders.checkpointed(spark)(lectures.select("video_id").distinct())
    counts = {r[0]: r[1] for r in lectures.groupBy(bucket.alias("bucket")).count().collect()}  # buckets at most
    if sum(counts.values()) <= SENT:
        lectures = F.broadcast(lectures)
    for name, table in tables.items():
        rows, place = table if own else table.join(lectures, "video_id", "left_semi"), f"{path}/{name}"
        rows, before = rows.withColumn("bucket", bucket), {}
        if folders.exists(spark, place):
            before = {b: folders.names(spark, f"{place}/bucket={b}") for b in counts}
            stay = spark.read.schema(rows.schema).parquet(place).where(F.col("bucket").isin(*counts)).join(lectures, "video_id", "left_anti")
            rows = stay.unionByName(rows)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(place)
        for b, names in before.items():  # an overwrite leaves a folder alone for which it has no row
            if names and folders.names(spark, f"{place}/bucket={b}") == names:
                folders.remove(spark, f"{place}/bucket={b}")


def read_frames(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("bucket")


def save_stage(table: DataFrame, path: str, stage: str) -> DataFrame:
    """A stage's table, written and read again, so that a later run can start there."""
    table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{stage}")
    return table.sparkSession.read.parquet(f"{path}/{stage}")


def read_table(spark: SparkSession, table: str, key: str, partitions: int, **options: str) -> DataFrame:
    """A table of a relational database, read in partitions by ranges of a numeric key between its least and its greatest value, which the database is
    asked for. Filters and columns of a query go to the database. options: those of Spark's reader, url and driver at least."""
    source = lambda **more: spark.read.format("jdbc").options(**options, **more).load()
    low, high = source(query=f"SELECT MIN({key}) AS LO, MAX({key}) AS HI FROM {table}").first()
    if low is None:
        return source(dbtable=table)
    return source(dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(partitions))


def write_table(df: DataFrame, table: str, mode: str = "append", **options: str) -> None:
    """Rows into a table of a relational database."""
    df.write.format("jdbc").options(**options).option("dbtable", table).mode(mode).save()


def stream_log(requests: DataFrame, path: str, log: str):
    """Appends a stream of requests to a request log; started again with the same log folder after whatever end, each request is there once. Read it with read_log."""
    return log_records(requests).writeStream.format("json").option("path", path).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
