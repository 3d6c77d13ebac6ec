"""Speech and frames on one time line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.chunks import gap_sections


def scene_windows(scenes: DataFrame, tail_s: float = 30.0) -> DataFrame:
    """Scenes in seconds: each ends where the next begins, the last some time after its last frame."""
    w = Window.partitionBy("video_id").orderBy("start_ms", "scene_number")
    return scenes.select("video_id", "scene_number", (F.col("start_ms") / 1000).alias("start_s"), F.coalesce(F.lead("start_ms").over(w) / 1000, F.col("end_ms") / 1000 + tail_s).alias("end_s"), "frame_count")


def scene_segments(segments: DataFrame, windows: DataFrame, half_open: bool = False) -> DataFrame:
    """Segments that overlap each scene, bounds included: one on a bound is in both scenes unless half_open."""
    w = windows.select("video_id", "scene_number", F.col("start_s").alias("scene_start"), F.col("end_s").alias("scene_end"))
    until = F.col("start_s") < F.col("scene_end") if half_open else F.col("start_s") <= F.col("scene_end")
    return segments.join(w, "video_id").where(until & (F.col("end_s") >= F.col("scene_start"))).select("video_id", "scene_number", "idx", "start_s", "end_s", "text")


def orphans(segments: DataFrame, mapped: DataFrame) -> DataFrame:
    """Segments that start where no mapped one does."""
    return segments.join(mapped.select("video_id", "start_s").distinct(), ["video_id", "start_s"], "left_anti")


def sections(segments: DataFrame, scenes: DataFrame) -> DataFrame:
    """Sections of each lecture: its scenes and one for orphans, or gap sections where it has no frames."""
    segments = segments.where(F.trim("text") != "")
    windows = scene_windows(scenes)
    mapped = scene_segments(segments, windows)
    counts = mapped.groupBy("video_id", "scene_number").agg(F.count("*").alias("n_segments"))
    by_scene = windows.join(counts, ["video_id", "scene_number"], "left").select("video_id", F.lit("scene").alias("kind"), F.col("scene_number").alias("number"), "start_s", "end_s", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.col("frame_count").alias("n_frames"))
    framed = scenes.select("video_id").distinct()
    lost = orphans(segments, mapped).join(framed, "video_id", "left_semi")
    lost = lost.groupBy("video_id").agg(F.min_by("start_s", F.struct("start_s", "idx")).alias("start_s"), F.max_by("end_s", F.struct("start_s", "idx")).alias("end_s"), F.count("*").alias("n_segments"))
    lost = lost.select("video_id", F.lit("orphan").alias("kind"), F.lit(0).cast("long").alias("number"), "start_s", "end_s", "n_segments", F.lit(0).cast("long").alias("n_frames"))
    bare = gap_sections(segments.join(framed, "video_id", "left_anti")).select("video_id", F.lit("gap").alias("kind"), F.col("section").alias("number"), "start_s", "end_s", "n_segments", F.lit(0).cast("long").alias("n_frames"))
    return by_scene.unionByName(lost).unionByName(bare).withColumn("section_index", F.row_number().over(Window.partitionBy("video_id").orderBy("start_s", "kind", "number")))


def statistics(built: DataFrame, segments: DataFrame, frames: DataFrame) -> DataFrame:
    """Counts of each lecture; segments are counted before they are mapped. Its length is the end of the last section, and its greatest end."""
    s = built.groupBy("video_id").agg(F.count("*").alias("section_count"), F.max("end_s").alias("greatest_end_s"), F.max_by("end_s", "section_index").alias("last_end_s"))
    n = segments.where(F.trim("text") != "").groupBy("video_id").agg(F.count("*").alias("total_segments"))
    f = frames.groupBy("video_id").agg(F.count("*").alias("total_frames"), F.count_if(F.trim("clean_text") != "").alias("frames_with_ocr"))
    return s.join(n, "video_id", "left").join(f, "video_id", "left").na.fill(0, ["total_segments", "total_frames", "frames_with_ocr"])


def full_text(segments: DataFrame, *by: str) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    return segments.groupBy(*by).agg(joined.alias("full_text"))


def lectures(segments: DataFrame, frames: DataFrame, built: DataFrame) -> DataFrame:
    """One nested record for each lecture: sections, and segments and frames in order."""
    listed = lambda df, name, *cols: df.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = listed(built, "sections", "section_index", "kind", "number", "start_s", "end_s")
    out = out.join(listed(segments, "segments", "idx", "start_s", "end_s", "text"), "video_id", "left")
    return out.join(listed(frames, "frames", "idx", "scene_number", "timestamp_ms", "clean_text"), "video_id", "left")


def saved_lectures(built: DataFrame, segments: DataFrame, windows: DataFrame, frames: DataFrame) -> DataFrame:
    """Nested lectures as they are saved (sources.files.LECTURE): sections in order, with the segments and the frames of those that are scenes."""
    said = scene_segments(segments, windows).groupBy("video_id", "scene_number").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("text").alias("text"), F.col("start_s").alias("start"), F.col("end_s").alias("end")))).alias("said"))
    shown = frames.select(
        "video_id", "scene_number", "idx", F.format_string("frames/%s/scene_%04d_%s.jpg", F.col("video_id").cast("string"), F.col("scene_number").cast("int"), F.col("idx").cast("string")).alias("frame_path"),
        (F.col("timestamp_ms") / 1000).alias("timestamp_sec"), F.nullif("clean_text", F.lit("")).alias("ocr_text"), F.nullif("importance", F.lit(0.0)).alias("importance_score"),
    )
    shown = shown.groupBy("video_id", "scene_number").agg(F.array_sort(F.collect_list(F.struct("idx", "frame_path", "timestamp_sec", F.col("scene_number"), "ocr_text", "importance_score", F.lit(None).cast("double").alias("transcript_similarity")))).alias("shown"))
    # a lecture's sections, speech and frames move once, by the lecture, and meet there by the scene
    part = F.struct("section_index", "start_s", "end_s")
    rows = built.select("video_id", F.when(F.col("kind") == "scene", F.col("number")).alias("scene_number"), part.alias("part"))
    for held in (said, shown):
        rows = rows.unionByName(held.where("scene_number is not null"), allowMissingColumns=True)
    met = rows.repartition("video_id").groupBy("video_id", "scene_number").agg(F.collect_list("part").alias("parts"), F.first("said", True).alias("said"), F.first("shown", True).alias("shown")).where(F.size("parts") > 0)
    section = lambda x: F.struct(
        x["section_index"].alias("section_index"), F.format_string("section_%03d", x["section_index"].cast("int")).alias("section_id"), x["start_s"].alias("start_time"), x["end_s"].alias("end_time"), F.when(F.col("scene_number").isNotNull(), F.array("scene_number")).alias("scene_numbers"),
        F.transform("said", lambda y: y.dropFields("idx")).alias("transcript_segments"), F.transform("shown", lambda y: y.dropFields("idx")).alias("frames"),
    )
    listed = F.array_sort(F.flatten(F.collect_list(F.transform("parts", section))))
    return met.groupBy("video_id").agg(listed.alias("listed"), F.sum(F.size("parts")).cast("double").alias("n")).select(F.col("video_id").cast("string").alias("video_id"), F.transform("listed", lambda x: x.dropFields("section_index")).alias("sections"), F.create_map(F.lit("sections"), F.col("n")).alias("statistics"))


def lecture_markdown(built: DataFrame, segments: DataFrame, windows: DataFrame, frames: DataFrame) -> DataFrame:
    """A page for each lecture: a heading and speech for each scene, a preview of 100 characters for each frame."""
    speech = full_text(scene_segments(segments, windows), "video_id", "scene_number")
    shown = frames.where(F.trim("clean_text") != "").groupBy("video_id", "scene_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.substring(F.replace("clean_text", F.lit("\n"), F.lit(" ")), 1, 100).alias("preview")))), lambda x: F.concat(F.lit("- "), x["preview"])), "\n").alias("previews"))
    rows = built.where("kind = 'scene'").withColumnRenamed("number", "scene_number").join(speech, ["video_id", "scene_number"], "left").join(shown, ["video_id", "scene_number"], "left")
    part = F.concat_ws("\n\n", F.format_string("## Section %d", "section_index"), F.col("full_text"), F.col("previews"))
    return rows.withColumn("part", part).groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_index", "part"))), lambda x: x["part"]), "\n\n").alias("markdown"))
