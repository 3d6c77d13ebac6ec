"""Order-dependent chunks and scenes: folds within a lecture, sections, ranges of frames.

A fold sees only numbers (times, lengths, whether a sentence ends) and returns a group
number for each row; texts stay with Spark, which groups them by the partitioning that they already
have. A lecture is at most some hours, so its rows fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X

#: What ends a sentence.
SENTENCE_END = r"[.?!\n]\s*$"


def _fold(segments: DataFrame, closes_before, closes_after, skip_blank: bool) -> DataFrame:
    """segments with their chunk: closes_before(seconds, characters, whether a sentence ended, gap) ends a chunk before a segment, closes_after(seconds, characters) behind one. Of skipped blank segments the chunk is null."""

    def numbers(start: list, stop: list, size: list, ended: list) -> list:
        chunk, begin, end, chars, last, out = 0, None, 0.0, 0, False, []
        for a, z, n, e in zip(start, stop, size, ended, strict=True):
            if n < 0:
                out.append(None)
                continue
            if begin is not None and closes_before and closes_before(end - begin, chars, last, a - end):
                chunk, begin = chunk + 1, None
            if begin is None:
                begin, chars = a, 0
            chars, last, end = chars + n, e, z
            out.append(chunk)
            if closes_after and closes_after(end - begin, chars):
                chunk, begin = chunk + 1, None
        return out

    @F.pandas_udf("array<long>")
    def number(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series([numbers(*(x.tolist() for x in row)) for row in zip(*columns, strict=True)], dtype=object)

    text = F.coalesce("text", F.lit(""))
    size = F.when(F.lit(skip_blank) & (F.trim(text) == ""), -1).otherwise(F.length(F.trim(text) if skip_blank else text))
    one = F.struct("idx", "start_s", "end_s", (F.trim(text) if skip_blank else text).alias("text"), F.coalesce("end_s", "start_s").alias("stop"), size.alias("size"), text.rlike(SENTENCE_END).alias("ended"))
    lectures = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    lectures = lectures.withColumn("chunk", number("s.start_s", "s.stop", "s.size", "s.ended"))
    return lectures.select("video_id", F.explode(F.arrays_zip("s", "chunk")).alias("x")).select("video_id", "x.s.idx", "x.s.start_s", "x.s.end_s", "x.s.text", "x.chunk")


def fixed(segments: DataFrame, seconds: float = 180.0, characters: int = 2000) -> DataFrame:
    return _fold(segments, lambda s, n, _ended, _gap: s >= seconds or n > characters, None, False)


def semantic(segments: DataFrame) -> DataFrame:
    """Soft end after 90 s at a sentence end or pause of 2 s, hard end after 240 s or 3000 characters."""
    return _fold(segments, lambda s, n, ended, gap: (s >= 90 and (ended or gap >= 2)) or s >= 240 or n > 3000, None, False)


def after(segments: DataFrame, seconds: float = 180.0, characters: int = 2000, skip_blank: bool = True) -> DataFrame:
    """A chunk ends with the segment that fills it, by time or by characters; blank segments may be skipped, and texts trimmed."""
    return _fold(segments, None, lambda s, n: s >= seconds or n > characters, skip_blank)


def gather(numbered: DataFrame, places: int | None = 2, name: str = "range") -> DataFrame:
    """Chunks with bounds (rounded half to even) and text; ids count from 0 in a lecture."""
    rows = numbered.where("chunk is not null")
    end = F.coalesce("end_s", "start_s")
    near = (lambda c: F.bround(c, places)) if places is not None else (lambda c: c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    out = rows.groupBy("video_id", "chunk").agg(near(F.min_by("start_s", "idx")).alias("start_s"), near(F.max_by(end, "idx")).alias("end_s"), text.alias("text"))
    return out.select(F.concat_ws("", F.col("video_id").cast("string"), F.lit(f"_{name}_"), F.col("chunk").cast("string")).alias("chunk_id"), "video_id", "chunk", "start_s", "end_s", "text")


def or_transcript(chunks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Chunks, and for each lecture (video_id, transcript) without any, one of its whole transcript at no time."""
    bare = transcripts.join(chunks.select("video_id").distinct(), "video_id", "left_anti")
    one = bare.select(F.concat(F.col("video_id").cast("string"), F.lit("_0")).alias("chunk_id"), "video_id", F.lit(0).cast("long").alias("chunk"), F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s"), F.coalesce("transcript", F.lit("")).alias("text"))
    return chunks.select(*one.columns).unionByName(one)


def merge_scenes(scenes: DataFrame, least_ms: int = 2000) -> DataFrame:
    """Scenes numbered anew after a scene shorter than least_ms has taken in the ones that follow; the last may stay short."""

    def numbers(start: list, stop: list) -> list[int]:
        number, begin, end, out = 0, None, 0, []
        for a, b in zip(start, stop, strict=True):
            if begin is None or end - begin >= least_ms:
                number, begin = number + 1, a
            end = b
            out.append(number)
        return out

    @F.pandas_udf("array<long>")
    def merged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for start, stop in parts:
            yield pd.Series([numbers(a.tolist(), b.tolist()) for a, b in zip(start, stop, strict=True)], dtype=object)

    one = F.struct("scene_number", "start_ms", "end_ms", "frame_count")
    lectures = scenes.groupBy("video_id").agg(F.array_sort(F.collect_list(one)).alias("s")).withColumn("merged", merged("s.start_ms", "s.end_ms"))
    rows = lectures.select("video_id", F.explode(F.arrays_zip("s", "merged")).alias("x")).select("video_id", "x.s.*", "x.merged")
    return rows.groupBy("video_id", "merged").agg(F.min_by("start_ms", "scene_number").alias("start_ms"), F.max_by("end_ms", "scene_number").alias("end_ms"), F.sum("frame_count").alias("frame_count")).withColumnRenamed("merged", "scene_number")


def fallback_scenes(media: DataFrame) -> DataFrame:
    """Scenes of 30, 60 (over 10 min) or 120 s (over an hour) where none were found; the last is short."""
    total = F.floor("media_s").cast("long")
    step = F.when(total > 3600, 120).when(total > 600, 60).otherwise(30)
    m = media.where("media_s >= 1").withColumn("total", total).withColumn("step", step)
    m = m.select("video_id", "total", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.col("step").cast("long"))).alias("start_s"))
    return m.select("video_id", (F.col("start_s") / F.col("step") + 1).cast("long").alias("scene_number"), "start_s", F.least(F.col("start_s") + F.col("step"), "total").alias("end_s"))


def gap_sections(segments: DataFrame, gap_s: float = 10.0) -> DataFrame:
    """Sections of speech: a new one begins when a segment starts more than gap_s after the one before ends."""
    order = Window.partitionBy("video_id").orderBy("start_s", "idx")
    new = F.coalesce((F.col("start_s") - F.lag("end_s").over(order) > gap_s).cast("int"), F.lit(0))
    rows = segments.withColumn("new", new).withColumn("section", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("video_id", "section").agg(F.min("start_s").alias("start_s"), F.max_by("end_s", F.struct("start_s", "idx")).alias("end_s"), F.count("*").alias("n_segments"))


def frames_in(chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames with text inside each chunk; a frame on a bound is in both chunks."""
    t = F.col("timestamp_ms") / 1000
    return chunks.join(frames.where(F.trim("clean_text") != ""), "video_id").where(t.between(F.col("start_s"), F.col("end_s"))).select("chunk_id", "video_id", "chunk", "idx", "timestamp_ms", "scene_number", "clean_text")


def first_chunk(chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """The first chunk that holds each frame, else chunk 0."""
    t = F.col("timestamp_ms") / 1000
    inside = frames.join(chunks.select("video_id", "chunk", "start_s", "end_s"), "video_id").where(t.between(F.col("start_s"), F.col("end_s")))
    first = inside.groupBy("video_id", "idx").agg(F.min("chunk").alias("found"))
    return frames.join(first, ["video_id", "idx"], "left").select("video_id", "idx", F.coalesce("found", F.lit(0)).alias("chunk"))


def markdown(chunks: DataFrame, inside: DataFrame) -> DataFrame:
    """A unified document for each lecture: title, chunk headings, speech, recognised text of the frames inside."""
    seen = F.concat(F.lit("**["), X.short_clock(F.col("timestamp_ms") / 1000), F.lit(" | Scene "), F.coalesce(F.col("scene_number").cast("string"), F.lit("?")), F.lit("]**\n\n> "), F.trim("clean_text"), F.lit("\n\n"))
    quotes = inside.withColumn("seen", seen).groupBy("video_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp_ms", "idx", "seen"))), lambda x: x["seen"]), "").alias("quotes"))
    heading = F.concat(F.lit("## Chunk `"), F.col("chunk_id"), F.lit("` — "), X.short_clock(F.col("start_s")), F.lit(" to "), X.short_clock(F.col("end_s")), F.lit("\n\n### Transcript\n\n"))
    visual = F.coalesce(F.concat(F.lit("### Visual Content (OCR from Slides/Frames)\n\n"), F.col("quotes")), F.lit(""))
    parts = chunks.join(quotes, ["video_id", "chunk"], "left").withColumn("part", F.concat(heading, F.col("text"), F.lit("\n\n"), visual, F.lit("---\n")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "\n")
    return parts.groupBy("video_id").agg(F.concat(F.format_string("# Lecture %d\n\n> **Video ID:** `%d`\n\n", "video_id", "video_id"), body).alias("markdown"))


def overlapping(text: Column, size: int, overlap: int) -> Column:
    """Pieces of size characters, each overlap characters into the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - overlap) / step).cast("int") - 1))
    return F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size)))


def token_windows(segments: DataFrame, size: int = 200, overlap: int = 40) -> DataFrame:
    """(video_id, piece, first_token, n_tokens, start_char, end_char, start_s, end_s, text): windows of size words of a lecture, each overlap words into the one before.

    Words run on from segment to segment. Characters are places in the lecture's text, its segments joined by a space; times are those of the segments that
    the first and the last word come from. A segment meets only the windows that it has words in, so no word is a row of its own. A lecture without words has none.
    """
    step = size - overlap
    parts = segments.select("video_id", "idx", "start_s", F.coalesce("end_s", "start_s").alias("end_s"), F.coalesce("text", F.lit("")).alias("text"))
    # each word with the white space before it
    parts = parts.withColumn("words", F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)).withColumn("n", F.size("words").cast("long"))
    before = Window.partitionBy("video_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"token": F.coalesce(F.sum("n").over(before), F.lit(0)), "char": F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("video_id"))}).where("n > 0")
    low, high = F.greatest(F.lit(0), F.floor((F.col("token") - size) / step) + 1), F.floor((F.col("token") + F.col("n") - 1) / step)
    last = F.greatest(F.lit(0), F.ceil((F.col("total") - overlap) / step) - 1)  # later ones would only repeat what overlaps
    met = parts.withColumn("piece", F.explode(F.filter(F.sequence(low, high), lambda w: w <= last)))
    begin = F.greatest(F.lit(0), F.col("piece") * step - F.col("token")).cast("int")
    end = F.least(F.col("n"), F.col("piece") * step + size - F.col("token")).cast("int")
    bare = lambda w: F.regexp_replace(w, r"^[\x20\x09-\x0D]+", "")
    upto = lambda k: F.length(F.array_join(F.slice("words", F.lit(1), k), ""))
    met = met.where(begin < end).withColumns({"begin": begin, "end": end}).withColumn("own", F.slice("words", F.col("begin") + 1, F.col("end") - F.col("begin")))
    one = met.select(
        "video_id", "piece", "idx", "start_s", "end_s", (F.col("token") + F.col("begin")).alias("first"), F.size("own").cast("long").alias("k"), F.array_join(F.transform("own", bare), " ").alias("text"),
        (F.col("char") + upto(F.col("begin") + 1) - F.length(bare(F.get("own", F.lit(0))))).alias("a"), (F.col("char") + upto(F.col("end"))).alias("z"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")  # size words at most
    return one.groupBy("video_id", "piece").agg(F.min("first").alias("first_token"), F.sum("k").alias("n_tokens"), F.min("a").alias("start_char"), F.max("z").alias("end_char"), F.min_by("start_s", "idx").alias("start_s"), F.max_by("end_s", "idx").alias("end_s"), joined.alias("text"))
