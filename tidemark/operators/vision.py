"""Key frames: duplicates, blur, match to speech, importance, selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.functions import text as X


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two hashes of 16 hex digits."""
    half = lambda x, i: F.conv(F.substring(x, i, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def unique_frames(frames: DataFrame, threshold: int = 5, memory: int = 50) -> DataFrame:
    """is_duplicate: fewer than threshold bits from one of the last memory hashes that were kept. A null hash is a duplicate."""

    def duplicates(hashes: list) -> list[bool]:
        kept: list[int] = []
        out = []
        for h in hashes:
            x = None if h is None else int(h, 16)
            duplicate = x is None or any((x ^ k).bit_count() < threshold for k in kept[-memory:])
            if not duplicate:
                kept.append(x)
            out.append(duplicate)
        return out

    @F.pandas_udf("array<boolean>")
    def marked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in parts:
            yield pd.Series([duplicates(x) for x in hashes], dtype=object)

    # many lectures in a batch: a call for each one costs more than its frames
    lectures = frames.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("idx", "phash"))).alias("f")).withColumn("d", marked("f.phash"))
    return lectures.select("video_id", F.explode(F.arrays_zip("f", "d")).alias("x")).select("video_id", "x.f.idx", F.col("x.d").alias("is_duplicate"))


def blur_split(frames: DataFrame, floor: float = 30.0) -> DataFrame:
    """Each frame with its lecture's threshold (half the median score, floor at least) and whether it is sharp. If none is, all are kept."""
    limit = frames.groupBy("video_id").agg(F.greatest(F.lit(floor), F.coalesce(F.median("blur_score") * 0.5, F.lit(floor))).alias("threshold"))
    rows = frames.join(limit, "video_id").withColumn("sharp", F.coalesce(F.col("blur_score") >= F.col("threshold"), F.lit(False)))
    any_sharp = F.max(F.col("sharp").cast("int")).over(Window.partitionBy("video_id")) == 1
    return rows.withColumn("kept", F.col("sharp") | ~any_sharp)


def as_of(frames: DataFrame, segments: DataFrame, window: int = 1) -> DataFrame:
    """Segments around each frame: the last that starts at or before it (the first one when there is none) and window more on each side.

    Frames and segments are merged by time in one sort, so no interval join is needed.
    """
    s = segments.withColumn("no", F.row_number().over(Window.partitionBy("video_id").orderBy("start_s", "idx")))
    events = s.select("video_id", F.col("start_s").alias("t"), F.lit(0).alias("kind"), "no", F.lit(None).cast("long").alias("frame"))
    events = events.unionByName(frames.select("video_id", (F.col("timestamp_ms") / 1000).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("no"), F.col("idx").alias("frame")))
    order = Window.partitionBy("video_id").orderBy("t", "kind", "no").rowsBetween(Window.unboundedPreceding, 0)
    at = events.withColumn("at", F.greatest(F.coalesce(F.last("no", ignorenulls=True).over(order), F.lit(1)), F.lit(1))).where("kind = 1")
    around = at.select("video_id", "frame", F.explode(F.sequence(F.col("at") - window, F.col("at") + window)).alias("no"))
    return around.join(s.select("video_id", "no", F.col("idx").alias("segment"), F.col("text").alias("segment_text")), ["video_id", "no"]).select("video_id", "frame", "segment", "segment_text")


def _indel(a: str, b: str) -> float:
    """Share of characters in a longest common subsequence, twice over the total, in per cent."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = row & place.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Similarity of two normalised texts by their sets of words, 0 to 1."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 1.0
    with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    best = max(_indel(with_x, with_y), _indel(both, with_x) if both else 0.0, _indel(both, with_y) if both else 0.0)
    return round(best / 100, 4)


def _common(a: str, b: str) -> int:
    """Length of a longest common subsequence."""
    return round(_indel(a, b) * (len(a) + len(b)) / 200) if a and b else 0


@F.pandas_udf(LongType())
def common(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of a longest common subsequence of each pair; null pairs aren't aligned."""
    for a, b in pairs:
        yield pd.Series([None if x is None else _common(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def word_sets(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """pairs with the words that the normalised texts a and b share and those that only one has, sorted and joined, and whether one has none."""
    words = lambda t: F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(t, F.lit("")), " "), lambda w: w != "")))
    sets = pairs.withColumns({"x": words(a), "y": words(b)})
    joined = lambda c: F.array_join(c, " ")
    return sets.withColumns({"both": joined(F.array_intersect("x", "y")), "only_x": joined(F.array_except("x", "y")), "only_y": joined(F.array_except("y", "x")), "empty": (F.size("x") == 0) | (F.size("y") == 0)}).drop("x", "y")


def ratio(k: Column) -> Column:
    """token_set_ratio of word_sets when a longest common subsequence of the words that aren't shared has length k.

    The shared words begin either text, so what is common to both is they and k; against the shared words alone, either ratio follows from lengths.
    """
    n, x, y = F.length("both"), F.length("only_x"), F.length("only_y")
    shared = n + F.when(n > 0, 1).otherwise(0)
    share = lambda common, total: F.when(total > 0, F.lit(200.0) * common / total).otherwise(0.0) / 100
    alone = F.when(n > 0, F.greatest(share(n, n + shared + x), share(n, n + shared + y))).otherwise(0.0)
    best = F.greatest(alone, share(shared + k, shared + x + shared + y))
    return F.bround(F.when(F.col("empty"), 0.0).when((n > 0) & ((x == 0) | (y == 0)), 1.0).otherwise(best), 4)


def match(frames: DataFrame, segments: DataFrame, window: int = 1) -> DataFrame:
    """Best segment of each frame by text; the earliest of equals, none at score 0.

    A ratio lies between those for no and for the longest possible alignment of the words that aren't shared. Candidates that can't reach what another of
    the frame has for certain are dropped, and of the rest only those are aligned whose ratio isn't settled by that.
    """
    near = as_of(frames, segments, window).join(frames.select("video_id", F.col("idx").alias("frame"), "clean_text"), ["video_id", "frame"])
    pairs = word_sets(near, X.match_text(F.col("clean_text")), X.match_text(F.col("segment_text"))).select("video_id", "frame", "segment", "both", "only_x", "only_y", "empty")
    bounds = pairs.withColumns({"low": ratio(F.lit(0)), "high": ratio(F.least(F.length("only_x"), F.length("only_y")))})
    able = bounds.withColumn("least", F.max("low").over(Window.partitionBy("video_id", "frame"))).where("high >= least")
    unsettled = F.col("low") < F.col("high")
    aligned = able.withColumn("k", F.coalesce(common(F.when(unsettled, F.col("only_x")), F.when(unsettled, F.col("only_y"))), F.lit(0)))
    scored = aligned.withColumn("score", ratio(F.col("k")))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("video_id", "frame").orderBy(F.desc("score"), "segment"))).where("rank = 1")
    found = F.col("score") > 0
    return best.select("video_id", F.col("frame").alias("idx"), F.when(found, F.col("segment")).alias("segment"), F.col("score").alias("transcript_similarity"), F.when(found, "token_set_ratio").otherwise("none").alias("method"))


def recognised(frames: DataFrame, lines: DataFrame, least: float = 0.5) -> DataFrame:
    """(video_id, idx, raw_text, clean_text, n_lines, average_confidence) of each frame from its recognised lines (video_id, idx, pos, text, confidence).

    Lines without text or under the least confidence go. raw_text has all others, trimmed, in order; clean_text only the first of equal lines, cleaned.
    A frame without lines has '' , 0 lines and a confidence of 0.
    """
    sure = lines.where((F.coalesce("text", F.lit("")) != "") & (F.col("confidence") >= least)).withColumn("text", F.trim("text"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])  # of one picture
    read = sure.groupBy("video_id", "idx").agg(listed.alias("read"), F.avg("confidence").alias("mean"))
    out = frames.select("video_id", "idx").join(read, ["video_id", "idx"], "left").withColumn("read", F.coalesce("read", F.array().cast("array<string>")))
    return out.select("video_id", "idx", F.array_join("read", "\n").alias("raw_text"), X.ocr_clean(F.array_join(F.array_distinct("read"), "\n")).alias("clean_text"), F.size("read").cast("long").alias("n_lines"), F.coalesce("mean", F.lit(0.0)).alias("average_confidence"))


def features(frames: DataFrame) -> DataFrame:
    """What recognised text says: counts and the signs of code, equations and bullets."""
    text = X.ocr_clean(F.col("clean_text"))
    return frames.withColumn("ocr", text).select("*", X.word_count(F.col("ocr")).alias("words"), F.length("ocr").alias("characters"), X.has_code(F.col("ocr")).alias("has_code"), X.has_equation(F.col("ocr")).alias("has_equation"), X.has_bullets(F.col("ocr")).alias("has_bullets"))


def importance(frames: DataFrame) -> DataFrame:
    """Weighted score of similarity, text density, teaching signs, sharpness and time on screen."""
    sign = lambda c, w: F.when(F.col(c), w).otherwise(0.0)
    edu = F.least(sign("has_code", 0.4) + sign("has_equation", 0.3) + sign("has_bullets", 0.3), F.lit(1.0))
    density = F.least(F.length(F.trim("clean_text")) / 800, F.lit(1.0))
    total = F.coalesce("transcript_similarity", F.lit(0.0)) * 0.35 + density * 0.25 + edu * 0.20 + F.least(F.col("blur_score") / 1000, F.lit(1.0)) * 0.10 + F.least(F.col("duration_ms") / 60000, F.lit(1.0)) * 0.10
    return frames.withColumn("importance", F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)) + 1e-9, 4))  # ties go up


def select_top(frames: DataFrame, n: int = 1) -> DataFrame:
    """is_selected: the n best of each scene; ties go by input order."""
    w = Window.partitionBy("video_id", "scene_number").orderBy(F.desc("importance"), "idx")
    return frames.withColumn("is_selected", F.row_number().over(w) <= n)


def pipeline(frames: DataFrame, segments: DataFrame, n: int = 1) -> DataFrame:
    """Unique, sharp frames with features, match, score and selection."""
    unique = frames.join(unique_frames(frames).where("not is_duplicate"), ["video_id", "idx"]).drop("is_duplicate")
    sharp = features(blur_split(unique).where("kept"))
    scored = importance(sharp.join(match(sharp, segments).drop("method"), ["video_id", "idx"], "left"))
    return select_top(scored, n)


def tables(scored: DataFrame) -> dict[str, DataFrame]:
    """The four tables of persisted frames, keyed by a digest of lecture, scene and time: writing a lecture again replaces its rows."""
    keyed = scored.withColumn("frame_id", F.sha2(F.concat_ws("|", F.col("video_id").cast("string"), F.col("scene_number").cast("string"), F.col("timestamp_ms").cast("string"), F.col("idx").cast("string")), 256))
    return {
        "video_frames": keyed.select("frame_id", "video_id", "timestamp_ms", "scene_number"),
        "frame_metadata": keyed.select("frame_id", "video_id", "blur_score", "phash", "duration_ms"),
        "ocr_results": keyed.select("frame_id", "video_id", "clean_text", "average_confidence"),
        "frame_scores": keyed.select("frame_id", "video_id", "transcript_similarity", "importance", "is_selected"),
    }


def frame_details(frames: DataFrame, metadata: DataFrame, ocr: DataFrame, scores: DataFrame) -> DataFrame:
    """Frames with what is known of them; is_selected is false without a score."""
    out = frames.join(metadata, ["video_id", "idx"], "left").join(ocr, ["video_id", "idx"], "left").join(scores, ["video_id", "idx"], "left")
    return out.select("video_id", "idx", "scene_number", "blur_score", "clean_text", "importance", F.coalesce("is_selected", F.lit(False)).alias("is_selected"))


def funnel(scenes: DataFrame, frames: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows that reach each stage."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    selected = scored.agg(F.count("*").alias("sharp"), F.count_if("is_selected").alias("selected"))
    return n(scenes, "scenes").join(F.broadcast(n(frames, "extracted")), F.lit(True)).join(F.broadcast(selected), F.lit(True))  # a row each
