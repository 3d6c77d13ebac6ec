"""Registered queries over chunks, frames and merged lectures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import chunks as C
from tidemark.operators import merge as M
from tidemark.operators import vision as V
from tidemark.plans.registry import query
from tidemark.sources import projections as P


def _chunk_sql(close: str, state: str = "cs", after: str | None = None) -> str:
    """A recursive fold over the segments of each lecture, in order; close ends a chunk before a segment, after ends one behind it."""
    if after:
        grow = f"CASE WHEN {after} THEN s.start_s ELSE f.cs END AS cs, s.end_s AS ce, CASE WHEN {after} THEN 0 ELSE f.n END + length(s.text) AS n, s.text AS last, f.chunk + CASE WHEN {after} THEN 1 ELSE 0 END AS chunk"
    else:
        grow = f"CASE WHEN {close} THEN s.start_s ELSE f.cs END AS cs, s.end_s AS ce, CASE WHEN {close} THEN 0 ELSE f.n END + length(s.text) AS n, s.text AS last, f.chunk + CASE WHEN {close} THEN 1 ELSE 0 END AS chunk"
    return f"""fold AS (SELECT video_id, idx, start_s AS cs, end_s AS ce, length(text) AS n, text AS last, 0 AS chunk FROM segments WHERE idx = 1
UNION ALL SELECT s.video_id, s.idx, {grow} FROM fold f JOIN segments s ON s.video_id = f.video_id AND s.idx = f.idx + 1),
gathered AS (SELECT video_id, chunk, round_even(arg_min(start_s, idx), 2) AS start_s, round_even(arg_max(end_s, idx), 2) AS end_s, string_agg(text, ' ' ORDER BY idx) AS text FROM fold JOIN segments USING (video_id, idx) GROUP BY 1, 2)"""


FIXED = _chunk_sql("(f.ce - f.cs >= 180 OR f.n > 2000)")
SEMANTIC = _chunk_sql("((f.ce - f.cs >= 90 AND (suffix(trim(f.last), '.') OR suffix(trim(f.last), '?') OR suffix(trim(f.last), '!') OR s.start_s - f.ce >= 2)) OR f.ce - f.cs >= 240 OR f.n > 3000)")
AFTER = _chunk_sql("", after="(f.ce - f.cs >= 180 OR f.n > 2000)")
ROWS = "SELECT video_id || '_range_' || chunk AS chunk_id, video_id, chunk, start_s, end_s, text FROM gathered"


@query(P.sql("segments", ROWS, FIXED))
def chunks_fixed(spark: SparkSession, d: str) -> DataFrame:
    """G1."""
    s = P.segments(spark, d)
    return C.gather(C.fixed(s))


@query(P.sql("segments", ROWS, SEMANTIC))
def chunks_semantic(spark: SparkSession, d: str) -> DataFrame:
    """G2."""
    s = P.segments(spark, d)
    return C.gather(C.semantic(s))


@query(P.sql("segments", ROWS, AFTER))
def chunks_after(spark: SparkSession, d: str) -> DataFrame:
    """G4."""
    s = P.segments(spark, d)
    return C.gather(C.after(s, skip_blank=False))


@query(P.sql("segments", "SELECT * FROM timed UNION ALL SELECT doc_id || '_0', doc_id, 0, 0.0, 0.0, coalesce(text, '') FROM documents WHERE doc_id NOT IN (SELECT video_id FROM timed)", "long AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS idx, start_s, end_s, text FROM segments WHERE length(text) >= 40)", AFTER.replace("FROM segments", "FROM long").replace("JOIN segments", "JOIN long"), "timed AS (" + ROWS + ")"))
def chunks_or_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the lines that have 40 characters at least; a lecture without one is a single chunk of its whole transcript."""
    s = P.segments(spark, d).where(F.length("text") >= 40)
    return C.or_transcript(C.gather(C.after(s, skip_blank=False)), P.read(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.col("text").alias("transcript")))


SCENE_FOLD = """numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY scene_number) AS k FROM scenes),
merging AS (SELECT video_id, k, start_ms AS a, end_ms AS b, 1 AS n FROM numbered WHERE k = 1 UNION ALL SELECT s.video_id, s.k, CASE WHEN m.b - m.a >= 2000 THEN s.start_ms ELSE m.a END, s.end_ms, m.n + CASE WHEN m.b - m.a >= 2000 THEN 1 ELSE 0 END FROM merging m JOIN numbered s ON s.video_id = m.video_id AND s.k = m.k + 1)"""


@query(P.sql("scenes", "SELECT video_id, n AS scene_number, arg_min(start_ms, k) AS start_ms, arg_max(end_ms, k) AS end_ms, sum(frame_count)::BIGINT AS frame_count FROM merging JOIN numbered USING (video_id, k) GROUP BY 1, 2", SCENE_FOLD))
def scene_merge(spark: SparkSession, d: str) -> DataFrame:
    """G5."""
    return C.merge_scenes(P.scenes(spark, d))


@query(P.sql("media", "SELECT video_id, s // step + 1 AS scene_number, s AS start_s, least(s + step, total) AS end_s FROM (SELECT *, unnest(range(0, total, step)) AS s FROM (SELECT video_id, floor(media_s)::BIGINT AS total, CASE WHEN media_s >= 3601 THEN 120 WHEN floor(media_s) > 600 THEN 60 ELSE 30 END AS step FROM media WHERE media_s >= 1))"))
def fallback_scenes(spark: SparkSession, d: str) -> DataFrame:
    """G9."""
    return C.fallback_scenes(P.media(spark, d))


GAPS = """flagged AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY video_id ORDER BY start_s, idx) > 10 THEN 1 ELSE 0 END AS new FROM segments),
sectioned AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY start_s, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS section FROM flagged)"""


@query(P.sql("segments", "SELECT video_id, section, min(start_s) AS start_s, arg_max(end_s, (start_s, idx)) AS end_s, count(*) AS n_segments FROM sectioned GROUP BY 1, 2", GAPS))
def gap_sections(spark: SparkSession, d: str) -> DataFrame:
    """W7."""
    return C.gap_sections(P.segments(spark, d))


INSIDE = "inside AS (SELECT g.video_id, g.chunk, f.idx, f.timestamp_ms, f.scene_number, f.clean_text FROM gathered g JOIN frames f ON f.video_id = g.video_id AND f.timestamp_ms / 1000 BETWEEN g.start_s AND g.end_s WHERE trim(f.clean_text) <> '')"


@query(P.sql("segments frames", "SELECT video_id || '_range_' || chunk AS chunk_id, * FROM inside", FIXED, INSIDE))
def chunk_frames(spark: SparkSession, d: str) -> DataFrame:
    """J7."""
    s = P.segments(spark, d)
    return C.frames_in(C.gather(C.fixed(s)), P.frames(spark, d))


@query()
def chunk_frames_all(spark: SparkSession, d: str) -> DataFrame:
    """J7 with the whole text of frames."""
    s = P.segments(spark, d)
    return C.frames_in(C.gather(C.fixed(s)), P.frames(spark, d))


@query(P.sql("segments frames", "SELECT f.video_id, f.idx, coalesce(min(g.chunk), 0)::BIGINT AS chunk FROM frames f LEFT JOIN gathered g ON f.video_id = g.video_id AND f.timestamp_ms / 1000 BETWEEN g.start_s AND g.end_s GROUP BY 1, 2", FIXED))
def formula_chunk(spark: SparkSession, d: str) -> DataFrame:
    """J8."""
    s = P.segments(spark, d)
    return C.first_chunk(C.gather(C.fixed(s)), P.frames(spark, d))


SHORT = "printf('%02d:%02d:%02d', floor({x})::BIGINT // 3600, floor({x})::BIGINT // 60 % 60, floor({x})::BIGINT % 60)"
SPOKEN = """spoken AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS idx, start_s, end_s, trim(text) AS text FROM segments WHERE trim(text) <> '')"""
PARTED = AFTER.replace("FROM segments", "FROM spoken").replace("JOIN segments", "JOIN spoken").replace("round_even(arg_min(start_s, idx), 2)", "arg_min(start_s, idx)").replace("round_even(arg_max(end_s, idx), 2)", "arg_max(end_s, idx)")
MARKDOWN = f"""quoted AS (SELECT video_id, chunk, string_agg('**[' || {SHORT.format(x="timestamp_ms / 1000")} || ' | Scene ' || scene_number || ']**' || chr(10) || chr(10) || '> ' || trim(clean_text) || chr(10) || chr(10), '' ORDER BY timestamp_ms, idx) AS quotes FROM inside GROUP BY 1, 2),
parts AS (SELECT g.video_id, g.chunk, '## Chunk `' || g.video_id || '_chunk_' || g.chunk || '` — ' || {SHORT.format(x="start_s")} || ' to ' || {SHORT.format(x="end_s")} || chr(10) || chr(10) || '### Transcript' || chr(10) || chr(10) || text || chr(10) || chr(10) || coalesce('### Visual Content (OCR from Slides/Frames)' || chr(10) || chr(10) || quotes, '') || '---' || chr(10) AS part FROM gathered g LEFT JOIN quoted USING (video_id, chunk))"""


@query(P.sql("segments frames", "SELECT video_id, '# Lecture ' || video_id || chr(10) || chr(10) || '> **Video ID:** `' || video_id || '`' || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY chunk) AS markdown FROM parts GROUP BY 1", SPOKEN, PARTED, INSIDE, MARKDOWN))
def unified_markdown(spark: SparkSession, d: str) -> DataFrame:
    """F28, G3."""
    s = P.segments(spark, d)
    chunks = C.gather(C.after(s), None, "chunk")
    return C.markdown(chunks, C.frames_in(chunks, P.frames(spark, d)))


@query()
def unified_markdown_all(spark: SparkSession, d: str) -> DataFrame:
    """F28 with the whole text of frames."""
    s = P.segments(spark, d)
    chunks = C.gather(C.after(s), None, "chunk")
    return C.markdown(chunks, C.frames_in(chunks, P.frames(spark, d)))


# Frames


@query()
def frame_dedup(spark: SparkSession, d: str) -> DataFrame:
    """G6, F22; tested against a loop."""
    return V.unique_frames(P.frames(spark, d))


@query(P.sql("frames", "SELECT count(*) AS pairs, sum(bit_count(xor(('0x' || substr(a, 1, 8))::BIGINT, ('0x' || substr(b, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a, 9, 8))::BIGINT, ('0x' || substr(b, 9, 8))::BIGINT)))::BIGINT AS bits FROM (SELECT phash AS a, lag(phash) OVER (PARTITION BY video_id ORDER BY idx) AS b FROM frames) WHERE b IS NOT NULL"))
def hamming_steps(spark: SparkSession, d: str) -> DataFrame:
    """F22 between frames that follow each other."""
    from pyspark.sql import Window

    f = P.frames(spark, d).select("phash", F.lag("phash").over(Window.partitionBy("video_id").orderBy("idx")).alias("b")).where("b is not null")
    return f.agg(F.count("*").alias("pairs"), F.sum(V.hamming(F.col("phash"), F.col("b"))).alias("bits"))


BLUR = """limits AS (SELECT video_id, greatest(30.0::DOUBLE, coalesce(median(blur_score) * 0.5, 30)) AS threshold FROM frames GROUP BY 1), blurred AS (SELECT f.*, threshold, blur_score >= threshold AS sharp FROM frames f JOIN limits USING (video_id))"""


@query(P.sql("frames", "SELECT video_id, idx, threshold, sharp, sharp OR NOT bool_or(sharp) OVER (PARTITION BY video_id) AS kept FROM blurred", BLUR))
def adaptive_blur(spark: SparkSession, d: str) -> DataFrame:
    """A11, P8, P9."""
    return V.blur_split(P.frames(spark, d)).select("video_id", "idx", "threshold", "sharp", "kept")


ASOF = """numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_s, idx) AS no FROM segments),
located AS (SELECT f.video_id, f.idx AS frame, greatest(coalesce(max(s.no), 1), 1) AS k FROM frames f LEFT JOIN numbered s ON s.video_id = f.video_id AND s.start_s <= f.timestamp_ms / 1000 GROUP BY 1, 2)"""


@query(P.sql("segments frames", "SELECT l.video_id, l.frame, n.idx AS segment, n.text AS segment_text FROM located l JOIN numbered n ON n.video_id = l.video_id AND n.no BETWEEN l.k - 1 AND l.k + 1", ASOF))
def asof_context(spark: SparkSession, d: str) -> DataFrame:
    """J9."""
    return V.as_of(P.frames(spark, d), P.segments(spark, d))


@query()
def frame_match(spark: SparkSession, d: str) -> DataFrame:
    """Q6, F4, F5, U5; tested against hand-computed ratios."""
    return V.match(P.frames(spark, d), P.segments(spark, d))


CLEAN = "array_to_string(list_transform(list_filter(list_transform(string_split(clean_text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 1 OR regexp_matches(x, '^\\d$')), lambda x: regexp_replace(x, '\\s{2,}', ' ', 'g')), chr(10))"
FEATURES = f"""cleaned AS (SELECT *, {CLEAN} AS ocr FROM frames),
featured AS (SELECT *, len(list_filter(regexp_split_to_array(trim(ocr), '\\s+'), lambda x: x <> '')) AS words, length(ocr) AS characters, regexp_matches(ocr, '(?m)(def |class |import |#include|<[a-z]|\\{{|\\}}|;$|\\(\\))') AS has_code, regexp_matches(ocr, '[=+\\-*/\\\\∑∫∂√≈≤≥±]') AS has_equation, regexp_matches(ocr, '(?m)^\\s*[•\\-*\\d.]+\\s') AS has_bullets FROM cleaned)"""


LINES = """rows AS (SELECT video_id, idx, unnest(string_split(clean_text, ' ')) AS w, unnest(range(0, len(string_split(clean_text, ' ')))) AS i FROM frames),
read0 AS (SELECT video_id, idx, i // 4 AS pos, string_agg(CASE WHEN i // 4 % 5 = 4 THEN 'The end' ELSE w END, ' ' ORDER BY i) AS text, ((video_id * 31 + idx * 17 + i // 4 * 13) % 100) / 100::DOUBLE AS confidence FROM rows GROUP BY 1, 2, 3, 5),
sure AS (SELECT video_id, idx, pos, trim(text) AS text, confidence FROM read0 WHERE text <> '' AND confidence >= 0.5),
once AS (SELECT video_id, idx, text, min(pos) AS pos FROM sure GROUP BY 1, 2, 3),
joined AS (SELECT video_id, idx, string_agg(text, chr(10) ORDER BY pos) AS clean_text FROM once GROUP BY 1, 2)"""


@query(P.sql("frames", f"SELECT f.video_id, f.idx, coalesce(raw_text, '') AS raw_text, coalesce(c.clean, '') AS clean_text, coalesce(n_lines, 0) AS n_lines, coalesce(round(mean, 9), 0) AS average_confidence FROM frames f LEFT JOIN (SELECT video_id, idx, string_agg(text, chr(10) ORDER BY pos) AS raw_text, count(*) AS n_lines, avg(confidence) AS mean FROM sure GROUP BY 1, 2) r ON r.video_id = f.video_id AND r.idx = f.idx LEFT JOIN (SELECT video_id, idx, {CLEAN} AS clean FROM joined) c ON c.video_id = f.video_id AND c.idx = f.idx", LINES))
def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    """frames' lines of four words, of which each fifth one repeats, with a confidence."""
    f = P.frames(spark, d)
    words = F.split("clean_text", " ")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 4).cast("int")), lambda k: F.slice(words, k * 4 + 1, F.lit(4)))
    said = lambda x, k: F.array_join(F.when(k % 5 == 4, F.transform(x, lambda _: F.lit("The end"))).otherwise(x), " ")
    rows = f.select("video_id", "idx", F.posexplode(F.transform(cut, said)).alias("pos", "text"))
    rows = rows.withColumn("confidence", ((F.col("video_id") * 31 + F.col("idx") * 17 + F.col("pos") * 13) % 100) / 100)
    return V.recognised(f, rows).withColumn("average_confidence", F.round("average_confidence", 9))


@query(P.sql("frames", "SELECT video_id, idx, ocr, words, characters, has_code, has_equation, has_bullets FROM featured", FEATURES))
def ocr_features(spark: SparkSession, d: str) -> DataFrame:
    """F11, F12, A14."""
    return V.features(P.frames(spark, d)).select("video_id", "idx", "ocr", "words", "characters", "has_code", "has_equation", "has_bullets")


@query()
def ocr_features_all(spark: SparkSession, d: str) -> DataFrame:
    """F11, F12, A14 of the whole text."""
    return V.features(P.frames(spark, d)).select("video_id", "idx", "ocr", "words", "characters", "has_code", "has_equation", "has_bullets")


SCORED = """scored AS (SELECT *, round(least(greatest(0 * 0.35 + least(length(trim(clean_text)) / 800, 1.0) * 0.25::DOUBLE + least(CASE WHEN has_code THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN has_equation THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN has_bullets THEN 0.3::DOUBLE ELSE 0 END, 1.0) * 0.2::DOUBLE
+ least(blur_score / 1000, 1.0) * 0.1::DOUBLE + least(duration_ms / 60000, 1.0) * 0.1::DOUBLE, 0), 1) + 1e-9, 4) AS importance FROM featured),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, scene_number ORDER BY importance DESC, idx) <= 1 AS is_selected FROM scored)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return V.select_top(V.importance(V.features(P.frames(spark, d)).withColumn("transcript_similarity", F.lit(0.0))))


@query(P.sql("frames", "SELECT video_id, idx, importance FROM scored", FEATURES, SCORED))
def frame_score(spark: SparkSession, d: str) -> DataFrame:
    """F19, F21."""
    return _scored(spark, d).select("video_id", "idx", "importance")


@query()
def frame_score_all(spark: SparkSession, d: str) -> DataFrame:
    """F19, F21 by the whole text."""
    return _scored(spark, d).select("video_id", "idx", "importance")


@query(P.sql("frames", "SELECT video_id, scene_number, idx, is_selected FROM ranked", FEATURES, SCORED))
def top_frames(spark: SparkSession, d: str) -> DataFrame:
    """W8, P13."""
    return _scored(spark, d).select("video_id", "scene_number", "idx", "is_selected")


@query()
def top_frames_all(spark: SparkSession, d: str) -> DataFrame:
    """W8, P13 by the whole text; the selected frames are P12, the others U1."""
    return _scored(spark, d).select("video_id", "scene_number", "idx", "is_selected")


@query(P.sql("frames", "SELECT f.video_id, f.idx, f.scene_number, CASE WHEN f.idx % 3 <> 0 THEN f.blur_score END AS blur_score, CASE WHEN f.idx % 5 <> 0 THEN f.clean_text END AS clean_text, CASE WHEN f.idx % 7 <> 0 THEN importance END AS importance, f.idx % 7 <> 0 AND is_selected AS is_selected FROM frames f JOIN ranked USING (video_id, idx)", FEATURES, SCORED))
def frame_detail(spark: SparkSession, d: str) -> DataFrame:
    """Three left joins."""
    return _details(P.frames(spark, d), _scored(spark, d))


@query()
def frame_detail_all(spark: SparkSession, d: str) -> DataFrame:
    """J3, O5 with the whole text."""
    return _details(P.frames(spark, d), _scored(spark, d))


def _details(f: DataFrame, s: DataFrame) -> DataFrame:
    return V.frame_details(f.select("video_id", "idx", "scene_number"), f.where("idx % 3 <> 0").select("video_id", "idx", "blur_score"), f.where("idx % 5 <> 0").select("video_id", "idx", "clean_text"), s.where("idx % 7 <> 0").select("video_id", "idx", "importance", "is_selected"))


@query(P.sql("frames", "SELECT video_id, idx, scene_number FROM frames SEMI JOIN (SELECT video_id, idx FROM ranked WHERE is_selected) USING (video_id, idx)", FEATURES, SCORED))
def selected_frames(spark: SparkSession, d: str) -> DataFrame:
    """P12."""
    return P.frames(spark, d).join(_scored(spark, d).where("is_selected").select("video_id", "idx"), ["video_id", "idx"], "left_semi").select("video_id", "idx", "scene_number")


@query(P.sql("frames", "SELECT video_id, idx FROM frames EXCEPT SELECT video_id, idx FROM ranked WHERE is_selected", FEATURES, SCORED))
def unselected_frames(spark: SparkSession, d: str) -> DataFrame:
    """U1."""
    return P.frames(spark, d).select("video_id", "idx").subtract(_scored(spark, d).where("is_selected").select("video_id", "idx"))


@query(P.sql("scenes", "SELECT (SELECT count(*) FROM scenes) AS scenes, (SELECT count(*) FROM frames) AS extracted, count(*) AS sharp, count(*) FILTER (is_selected) AS selected FROM ranked", FEATURES, SCORED))
def stage_funnel(spark: SparkSession, d: str) -> DataFrame:
    """A20."""
    return V.funnel(P.scenes(spark, d), P.frames(spark, d), _scored(spark, d))


@query()
def vision_run(spark: SparkSession, d: str) -> DataFrame:
    """Q7: unique, sharp, matched, scored and selected frames."""
    return V.pipeline(P.frames(spark, d), P.segments(spark, d)).select("video_id", "idx", "scene_number", "transcript_similarity", "importance", "is_selected")


@query()
def frame_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the four tables with their shared key."""
    t = V.tables(_scored(spark, d))
    return t["video_frames"].join(t["frame_scores"], ["frame_id", "video_id"]).select("frame_id", "video_id", "scene_number", "is_selected")


@query(P.sql("frames", "SELECT video_id, scene_number, count(*) AS kept, round(avg(average_confidence), 6) AS confidence FROM frames WHERE average_confidence >= 0.7 AND trim(clean_text) <> '' GROUP BY 1, 2"))
def confident_lines(spark: SparkSession, d: str) -> DataFrame:
    """P10, A14."""
    f = P.frames(spark, d).where((F.col("average_confidence") >= 0.7) & (F.trim("clean_text") != ""))
    return f.groupBy("video_id", "scene_number").agg(F.count("*").alias("kept"), F.round(F.avg("average_confidence"), 6).alias("confidence"))


# Merged lectures


@query(P.sql("scenes", "SELECT * FROM scenes"))
def scene_bounds(spark: SparkSession, d: str) -> DataFrame:
    """A12."""
    return P.scenes(spark, d)


WINDOWS = "windows AS (SELECT video_id, scene_number, start_ms / 1000 AS start_s, coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY start_ms, scene_number) / 1000, end_ms / 1000 + 30) AS end_s, frame_count FROM scenes)"
MAPPED = "mapped AS (SELECT s.video_id, w.scene_number, s.idx, s.start_s, s.end_s, s.text FROM segments s JOIN windows w ON w.video_id = s.video_id AND s.start_s <= w.end_s AND s.end_s >= w.start_s)"
ORPHANS = "lost AS (SELECT * FROM segments s ANTI JOIN mapped m ON m.video_id = s.video_id AND m.start_s = s.start_s)"


@query(P.sql("scenes", "SELECT * FROM windows", WINDOWS))
def scene_windows(spark: SparkSession, d: str) -> DataFrame:
    """W5."""
    return M.scene_windows(P.scenes(spark, d))


@query(P.sql("scenes", "SELECT video_id, scene_number, idx FROM mapped", WINDOWS, MAPPED))
def scene_overlap(spark: SparkSession, d: str) -> DataFrame:
    """J4."""
    return M.scene_segments(P.segments(spark, d), M.scene_windows(P.scenes(spark, d))).select("video_id", "scene_number", "idx")


@query(P.sql("scenes", "SELECT video_id, idx, start_s FROM lost", WINDOWS, MAPPED, ORPHANS))
def orphan_segments(spark: SparkSession, d: str) -> DataFrame:
    """J6."""
    s = P.segments(spark, d)
    return M.orphans(s, M.scene_segments(s, M.scene_windows(P.scenes(spark, d)))).select("video_id", "idx", "start_s")


BUILT = """built0 AS (SELECT w.video_id, 'scene' AS kind, w.scene_number AS number, w.start_s, w.end_s, coalesce(n, 0) AS n_segments, frame_count AS n_frames FROM windows4 w LEFT JOIN (SELECT video_id, scene_number, count(*) AS n FROM mapped4 GROUP BY 1, 2) USING (video_id, scene_number)
UNION ALL SELECT video_id, 'orphan', 0, arg_min(start_s, (start_s, idx)), arg_max(end_s, (start_s, idx)), count(*), 0 FROM (SELECT * FROM spoken s ANTI JOIN mapped4 m ON m.video_id = s.video_id AND m.start_s = s.start_s) SEMI JOIN scenes4 USING (video_id) GROUP BY 1
UNION ALL SELECT video_id, 'gap', section, min(start_s), arg_max(end_s, (start_s, idx)), count(*), 0 FROM sectioned4 GROUP BY 1, 2, 3),
built AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_s, kind, number) AS section_index FROM built0)"""
FOURTH = """scenes4 AS (SELECT video_id, scene_number, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS frame_count FROM frames WHERE blur_score >= 60 GROUP BY 1, 2), spoken AS (SELECT * FROM segments WHERE trim(text) <> ''),
windows4 AS (SELECT video_id, scene_number, start_ms / 1000 AS start_s, coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY start_ms, scene_number) / 1000, end_ms / 1000 + 30) AS end_s, frame_count FROM scenes4),
mapped4 AS (SELECT s.video_id, w.scene_number, s.idx, s.start_s FROM spoken s JOIN windows4 w ON w.video_id = s.video_id AND s.start_s <= w.end_s AND s.end_s >= w.start_s),
flagged4 AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY video_id ORDER BY start_s, idx) > 10 THEN 1 ELSE 0 END AS new FROM spoken ANTI JOIN scenes4 USING (video_id)),
sectioned4 AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY start_s, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS section FROM flagged4)"""


def _sharp(spark: SparkSession, d: str) -> DataFrame:
    return P.frames(spark, d).where("blur_score >= 60")


def _built(spark: SparkSession, d: str) -> DataFrame:
    """Sections by the scenes of sharp frames; a lecture whose frames are all blurred has none, so both ways of sectioning are taken."""
    return M.sections(P.segments(spark, d), P.scenes_of(_sharp(spark, d)))


@query(P.sql("scenes", "SELECT * FROM built", FOURTH, BUILT))
def merged_sections(spark: SparkSession, d: str) -> DataFrame:
    """Q5, J4, J5, J6, P7, W5, W7, U4."""
    return _built(spark, d)


@query(P.sql("scenes", """SELECT video_id, section_count, greatest_end_s, last_end_s, coalesce(total_segments, 0) AS total_segments, coalesce(total_frames, 0) AS total_frames, coalesce(frames_with_ocr, 0) AS frames_with_ocr FROM (SELECT video_id, count(*) AS section_count, max(end_s) AS greatest_end_s, arg_max(end_s, section_index) AS last_end_s FROM built GROUP BY 1)
LEFT JOIN (SELECT video_id, count(*) AS total_segments FROM spoken GROUP BY 1) USING (video_id) LEFT JOIN (SELECT video_id, count(*) AS total_frames, count(*) FILTER (trim(clean_text) <> '') AS frames_with_ocr FROM frames WHERE blur_score >= 60 GROUP BY 1) USING (video_id)""", FOURTH, BUILT))
def lecture_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A7, A24."""
    return M.statistics(_built(spark, d), P.segments(spark, d), _sharp(spark, d))


@query(P.sql("segments", "SELECT video_id, string_agg(text, ' ' ORDER BY idx) AS full_text FROM segments GROUP BY 1"))
def full_text(spark: SparkSession, d: str) -> DataFrame:
    """A19."""
    return M.full_text(P.segments(spark, d), "video_id")


@query()
def lecture_markdown(spark: SparkSession, d: str) -> DataFrame:
    """F29."""
    scenes = P.scenes(spark, d)
    return M.lecture_markdown(M.sections(P.segments(spark, d), scenes), P.segments(spark, d), M.scene_windows(scenes), P.frames(spark, d))


@query()
def merged_lectures(spark: SparkSession, d: str) -> DataFrame:
    """Nested records, counted."""
    built = M.sections(P.segments(spark, d), P.scenes(spark, d))
    return M.lectures(P.segments(spark, d), P.frames(spark, d), built).select("video_id", F.size("sections").alias("n_sections"), F.size("segments").alias("n_segments"), F.coalesce(F.size("frames"), F.lit(0)).alias("n_frames"))


@query(P.sql("segments", "SELECT video_id, idx, CASE WHEN formula THEN 'equation' WHEN regexp_matches(text, '(?m)(def |class |import |#include|<[a-z]|\\{|\\}|;$|\\(\\))') THEN 'code' WHEN regexp_matches(lower(text), '\\b(is|are) (a|an|the)\\b|means|defined as') THEN 'definition' ELSE 'narrative' END AS structure FROM (SELECT *, regexp_matches(text, '[∑∫√²³∂≤≥≈≠]') OR (contains(text, '=') AND (regexp_matches(text, '[+\\-*/^]') OR regexp_matches(text, '\\b[A-Za-z]+\\s*=\\s*[A-Za-z0-9]'))) OR (regexp_matches(text, '\\b[A-Za-z0-9]+\\s*[+\\-*/]\\s*[A-Za-z0-9]+\\b') AND NOT regexp_matches(text, '^[A-Za-z\\s\\-]+$')) AS formula FROM segments)"))
def chunk_structure(spark: SparkSession, d: str) -> DataFrame:
    """R2, F13."""
    return P.segments(spark, d).select("video_id", "idx", X.structure(F.col("text")).alias("structure"))
