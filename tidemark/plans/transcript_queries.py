"""Registered queries over timed text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import web as W
from tidemark.operators import transcript as T
from tidemark.plans.registry import query
from tidemark.sources import projections as P

NORMAL = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
#: Cues with every kind of bad number: not a number, infinite, and negative in a blank cue.
STRANGE = """strange AS (SELECT video_id, idx, lang, CASE WHEN idx % 50 = 45 THEN ' ' ELSE text END AS text, CASE WHEN idx % 50 = 33 THEN 'inf'::DOUBLE WHEN idx % 50 = 45 THEN -2.0::DOUBLE WHEN idx % 50 = 11 THEN 'nan'::DOUBLE ELSE start_s END AS start_s,
CASE WHEN idx % 50 = 27 THEN 'nan'::DOUBLE WHEN idx % 50 = 39 THEN 'inf'::DOUBLE WHEN idx % 50 = 41 THEN NULL WHEN idx % 50 = 43 THEN -0.5::DOUBLE ELSE duration_s END AS duration_s FROM raw_cues)"""
CHECKED = f"""{STRANGE}, checked AS (SELECT *, CASE WHEN start_s IS NULL OR NOT isfinite(start_s) OR start_s < 0 THEN 'INVALID_START' WHEN duration_s IS NULL OR NOT isfinite(duration_s) OR duration_s < 0 THEN 'INVALID_DURATION' WHEN text <> '' AND end_s <= start_s THEN 'INVALID_INTERVAL' END AS reason FROM (SELECT video_id, idx, lang, {NORMAL} AS text, start_s, duration_s, start_s + duration_s AS end_s FROM strange))"""
CANON = "canon AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS idx, start_s, end_s, text, replace(lower(trim(lang)), '_', '-') AS lang FROM checked WHERE reason IS NULL AND text <> '')"
#: Cues as segments, made to overlap, repeat and run backwards at fixed places.
ROUGH = """rough AS (SELECT video_id, idx, CASE WHEN idx % 9 = 4 THEN start_s - 30 ELSE start_s END AS start_s, CASE WHEN idx % 11 = 5 THEN end_s + 20 ELSE start_s + duration_s END AS end_s, text FROM (SELECT *, start_s + duration_s AS end_s FROM raw_cues))"""
VALID = """coded AS (SELECT r.*, media_s, CASE WHEN start_s IS NULL OR NOT isfinite(start_s) THEN 'INVALID_START' WHEN end_s IS NULL OR NOT isfinite(end_s) THEN 'INVALID_END' WHEN start_s < 0 THEN 'NEGATIVE_START' WHEN end_s <= start_s THEN 'INVALID_INTERVAL' WHEN trim(coalesce(text, '')) = '' THEN 'EMPTY_SEGMENT' WHEN start_s > media_s THEN 'START_AFTER_MEDIA' END AS reject_code FROM rough r LEFT JOIN media USING (video_id)),
prior AS (SELECT *, last_value(CASE WHEN reject_code IS NULL THEN {'s': start_s, 'e': end_s, 't': replace(replace(lower(trim(text)), 'ß', 'ss'), 'ς', 'σ')} END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM coded),
valid AS (SELECT video_id, idx, start_s, end_s, text, reject_code, coalesce((reject_code IS NULL OR reject_code = 'START_AFTER_MEDIA') AND start_s < last.s, false) AS out_of_order,
  coalesce(reject_code IS NULL AND replace(replace(lower(trim(text)), 'ß', 'ss'), 'ς', 'σ') = last.t AND abs(start_s - last.s) < 0.001 AND abs(end_s - last.e) < 0.001, false) AS exact_duplicate,
  coalesce(reject_code IS NULL AND start_s < last.e, false) AS overlap, coalesce(reject_code IS NULL AND end_s > media_s + 2, false) AS end_after_media FROM prior)"""
ISSUES = """issues AS (SELECT video_id, idx, reject_code AS code, CASE reject_code WHEN 'EMPTY_SEGMENT' THEN 'warning' ELSE 'error' END AS severity FROM valid WHERE reject_code IS NOT NULL UNION ALL SELECT video_id, idx, 'OUT_OF_ORDER', 'warning' FROM valid WHERE out_of_order
UNION ALL SELECT video_id, idx, 'EXACT_DUPLICATE', 'warning' FROM valid WHERE exact_duplicate UNION ALL SELECT video_id, idx, 'OVERLAP', 'warning' FROM valid WHERE overlap UNION ALL SELECT video_id, idx, 'END_AFTER_MEDIA', 'warning' FROM valid WHERE end_after_media)"""
COUNTS = "counts AS (SELECT video_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues GROUP BY 1)"
COVER = """clamped AS (SELECT video_id, greatest(start_s, 0) AS a, least(end_s, media_s) AS b FROM rough JOIN media USING (video_id) WHERE media_s > 0 AND least(end_s, media_s) > greatest(start_s, 0)),
reached AS (SELECT *, max(b) OVER (PARTITION BY video_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM clamped),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM reached),
sums AS (SELECT video_id, sum(n) AS s FROM (SELECT video_id, island, max(b) - min(a) AS n FROM islands GROUP BY 1, 2) GROUP BY 1),
cover AS (SELECT video_id, CASE WHEN media_s > 0 THEN least(1.0::DOUBLE, coalesce(s, 0) / media_s) END AS coverage FROM media LEFT JOIN sums USING (video_id))"""
DUPES = "dupes AS (SELECT video_id, 1 - count(DISTINCT replace(replace(lower(trim(text)), 'ß', 'ss'), 'ς', 'σ')) / count(*) AS duplicate_ratio FROM rough GROUP BY 1)"
ACCEPTED = "accepted AS (SELECT * FROM valid WHERE reject_code IS NULL)"
SCORED = """parts AS (SELECT m.video_id, n, coalesce(errors, 0) AS errors, 1.0::DOUBLE - least(0.45::DOUBLE, coalesce(errors, 0) * 0.15::DOUBLE) - least(0.2::DOUBLE, coalesce(warnings, 0) * 0.02::DOUBLE)
 - CASE WHEN coverage < 0.01 THEN 0.45::DOUBLE WHEN coverage < 0.2 THEN 0.25 WHEN coverage < 0.8 THEN 0.08 ELSE 0 END - CASE source_type WHEN 'generated_caption' THEN 0.03::DOUBLE WHEN 'translated_caption' THEN 0.05 WHEN 'stt' THEN 0.03 ELSE 0 END
 - CASE WHEN replace(lower(trim(requested)), '_', '-') <> replace(lower(trim(actual)), '_', '-') THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN duplicate_ratio > 0.2 THEN 0.15::DOUBLE WHEN duplicate_ratio > 0.05 THEN 0.05 ELSE 0 END AS left_over
 FROM media m LEFT JOIN (SELECT video_id, count(*) AS n FROM accepted GROUP BY 1) USING (video_id) LEFT JOIN counts USING (video_id) LEFT JOIN cover USING (video_id) LEFT JOIN dupes USING (video_id)),
scored AS (SELECT video_id, errors, CASE WHEN coalesce(n, 0) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, left_over)) END AS score FROM parts)"""


def rough(spark: SparkSession, d: str) -> DataFrame:
    c, i = P.raw_cues(spark, d), F.col("idx")
    end = F.col("start_s") + F.col("duration_s")
    return c.select("video_id", "idx", F.when(i % 9 == 4, F.col("start_s") - 30).otherwise(F.col("start_s")).alias("start_s"), F.when(i % 11 == 5, end + 20).otherwise(end).alias("end_s"), "text")


def _strange(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("idx") % 50
    start = F.when(k == 33, float("inf")).when(k == 45, -2.0).when(k == 11, float("nan")).otherwise(F.col("start_s"))
    length = F.when(k == 27, float("nan")).when(k == 39, float("inf")).when(k == 41, None).when(k == 43, -0.5).otherwise(F.col("duration_s"))
    return P.raw_cues(spark, d).withColumns({"text": F.when(k == 45, " ").otherwise(F.col("text")), "start_s": start, "duration_s": length})


@query(P.sql("raw_cues", "SELECT video_id, idx AS segment_index, start_s, end_s, text, lang FROM canon", CHECKED, CANON))
def canonical_segments(spark: SparkSession, d: str) -> DataFrame:
    """P14, P7, W1, F1, F3."""
    return T.canonical(_strange(spark, d))[0]


SPEECH = "speech AS (SELECT video_id, idx, lang, CASE WHEN idx % 17 = 3 THEN 'NaN' WHEN idx % 17 = 5 THEN '-0.5' ELSE start_s::VARCHAR END AS start_s, CASE WHEN idx % 19 = 4 THEN 'inf' WHEN idx % 19 = 6 THEN '0' ELSE end_s::VARCHAR END AS end_s, CASE WHEN idx % 23 = 2 THEN '  ' ELSE text END AS text, -(idx % 40) / 16.0::DOUBLE AS avg_logprob FROM segments)"


@query(P.sql("segments", f"""SELECT video_id, idx, CASE WHEN reason IS NULL THEN count(*) FILTER (reason IS NULL) OVER (PARTITION BY video_id ORDER BY idx) END AS segment_index, start_s, end_s, text, lang, NULL::DOUBLE AS confidence, avg_logprob, 'whisper_stt' AS source, reason
FROM (SELECT *, CASE WHEN start_s IS NULL OR end_s IS NULL THEN 'INVALID' END AS reason FROM (SELECT video_id, idx, lang, avg_logprob, {NORMAL} AS text, CASE WHEN idx % 17 NOT IN (3, 5) THEN start_s::DOUBLE END AS start_s, CASE WHEN idx % 19 <> 4 THEN end_s::DOUBLE END AS end_s FROM speech)) WHERE reason IS NOT NULL OR (end_s > start_s AND text <> '')""", SPEECH))
def speech_segments(spark: SparkSession, d: str) -> DataFrame:
    """Recognised speech with times that are no numbers, negative or infinite at fixed places."""
    i = F.col("idx")
    s = P.segments(spark, d).withColumn("start_s", F.when(i % 17 == 3, "NaN").when(i % 17 == 5, "-0.5").otherwise(F.col("start_s").cast("string"))).withColumn("end_s", F.when(i % 19 == 4, "Infinity").when(i % 19 == 6, "0").otherwise(F.col("end_s").cast("string")))
    return T.speech(s.withColumn("text", F.when(i % 23 == 2, "  ").otherwise(F.col("text"))).withColumn("avg_logprob", -(i % 40) / 16.0))


@query(P.sql("segments", "SELECT video_id, idx, CASE WHEN idx % 7 = 1 THEN '' ELSE text END AS text, CASE WHEN idx % 5 = 2 THEN 0.0::DOUBLE ELSE start_s END AS start_s, CASE WHEN idx % 6 = 3 THEN 0.0::DOUBLE ELSE end_s - start_s END AS duration_s FROM segments"))
def caption_rows(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of each lecture as rows, with text, start or duration missing at fixed places."""
    i = F.col("idx")
    one = F.struct(i, F.when(i % 7 != 1, F.col("text")).alias("text"), F.when(i % 5 != 2, F.col("start_s")).alias("start"), F.when(i % 6 != 3, F.col("end_s") - F.col("start_s")).alias("duration"))
    return T.flattened(P.segments(spark, d).groupBy("video_id").agg(F.array_sort(F.collect_list(one)).alias("snippets")))


@query(P.sql("raw_cues", "SELECT video_id, idx, reason FROM checked WHERE reason IS NOT NULL", CHECKED))
def rejected_cues(spark: SparkSession, d: str) -> DataFrame:
    """What the canonical form leaves out, with the reason."""
    return T.canonical(_strange(spark, d))[1]


@query(P.sql("raw_cues media", "SELECT video_id, idx, code, severity FROM issues", ROUGH, VALID, ISSUES))
def segment_issues(spark: SparkSession, d: str) -> DataFrame:
    """P16, P18, W2, W3, W4."""
    return T.issues(T.validate(rough(spark, d), P.media(spark, d)))


@query(P.sql("raw_cues media", "SELECT * FROM counts", ROUGH, VALID, ISSUES, COUNTS))
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """A8."""
    return T.issue_counts(T.issues(T.validate(rough(spark, d), P.media(spark, d))))


@query(P.sql("segments media", "SELECT video_id, 'EMPTY_TRANSCRIPT' AS code, false AS valid FROM media WHERE video_id NOT IN (SELECT video_id FROM segments WHERE video_id % 7 <> 0)"))
def empty_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """P17."""
    return T.without_segments(P.media(spark, d), P.segments(spark, d).where("video_id % 7 <> 0"))


@query(P.sql("raw_cues", "SELECT * FROM dupes", ROUGH, DUPES))
def duplicate_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A9."""
    return T.duplicate_ratio(rough(spark, d))


@query(P.sql("raw_cues media", "SELECT * FROM cover", ROUGH, COVER))
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    return T.coverage(rough(spark, d), P.media(spark, d))


@query(P.sql("raw_cues media", "SELECT video_id, round(score, 4) AS score, CASE WHEN score >= 0.9 THEN 'HIGH' WHEN score >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN errors = 0 THEN 'SUCCESS' ELSE 'QUALITY_REVIEW' END AS status, CASE WHEN score >= 0.9 THEN 'EXPORT' WHEN score >= 0.7 THEN 'EXPORT_WITH_WARNINGS' ELSE 'REVIEW' END AS decision FROM scored", ROUGH, VALID, ISSUES, COUNTS, ACCEPTED, COVER.replace("rough", "accepted"), DUPES.replace("rough", "accepted"), SCORED))
def transcript_quality(spark: SparkSession, d: str) -> DataFrame:
    """Q1, Q3, N9, F32."""
    return T.quality(rough(spark, d), P.media(spark, d))


@query(P.sql("raw_cues", "SELECT video_id, bool_and(ok) AS exportable, count(*) FILTER (NOT ok) AS rejected FROM (SELECT video_id, start_s >= 0 AND start_s < end_s AND trim(text) <> '' AS ok FROM rough) GROUP BY video_id", ROUGH))
def export_gate(spark: SparkSession, d: str) -> DataFrame:
    """S10."""
    return T.gate(rough(spark, d))


CLOCK = "printf('%02d:%02d:%02d{m}%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"


def _clock(c: str, m: str) -> str:
    return CLOCK.format(x=f"round_even({c} * 1000, 0)::BIGINT", m=m)


SHORT = "printf('%02d:%02d:%02d', floor(start_s)::BIGINT // 3600, floor(start_s)::BIGINT // 60 % 60, floor(start_s)::BIGINT % 60)"
EXPORTS = f"""good AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS no FROM segments WHERE start_s >= 0 AND start_s < end_s AND trim(text) <> ''),
exports AS (SELECT video_id, 'txt' AS format, string_agg(text, chr(10) ORDER BY no) || chr(10) AS body FROM good GROUP BY 1
UNION ALL SELECT video_id, 'timestamped', string_agg('[' || {SHORT} || '] ' || text, chr(10) ORDER BY no) || chr(10) FROM good GROUP BY 1
UNION ALL SELECT video_id, 'srt', string_agg(no || chr(10) || {_clock("start_s", ",")} || ' --> ' || {_clock("end_s", ",")} || chr(10) || text || chr(10), chr(10) ORDER BY no) FROM good GROUP BY 1
UNION ALL SELECT video_id, 'vtt', 'WEBVTT' || chr(10) || chr(10) || string_agg({_clock("start_s", ".")} || ' --> ' || {_clock("end_s", ".")} || chr(10) || text || chr(10), chr(10) ORDER BY no) FROM good GROUP BY 1)"""


@query(P.sql("segments", "SELECT video_id, 'transcripts/' || video_id || '/transcript.' || format AS path, format, octet_length(encode(body)) AS bytes, sha256(body) AS sha256 FROM exports", EXPORTS))
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Digests of every text export."""
    return T.manifest(T.exports(P.segments(spark, d)).where("format <> 'json'"))


@query(P.sql("segments", "SELECT video_id, body FROM exports WHERE format = 'srt'", EXPORTS))
def srt_export(spark: SparkSession, d: str) -> DataFrame:
    """S6."""
    return T.exports(P.segments(spark, d)).where("format = 'srt'").select("video_id", "body")


def _json(spark: SparkSession, d: str) -> DataFrame:
    known = P.media(spark, d).select("video_id", F.struct(F.col("video_id").cast("string").alias("id"), F.col("actual").alias("language"), F.col("source_type").alias("source"), F.col("media_s").alias("duration")).alias("metadata"))
    return T.exports(P.segments(spark, d), known).where("format = 'json'").select("video_id", "body")


@query()
def json_export(spark: SparkSession, d: str) -> DataFrame:
    """S8; json_round_trip reads it back."""
    return _json(spark, d)


@query(P.sql("media", "SELECT g.video_id, m.actual AS language, m.source_type AS source, media_s AS duration, g.no, g.start_s, g.end_s, g.text FROM good g LEFT JOIN media m USING (video_id)", EXPORTS))
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The JSON export parsed again, with its metadata and segments."""
    whole = F.from_json("body", "metadata struct<id: string, language: string, source: string, duration: double>, segments array<struct<no: long, start_s: double, end_s: double, text: string>>")
    rows = _json(spark, d).select("video_id", whole.alias("x")).select("video_id", "x.metadata.language", "x.metadata.source", "x.metadata.duration", F.explode("x.segments").alias("s"))
    return rows.select("video_id", "language", "source", "duration", "s.no", "s.start_s", "s.end_s", "s.text")


TRACKS = "tracks AS (SELECT DISTINCT doc_id // 5 AS video_id, lang, doc_id % 2 = 1 AS generated, doc_id % 3 <> 0 AS translatable FROM documents)"


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return P.read(spark, d, "documents").select(F.floor(F.col("doc_id") / 5).alias("video_id"), "lang", (F.col("doc_id") % 2 == 1).alias("generated"), (F.col("doc_id") % 3 != 0).alias("translatable")).distinct()


@query(P.sql("", """SELECT video_id, CASE WHEN priority < 9 THEN lang END AS lang, CASE priority WHEN 0 THEN 'manual' WHEN 1 THEN 'generated' WHEN 2 THEN 'translated' END AS kind, CASE WHEN priority = 9 THEN 'NO_USABLE_CAPTIONS' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY priority, generated, lang) AS rank
FROM (SELECT *, CASE WHEN lang = 'fr' AND NOT generated THEN 0 WHEN lang = 'fr' THEN 1 WHEN translatable THEN 2 ELSE 9 END AS priority FROM tracks)) WHERE rank = 1""", TRACKS))
def caption_choice(spark: SparkSession, d: str) -> DataFrame:
    """O1."""
    return T.source_choice(_tracks(spark, d), "fr")


@query(P.sql("", "SELECT video_id, lang, generated, row_number() OVER (PARTITION BY video_id ORDER BY generated, CASE lang WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 99 END, lang) AS rank FROM tracks WHERE translatable", TRACKS))
def translation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """O2."""
    return T.translation_candidates(_tracks(spark, d), ["de", "es"])


@query(P.sql("segments", """SELECT video_id, idx, CASE WHEN a IS NULL THEN 'FIRST' WHEN a = text THEN 'EXACT' WHEN starts_with(text, a) OR starts_with(a, text) THEN 'INCREMENTAL' WHEN 1 - levenshtein(a, text) / greatest(length(a), length(text)) >= 0.9 THEN 'NEAR' ELSE 'INDEPENDENT' END AS overlap_class
FROM (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY idx) AS a FROM segments)"""))
def overlap_class(spark: SparkSession, d: str) -> DataFrame:
    """N1."""
    return T.overlap_class(P.segments(spark, d))


@query(P.sql("segments", "SELECT * FROM (SELECT video_id, idx, coalesce(start_s - lag(end_s) OVER (PARTITION BY video_id ORDER BY idx) > 10, false) AS large_gap, end_s - start_s > 60 AS long_segment FROM segments) WHERE large_gap OR long_segment"))
def pacing(spark: SparkSession, d: str) -> DataFrame:
    """N4."""
    return T.pacing(P.segments(spark, d))


@query(P.sql("", "SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 4) AS share, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1 AS dominant FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)"))
def lang_mix(spark: SparkSession, d: str) -> DataFrame:
    """N3."""
    return T.language_mix(P.read(spark, d, "documents"), "source")


@query(P.sql("segments", "SELECT video_id, idx, count(*) OVER (PARTITION BY video_id, idx // 2) > 1 AS duplicate_index FROM segments"))
def index_unique(spark: SparkSession, d: str) -> DataFrame:
    """N11, over indexes halved so that some repeat."""
    from pyspark.sql import Window

    return P.segments(spark, d).select("video_id", "idx", (F.count("*").over(Window.partitionBy("video_id", F.floor(F.col("idx") / 2))) > 1).alias("duplicate_index"))


@query(P.sql("segments", "SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx // 4, idx) AS segment_index, start_s + idx // 4 * 300.0::DOUBLE AS start_s, end_s + idx // 4 * 300.0::DOUBLE AS end_s, text FROM segments"))
def chunk_shift(spark: SparkSession, d: str) -> DataFrame:
    """N8."""
    pieces = P.segments(spark, d).withColumn("chunk", F.floor(F.col("idx") / 4))
    return T.shift_chunks(pieces, pieces.select("video_id", "chunk").distinct().withColumn("offset_s", F.col("chunk") * 300.0))


@query(P.sql("", "SELECT DISTINCT sha256(concat_ws('|', user_id, event_type, epoch_us(ts))) AS fingerprint, user_id FROM events"))
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """N6."""
    e = P.read(spark, d, "events")
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("string"))
    return e.select(F.sha2(key, 256).alias("fingerprint"), "user_id").dropDuplicates(["fingerprint"])


@query(P.sql("", "SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', ''), '\\.$', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS address FROM pages"))
def page_addresses(spark: SparkSession, d: str) -> DataFrame:
    """F8 for other hosts."""
    return P.read(spark, d, "pages").select("page_id", W.plain_address(F.col("url")).alias("address"))


FORMS = ["  https://www.youtube.com/watch?v={}  ", "https://youtu.be/{}", "http://m.youtube.com/shorts/{}/", "https://www.youtube.com./embed/{}?t=1", "https://youtube.com/live/short", "", "not a url", "https://www.youtu.be/{}", "https://youtu.be/{}/more", "https://www.youtube.com/watch?v={}&v={}", "https://www.youtube.com/live/{}/x", "ftp://youtube.com/watch?v={}", "https://music.youtube.com/watch?t=3&v={}"]
GOOD_FORMS, OTHER_HOSTS = (0, 1, 2, 3, 12), (5, 7)


@query(P.sql("", f"""SELECT page_id, CASE WHEN good THEN tail END AS id, error, false AND error IS NOT NULL AS retryable FROM (SELECT *, CASE WHEN good THEN NULL WHEN form IN {OTHER_HOSTS} THEN 'UNSUPPORTED_SOURCE' ELSE 'INVALID_URL' END AS error
FROM (SELECT page_id, page_id % {len(FORMS)} AS form, 'abc_DEF-' || lpad(page_id::VARCHAR, greatest(3, length(page_id::VARCHAR))::INTEGER, '0') AS tail, page_id % {len(FORMS)} IN {GOOD_FORMS} AND page_id < 1000 AS good FROM pages))"""))
def video_ids(spark: SparkSession, d: str) -> DataFrame:
    """The address forms, ids of a wrong length, several ids or path parts, other schemes and hosts, and junk; whether to try again."""
    tail = F.concat(F.lit("abc_DEF-"), F.when(F.col("page_id") < 1000, F.lpad(F.col("page_id").cast("string"), 3, "0")).otherwise(F.col("page_id").cast("string")))
    url = F.col("url")
    for i, form in enumerate(FORMS):
        if i != 5:
            url = F.when(F.col("page_id") % len(FORMS) == i, F.replace(F.lit(form), F.lit("{}"), tail)).otherwise(url)
    found = P.read(spark, d, "pages").select("page_id", W.video_id(url).alias("v")).select("page_id", "v.*")
    return found.join(F.broadcast(W.retry_table(spark)), "error", "left").select("page_id", "id", "error", F.coalesce("retryable", F.lit(False)).alias("retryable"))


MESSAGES = ["This is a Private Video", "Please sign in to confirm", "LOGIN needed", "Video unavailable", "The clip is not available", "HTTP 429", "Too many requests", "Read timeout", "It timed out", "private"]
CODE_OF = ["ACCESS_DENIED", "AUTH_REQUIRED", "AUTH_REQUIRED", "VIDEO_NOT_FOUND", "VIDEO_NOT_FOUND", "RATE_LIMITED", "RATE_LIMITED", "NETWORK_TIMEOUT", "NETWORK_TIMEOUT", "METADATA_FAILED", "METADATA_FAILED"]


@query(P.sql("", f"SELECT event_id, code, code NOT IN ('ACCESS_DENIED', 'AUTH_REQUIRED', 'VIDEO_NOT_FOUND') AS retryable FROM (SELECT event_id, {CODE_OF}[event_id % {len(CODE_OF)} + 1] AS code FROM events WHERE event_type = 'error')"))
def error_codes(spark: SparkSession, d: str) -> DataFrame:
    """F10."""
    message = F.lit("something else")
    for i, t in enumerate(MESSAGES):
        message = F.when(F.col("event_id") % len(CODE_OF) == i, t).otherwise(message)
    return P.read(spark, d, "events").where("event_type = 'error'").select("event_id", W.error_code(message).alias("e")).select("event_id", "e.*")


@query()
def page_text(spark: SparkSession, d: str) -> DataFrame:
    """N2 over whole pages; tested against a loop."""
    return P.read(spark, d, "pages").select("page_id", X.plain_text(F.col("html")).alias("text"))


@query(P.sql("segments", "SELECT sum(len(regexp_extract_all(text, '\\b\\d+(?:[.,]\\d+)*\\b')))::BIGINT AS numbers, sum(len(regexp_extract_all(text, '\\b\\d+\\s?(?:kg|km|cm|mm|ms|Hz|GB|MB|%)')))::BIGINT AS units, sum(len(regexp_extract_all(text, 'https?://[^\\s]+')))::BIGINT AS urls, lang FROM segments GROUP BY lang"))
def risk_terms(spark: SparkSession, d: str) -> DataFrame:
    """N5."""
    s = P.segments(spark, d).select("lang", X.risk_terms(F.col("text")).alias("r"))
    return s.groupBy("lang").agg(*[F.sum(f"r.{c}").alias(c) for c in ("numbers", "units", "urls")])


@query(P.sql("segments", "SELECT video_id, sum(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')))::BIGINT AS words, sum(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))::VARCHAR = '' )::BIGINT AS unmatched FROM segments GROUP BY video_id"))
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """A18, F4."""
    return P.segments(spark, d).groupBy("video_id").agg(F.sum(X.word_count(F.col("text"))).alias("words"), F.sum((X.match_text(F.col("text")) == "").cast("long")).alias("unmatched"))
