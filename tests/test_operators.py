"""Rows computed by hand, and loops, for what SQL can't say."""

import json
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import text as X
from tidemark.functions import web as W
from tidemark.operators import chunks as C
from tidemark.operators import knowledge as K
from tidemark.operators import retrieval as R
from tidemark.operators import telemetry as T
from tidemark.operators import transcript as TR
from tidemark.operators import vision as V
from tidemark.sources import files
from tidemark.sources import projections as P


def test_p95_is_the_floor_index(spark):
    for n, want in ((1, 0), (19, 18), (20, 19), (21, 19), (100, 95)):
        log = spark.createDataFrame([(float(i), True, "p") for i in range(n)], "latency_ms double, success boolean, provider string")
        assert T.p95(log).first().p95_ms == want
        assert T.p95_by(log, "provider").first().p95_ms == want
    empty = spark.createDataFrame([], "latency_ms double, success boolean, provider string")
    assert T.p95(empty).first().p95_ms == 0


def test_token_set_ratio():
    assert V.token_set_ratio("a b", "a b c") == 1.0
    assert V.token_set_ratio("", "a") == 0.0
    assert V.token_set_ratio("abc", "abd") == round(2 * 2 / 6, 4)
    assert V.token_set_ratio("x abc", "x abd") == round(2 * 4 / 10, 4)


def test_repair_json():
    good = {
        '{"a":1}': {"a": 1}, '```json\n{"a":1}\n```': {"a": 1}, 'see ```{"a":[1,2,],}``` there': {"a": [1, 2]}, '{"a":"x,}"}': {"a": "x,}"},
        '{"a":{"b":[1,],},}': {"a": {"b": [1]}}, '{"ä":"é"}': {"ä": "é"},
    }
    for text, want in good.items():
        assert json.loads(K.repair_json(text)[0]) == want
    for text in ("", None, "[1]", "3", '{"a" 1}', "no"):
        assert K.repair_json(text)[0] is None


def test_frames_are_unique_against_the_last_kept(spark):
    rows = [(1, i, h) for i, h in enumerate(["0" * 16, "0" * 15 + "f", "0" * 14 + "1f", None, "f" * 16])]
    got = {r.idx: r.is_duplicate for r in V.unique_frames(spark.createDataFrame(rows, "video_id long, idx long, phash string")).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False}
    # the first hash comes again after 50 and after 51 others: forgotten only in the latter case
    far = [format((1 << 64) // 61 * k % (1 << 64), "016x") for k in range(1, 52)]
    kept = [h for k, h in enumerate(far) if all((int(h, 16) ^ int(g, 16)).bit_count() >= 5 for g in [*far[:k], "0" * 16])]
    rows = [(1, i, h) for i, h in enumerate(["0" * 16, *kept[:10], "0" * 16])]
    frames = spark.createDataFrame(rows, "video_id long, idx long, phash string")
    last = lambda memory: {r.idx: r.is_duplicate for r in V.unique_frames(frames, memory=memory).collect()}[11]
    assert last(11) and not last(10)


def test_chunk_edges(spark):
    cols = "video_id long, idx long, start_s double, end_s double, text string"
    rows = [(1, 1, 0.0, 179.9375, "a"), (1, 2, 179.9375, 180.0, "b"), (1, 3, 180.0, 181.0, "c")]
    assert [r.chunk for r in C.fixed(spark.createDataFrame(rows, cols)).orderBy("idx").collect()] == [0, 0, 1]
    rows = [(1, 1, 0.0, 1.0, "x" * 2000), (1, 2, 1.0, 2.0, "y"), (1, 3, 2.0, 3.0, "z")]
    assert [r.chunk for r in C.fixed(spark.createDataFrame(rows, cols)).orderBy("idx").collect()] == [0, 0, 1]
    rows = [(1, 1, 0.0, None, "a"), (1, 2, 5.0, 200.0, "  "), (1, 3, 200.0, 201.0, "b")]
    assert [r.chunk for r in C.after(spark.createDataFrame(rows, cols)).orderBy("idx").collect()] == [0, None, 0]


def test_chunk_bounds_and_characters(spark):
    """A bound half-way is rounded to even; 2,000 characters fill a chunk, the segment that does so stays in it."""
    cols = "video_id long, idx long, start_s double, end_s double, text string"
    rows = [(1, 1, 0.125, 1.0, "x" * 2000), (1, 2, 1.0, 2.375, "y"), (1, 3, 2.375, 3.0, "z")]
    got = C.gather(C.after(spark.createDataFrame(rows, cols))).orderBy("chunk").collect()
    assert [(r.start_s, r.end_s, r.text) for r in got] == [(0.12, 2.38, "x" * 2000 + " y"), (2.38, 3.0, "z")]
    assert C.gather(C.after(spark.createDataFrame(rows, cols)), None, "chunk").orderBy("chunk").first().start_s == 0.125
    assert C.gather(C.after(spark.createDataFrame([], cols))).count() == 0


def test_transcripts_worked_by_hand(spark):
    """Issues, severities and scores of rows worked out by hand from the rules."""
    inf = float("inf")
    cols = "video_id long, idx long, start_s double, end_s double, text string"
    rows = [(1, 1, 0.0, 50.0, "a"), (1, 2, 50.0, 99.0, " "), (1, 3, 40.0, 99.0, "b"), (2, 1, inf, 2.0, "a"), (2, 2, 0.0, inf, "a"), (2, 3, 0.0, 60.0, "A"), (2, 4, 0.0005, 60.0, "a"), (3, 1, -1.0, 5.0, "x"), (4, 1, 0.0, 100.0, "a"), (5, 1, 0.0, 1.0, "a"), (5, 2, 0.001, 1.001, "a")]
    media = spark.createDataFrame([(1, 100.0, "en", "en", "manual_caption"), (2, 60.0, "en_US", "EN-us", "stt"), (3, 10.0, "en", "en", "stt"), (4, 100.0, "en", "de", "translated_caption"), (5, None, None, "en", "manual_caption")], "video_id long, media_s double, requested string, actual string, source_type string")
    segments = spark.createDataFrame(rows, cols)
    found = sorted((r.video_id, r.idx, r.code, r.severity) for r in TR.issues(TR.validate(segments, media)).collect())
    w, e = "warning", "error"
    assert found == [(1, 2, "EMPTY_SEGMENT", w), (1, 3, "OVERLAP", w), (2, 1, "INVALID_START", e), (2, 2, "INVALID_END", e), (2, 4, "EXACT_DUPLICATE", w), (2, 4, "OVERLAP", w), (3, 1, "NEGATIVE_START", e), (5, 2, "OVERLAP", w)]
    got = {r.video_id: (r.score, r.level, r.status) for r in TR.quality(segments, media).collect()}
    assert got[1] == (0.96, "HIGH", "SUCCESS")  # two warnings
    assert got[2] == (0.48, "LOW", "QUALITY_REVIEW")  # two errors, two warnings, recognised speech, half of the texts repeated
    assert got[3] == (0.0, "LOW", "QUALITY_REVIEW")  # nothing accepted
    assert got[4] == (0.75, "MEDIUM", "SUCCESS")  # translated, other language
    assert got[5] == (0.83, "MEDIUM", "SUCCESS")  # a warning, half repeated; 0.001 s apart is no exact duplicate


def test_gap_of_exactly_ten_seconds_is_no_section(spark):
    cols = "video_id long, idx long, start_s double, end_s double, text string"
    for gap, want in ((9.9375, 1), (10.0, 1), (10.0625, 2)):
        s = spark.createDataFrame([(1, 1, 0.0, 1.0, "a"), (1, 2, 1.0 + gap, 20.0, "b")], cols)
        assert C.gap_sections(s).count() == want


def test_short_scene_absorbs(spark):
    cols = "video_id long, scene_number long, start_ms long, end_ms long, frame_count long"
    for length, want in ((1999, 1), (2000, 2)):
        assert C.merge_scenes(spark.createDataFrame([(1, 1, 0, length, 1), (1, 2, length, 9000, 1)], cols)).count() == want


def test_coverage_edges(spark):
    seg = lambda *x: spark.createDataFrame([(1, i, float(a), float(b), "t") for i, (a, b) in enumerate(x)], "video_id long, idx long, start_s double, end_s double, text string")
    media = lambda m: spark.createDataFrame([(1, m)], "video_id long, media_s double")
    got = lambda s, m: TR.coverage(s, media(m)).first().coverage
    assert got(seg((0, 5), (5, 10)), 20.0) == 0.5
    assert got(seg((0, 10), (2, 3), (8, 12)), 12.0) == 1.0
    assert got(seg((15, 30)), 10.0) == 0.0
    assert got(seg((0, 5)), None) is None and got(seg((0, 5)), 0.0) is None


def test_accepted_limit_is_a_loop(spark, data):
    rows = entry.queries()["rate_limit_accepted"](spark, data).toPandas()
    events = pd.read_parquet(f"{data}/events.parquet")[["user_id", "event_type", "ts"]].drop_duplicates()
    want, kept = {}, defaultdict(list)
    for u, a, t in events.sort_values("ts").itertuples(index=False):
        kept[u, a] = [x for x in kept[u, a] if x > t - pd.Timedelta(days=1)]
        want[u, a, t] = len(kept[u, a]) >= 2
        if not want[u, a, t]:
            kept[u, a].append(t)
    assert {(u, a, t): r for u, a, t, r in rows[["user_id", "action", "ts", "rejected"]].itertuples(index=False)} == want
    live = entry.queries()["stream_limiter"](spark, data).toPandas()
    assert {(u, a, pd.Timestamp(t, unit="us")): r for u, a, t, r in live[["user_id", "action", "at", "rejected"]].itertuples(index=False)} == want


def test_rolling_stream_is_the_batch(spark, data):
    cols = ["provider", "model", "success_rate", "mean_latency_ms", "samples"]
    key = lambda n: sorted(map(tuple, entry.queries()[n](spark, data).select(*cols).collect()))
    for a, b in zip(key("stream_rolling"), key("provider_rolling"), strict=True):
        assert a[:2] == b[:2] and a[4] == b[4] and abs(a[2] - b[2]) < 1e-3 and abs(a[3] - b[3]) < 0.02


def test_every_query_runs(spark, data):
    for name, q in entry.queries().items():
        if name not in entry.oracle_sql() and not name.startswith(("op", "pipeline")):
            assert q(spark, data).count() >= 0 and q(spark, data).columns


def test_absorb_is_not_transitive(spark):
    topics = spark.createDataFrame([(1, i) for i in range(4)], "video_id long, topic_id long")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "video_id long, i long, j long")
    assert {r.topic_id: r.into for r in K.absorb(topics, pairs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_diversity(spark):
    rows = [(1, 0, 1.0, [1.0, 0.0]), (1, 1, 0.99, [1.0, 0.0]), (1, 2, 0.5, [0.0, 1.0])]
    got = {r.chunk: r["rank"] for r in R.diverse(spark.createDataFrame(rows, "query_id long, chunk long, score double, vector array<double>"), k=2).collect()}
    assert got == {0: 1, 1: 2} or got == {0: 1, 2: 2}


def test_diversity_of_many_queries_is_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(q, c, float(rng.integers(0, 9)) / 8, [float(x) for x in rng.normal(size=4)]) for q in range(60) for c in range(q % 8 + 1)]
    out = R.diverse(spark.createDataFrame(rows, "query_id long, chunk long, score double, vector array<double>"))
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # not a Python call for each query
    want = set()
    for q in range(60):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:5]
        unit, left, chosen = [np.array(r[3]) / np.linalg.norm(r[3]) for r in own], list(range(len(own))), []
        while left and len(chosen) < 3:
            best = max(left, key=lambda i: (0.7 * own[i][2] - 0.3 * max((float(unit[i] @ unit[j]) for j in chosen), default=0.0), -i))
            chosen.append(best)
            left.remove(best)
        want |= {(q, own[i][1], n) for n, i in enumerate(chosen, 1)}
    assert {tuple(r) for r in out.collect()} == want


def test_knowledge_of_all_lectures_is_a_loop(spark, data):
    rows = lambda name: sorted(map(tuple, entry.queries()[name](spark, data).collect()), key=repr)
    own = defaultdict(list)
    for r in P.segments(spark, data).orderBy("video_id", "idx").collect():
        own[r.video_id].append(r)
    shown = defaultdict(list)
    for r in P.frames(spark, data).select("video_id", "timestamp_ms").collect():
        shown[r.video_id].append(r.timestamp_ms)
    times, notation, groups, packets, risks = [], {}, defaultdict(set), [], {}
    for v, lines in own.items():
        for c, r in enumerate(lines):
            at = (f"{v}_range_{c}", r.start_s, r.end_s) if c % 3 == 0 else ("unknown", 1.5, 2.5) if c % 3 == 1 else (f"{v}_range_0", lines[0].start_s, lines[0].end_s)
            times.append((f"{v}_range_{c}", 0, *at))
            notation.setdefault((v, f"k{len(r.text) % 4}"), f"v{c}")
            groups[v, f"t{c % 2}"] |= {f"n{x % 6}" for x in (len(r.text), c) if x % 6 in (0, 2, 4)}
            said = [x.text for x in lines if r.start_s <= x.start_s <= r.end_s + 20]
            packets.append((v, c, " ".join(said), len(said), sum(r.start_s <= t / 1000 <= r.end_s + 20 for t in shown[v])))
        terms = {w.lower() for w in re.findall(r"(?<![.!?]\s)(?<!\A)\b[A-Z][a-z]{2,}\b", lines[0].text)}
        rest = " ".join(x.text for x in lines[1:]).lower()
        novel = sum(w not in rest and w != "the" for w in terms)
        risks[v] = (len(terms), novel, round(novel / len(terms), 4) if terms else 0.0)
    assert rows("source_times_all") == sorted(times, key=repr)
    assert rows("notation_merge_all") == sorted(((*k, x) for k, x in notation.items()), key=repr)
    assert rows("topic_groups_all") == sorted(((*k, ",".join(sorted(x))) for k, x in groups.items() if x), key=repr)
    assert rows("context_packets_all") == sorted(packets, key=repr)
    assert rows("hallucination_risk_all") == sorted(((v, *x) for v, x in risks.items()), key=repr)
    valid = {r.video_id: (r.kind, r.valid) for r in entry.queries()["required_keys"](spark, data).collect()}
    want = [(v, *valid[v], x[2], round(max(0.0, (1.0 if valid[v][1] else 0.5) - x[2] * 0.5), 4), (not valid[v][1]) + (x[2] > 0.3)) for v, x in risks.items()]
    assert rows("artifact_quality_all") == sorted(want, key=repr)


def test_frames_and_parts_have_their_whole_text(spark, data):
    rows = lambda name: entry.queries()[name](spark, data).collect()
    own = {(r.video_id, r.idx): r.text for r in P.segments(spark, data).collect()}
    assert sum(len(t) > 200 for t in own.values()) > 100
    clean = lambda t: re.sub(r"\s{2,}", " ", t.strip()) if len(t.strip()) > 1 or t.strip().isdigit() else ""
    features = rows("ocr_features_all")
    assert {(r.video_id, r.idx): (r.ocr, r.words, r.characters) for r in features} == {k: (clean(t), len(clean(t).split()), len(clean(t))) for k, t in own.items() if k[1] % 2}
    inside = rows("chunk_frames_all")
    assert inside and all(r.clean_text == own[r.video_id, r.idx] for r in inside)
    pages = {r.video_id: r.markdown for r in rows("unified_markdown_all")}
    assert all(f"> {r.clean_text.strip()}" in pages[r.video_id] for r in inside[:200] if len(r.clean_text) > 200)
    detail = {(r.video_id, r.idx): r.clean_text for r in rows("frame_detail_all")}
    assert all(t == (own[k] if k[1] % 5 else None) for k, t in detail.items())
    # a match is the ratio of the whole texts
    norm = {(r.video_id, r.idx): r.v for r in P.segments(spark, data).select("video_id", "idx", X.match_text(F.col("text")).alias("v")).collect()}
    matched = [r for r in rows("frame_match") if r.segment is not None]
    assert matched and all(r.transcript_similarity == V.token_set_ratio(norm[r.video_id, r.idx], norm[r.video_id, r.segment]) for r in matched)
    by_video = defaultdict(dict)
    for (v, i), t in own.items():
        by_video[v][i] = t
    assert {r.video_id: r.summary for r in rows("summaries_all")} == {v: "\n\n".join(t for i, t in sorted(x.items()) if i % 4 == 0) if any(i % 4 == 0 for i in x) else "No summary available." for v, x in by_video.items()}
    assert {r.video_id: r.context for r in rows("first_concepts_all")} == {v: ", ".join(t for _, t in sorted(x.items())[:20]) for v, x in by_video.items()}


def test_text_edges(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "t string").select(f(F.col("t")).alias("v")).first().v
    assert one(X.normalise, "a\r\n b  c ") == "a b c" and one(X.normalise, None) == ""
    assert one(X.match_text, "Été, l'an!") == "été l an"
    assert one(X.ocr_clean, " x \n7\n“a’s”   b") == "7\n\"a's\" b"
    assert one(X.is_formula, "F = ma") and not one(X.is_formula, "Non-linear regression - introduction")
    assert one(X.number, "1.5") == 1.5 and one(X.number, "NaN") is None and one(X.number, "-1") is None
    assert one(lambda c: X.clock(c.cast("double")), "3661.5") == "01:01:01,500"
    assert one(W.video_id, "https://youtu.be/abcdefghij") == (None, "INVALID_URL")
    assert one(W.video_id, " https://youtu.be/abcdefghijk/ ") == ("abcdefghijk", None) and one(W.video_id, "https://youtu.be/a/abcdefghijk") == (None, "INVALID_URL")
    assert one(W.video_id, "https://www.youtube.com/watch?v=abcdefghijk&v=abcdefghijk") == (None, "INVALID_URL") and one(W.video_id, "https://www.youtu.be/abcdefghijk") == (None, "UNSUPPORTED_SOURCE")
    assert one(W.error_code, "Sign In please") == ("AUTH_REQUIRED", False) and one(W.error_code, "private") == ("METADATA_FAILED", True) and one(W.error_code, "it TIMED out") == ("NETWORK_TIMEOUT", True)
    assert one(X.fenced, "x ```json\n{}\n``` y") == "{}" and one(X.fenced, "plain") == "plain"
    assert one(X.plain_text, "<p>a&amp;b <script>x<y</script><b>e\u0301&nbsp;c</b><!-- z --></p>") == "a&b \u00e9 c"
    assert one(X.plain_text, "if a < b and <i>b > c</i><br/><!DOCTYPE x>") == "if a < b and b > c"
    assert one(X.folded, " GROSSE Straße ") == one(X.folded, "große STRASSE") and one(X.folded, "ΛΌΓΟΣ") == one(X.folded, "λόγος")


def test_files_round_trip(spark, tmp_path):
    log = spark.createDataFrame([(1, "t", "p", "m", 1.239, 2, 3, True, 9)], "request_id long, task string, provider string, model string, latency_ms double, input_tokens long, output_tokens long, success boolean, video_id long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    files.append_log(log, f"{tmp_path}/log")
    files.append_log(log, f"{tmp_path}/log")
    got = files.read_log(spark, f"{tmp_path}/log").collect()
    assert len(got) == 2 and got[0].total_tokens == 5 and got[0].latency_ms == 1.24
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text('[{"text":"x","start":0,"duration":2}]')
    (tmp_path / "t" / "b.json").write_text('{"metadata":{},"segments":[{"text":"y","start":1,"end":3}]}')
    assert sorted((r.file, r.end_s, r.text) for r in files.read_transcripts(spark, f"{tmp_path}/t").collect()) == [("a", 2.0, "x"), ("b", 3.0, "y")]


def test_dense_compares_all_parts_and_breaks_ties_by_id(spark, monkeypatch):
    monkeypatch.setattr(R, "PART", 30)
    monkeypatch.setattr(R, "BLOCK", 7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    rows = [(i, base[i % 40].tolist()) for i in range(200)]  # each vector five times
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    try:
        got = {(r.query_id, r["rank"]): r.vec_id for r in R.dense(vectors.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), vectors, 7).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    want = {}
    for q in range(0, 200, 5):
        s = np.round(unit @ unit[q % 40], 9)
        order = sorted((x for x in range(200) if x != q), key=lambda x: (-s[x % 40], x))
        want |= {(q, n + 1): x for n, x in enumerate(order[:7])}
    assert got == want


def test_overlap_counts_edits_in_bytes(spark):
    a = "x" * 95
    rows = [(1, 1, a + "äöüäö"), (1, 2, a + "     "), (2, 1, a + "abcde"), (2, 2, a + "     ")]  # 10 bytes in 5 characters, and 5 in 5
    got = {(r.video_id, r.idx): r.overlap_class for r in TR.overlap_class(spark.createDataFrame(rows, "video_id long, idx long, text string")).collect()}
    assert got[1, 2] == "NEAR" and got[2, 2] == "NEAR"
    rows = [(1, 1, a + "äöüäöü"), (1, 2, a + "      ")]  # 6 characters, but 12 bytes of 101 characters
    assert {r.idx: r.overlap_class for r in TR.overlap_class(spark.createDataFrame(rows, "video_id long, idx long, text string")).collect()}[2] == "INDEPENDENT"


def test_folds_of_frames_and_scenes_take_many_lectures_a_call(spark, data):
    for name in ("frame_dedup", "scene_merge", "vision_run"):
        assert "FlatMapGroupsInPandas" not in entry.queries()[name](spark, data)._jdf.queryExecution().toString()
