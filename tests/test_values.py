"""Values of queries without SQL, by loops over the smallest tables, and rows worked out by hand."""

import hashlib
import html
import json
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import text as X
from tidemark.operators import chunks as C
from tidemark.operators import knowledge as K
from tidemark.operators import search_index as SI
from tidemark.operators import transcript as TR
from tidemark.operators import vision as V
from tidemark.sources import folders
from tidemark.sources import projections as P

SEGMENTS = "video_id long, idx long, start_s double, end_s double, text string"


def rows(spark, data, name):
    return entry.queries()[name](spark, data).collect()


# Captions and notes


def test_captions_with_bad_numbers_are_rejected(spark):
    nan, inf = float("nan"), float("inf")
    cues = [(1, 1, 0.0, 1.0, "a"), (1, 2, 0.0, nan, "a"), (1, 3, 0.0, inf, "a"), (1, 4, inf, 1.0, "a"), (1, 5, nan, 1.0, "a"), (1, 6, None, 1.0, "a"), (1, 7, 0.0, None, "a"), (1, 8, -1.0, 1.0, " "), (1, 9, 0.0, 0.0, "  "), (1, 10, 2.0, 0.0, "x"), (1, 11, 2.0, -0.5, "x"), (1, 12, 5.0, 1.0, " b  c ")]
    df = spark.createDataFrame([(*c, "EN_us") for c in cues], "video_id long, idx long, start_s double, duration_s double, text string, lang string")
    good, bad = TR.canonical(df)
    assert [(r.segment_index, r.start_s, r.end_s, r.text, r.lang) for r in good.orderBy("segment_index").collect()] == [(1, 0.0, 1.0, "a", "en-us"), (2, 5.0, 6.0, "b c", "en-us")]
    start, length, interval = "INVALID_START", "INVALID_DURATION", "INVALID_INTERVAL"
    assert {r.idx: r.reason for r in bad.collect()} == {2: length, 3: length, 4: start, 5: start, 6: start, 7: length, 8: start, 10: interval, 11: length}


def test_note_with_formulas_and_examples(spark):
    schema = "title string, steps array<string>, formulas array<struct<expression: string, explanation: string>>, examples array<struct<text: string, problem: string, solution: string>>, relationships array<string>"
    df = spark.createDataFrame([("T", ["s"], [("a=b", "x"), ("c", None)], [("plain", None, None), (None, "p", "q")], ["r"]), (None, [], [], None, None)], schema)
    got = [r.note for r in df.select(K.topic_note(df).alias("note")).collect()]
    assert got[0] == "## T\n\n### How It Works (Steps)\n1. s\n\n### Mathematical Formulation\n**a=b**\n> x\n\n**c**\n\n\n### Examples\n- plain\n**Scenario:** p\n**Solution:** q\n\n\n### Relationships With Other Concepts\n- r\n\n"
    assert got[1] == "## Untitled Topic\n\n"


def test_formulas(spark):
    lines = {"∑ x": True, "a = b": True, "1 = 2 + 3": True, "= 5": False, "x + y": True, "well-known facts": False, "3 - 2": True, "plain words": False, "": False, None: None}
    df = spark.createDataFrame([(t,) for t in lines], "t string").select("t", X.is_formula(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect() if r.t is not None} == {t: v for t, v in lines.items() if t is not None}


def test_page_text_is_a_loop(spark, data):
    pages = {r.page_id: r.html for r in P.read(spark, data, "pages").collect()}

    def plain(t):
        t = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", t or "")
        t = re.sub(r"(?s)<!--.*?-->|<[A-Za-z/!?][^>]*>", " ", t)
        return re.sub(r"\s+", " ", unicodedata.normalize("NFC", html.unescape(t))).strip(" ")

    got = {r.page_id: r for r in rows(spark, data, "page_text")}
    assert set(got) == set(pages)
    text = next(c for c in got[min(got)].asDict() if c not in ("page_id", "url"))
    assert {i: r[text] for i, r in got.items()} == {i: plain(t) for i, t in pages.items()}


# Chunks


def test_token_windows_by_hand(spark):
    own = [(1, 1, 0.0, 1.0, " a b"), (1, 2, 1.0, 2.0, ""), (1, 3, 2.0, 3.0, "c  d\ne "), (1, 4, 3.0, None, "f"), (2, 1, 0.0, 1.0, "one"), (3, 1, 0.0, 1.0, None)]
    got = {(r.video_id, r.piece): (r.first_token, r.n_tokens, r.start_char, r.end_char, r.start_s, r.end_s, r.text) for r in C.token_windows(spark.createDataFrame(own, SEGMENTS), 3, 1).collect()}
    assert got == {(1, 0): (0, 3, 1, 7, 0.0, 3.0, "a b c"), (1, 1): (2, 3, 6, 12, 2.0, 3.0, "c d e"), (1, 2): (4, 2, 11, 15, 2.0, 3.0, "e f"), (2, 0): (0, 1, 0, 3, 0.0, 1.0, "one")}


@pytest.mark.parametrize(("size", "overlap"), [(5, 2), (1, 0), (300, 299), (7, 0)])
def test_token_windows_are_a_loop(spark, size, overlap):
    rng = random.Random(size)
    own = [(v, i, float(i), float(i + 1), "".join(rng.choice(["ab", " ", "  ", "ö", "\n", "x y"]) for _ in range(rng.randrange(12)))) for v in range(12) for i in range(1, 6)]
    want = {}
    for v in range(12):
        tokens, at = [], 0
        for _, _, a, z, t in sorted(r for r in own if r[0] == v):
            tokens += [(m[0], at + m.start(), at + m.end(), a, z) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
            at += len(t) + 1
        step = size - overlap
        for k in range(max(1, math.ceil((len(tokens) - overlap) / step))):
            part = tokens[k * step : k * step + size]
            if part:
                want[v, k] = (k * step, len(part), part[0][1], part[-1][2], part[0][3], part[-1][4], " ".join(x[0] for x in part))
    got = {(r.video_id, r.piece): (r.first_token, r.n_tokens, r.start_char, r.end_char, r.start_s, r.end_s, r.text) for r in C.token_windows(spark.createDataFrame(own, SEGMENTS).repartition(3), size, overlap).collect()}
    assert got == want


def test_whole_transcript_where_there_are_no_segments(spark):
    chunks = C.gather(C.after(spark.createDataFrame([(1, 1, 0.0, 1.0, "a")], SEGMENTS)))
    got = C.or_transcript(chunks, spark.createDataFrame([(1, "x"), (2, "whole text"), (3, None)], "video_id long, transcript string"))
    assert sorted((r.video_id, r.chunk_id, r.start_s, r.end_s, r.text) for r in got.collect()) == [(1, "1_range_0", 0.0, 1.0, "a"), (2, "2_0", 0.0, 0.0, "whole text"), (3, "3_0", 0.0, 0.0, "")]


# Frames


def test_bounds_of_the_match_hold_and_settle_it(spark):
    rng, words = random.Random(1), ["a", "b", "cat", "cart", "care", "ö", "x1", "longword", "longwords"]
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(8)))
    pairs = [(i, say(), say()) for i in range(800)] + [(9000, None, "a"), (9001, "", ""), (9002, "a b", "b a"), (9003, "a", "a b c")]
    df = V.word_sets(spark.createDataFrame(pairs, "i long, a string, b string"), F.col("a"), F.col("b"))
    df = df.withColumns({"low": V.ratio(F.lit(0)), "high": V.ratio(F.least(F.length("only_x"), F.length("only_y"))), "exact": V.ratio(F.coalesce(V.common("only_x", "only_y"), F.lit(0)))})
    for r in df.collect():
        assert r.exact == V.token_set_ratio(r.a, r.b) and r.low <= r.exact <= r.high


def test_match_is_a_loop(spark):
    rng, words = random.Random(2), ["alpha", "beta", "gamma", "delta", "alphas", "gam"]
    say = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(6)))
    segments = [(v, i, float(10 * i), 10.0 * i + 9, say()) for v in range(10) for i in range(1, 9)]
    frames = [(v, i, int(rng.random() * 90_000), say()) for v in range(10) for i in range(12)]
    got = {(r.video_id, r.idx): (r.segment, r.transcript_similarity, r.method) for r in V.match(spark.createDataFrame(frames, "video_id long, idx long, timestamp_ms long, clean_text string"), spark.createDataFrame(segments, SEGMENTS)).collect()}
    want = {}
    for v, i, at, text in frames:
        own = sorted(s for s in segments if s[0] == v)
        k = max([n for n, s in enumerate(own) if s[2] <= at / 1000], default=0)
        scored = [(V.token_set_ratio(text, s[4]), -s[1]) for s in own[max(0, k - 1) : k + 2]]
        score, segment = max(scored)
        want[v, i] = (-segment, score, "token_set_ratio") if score > 0 else (None, 0.0, "none")
    assert got == want


def test_recognised_lines_by_hand(spark):
    frames = spark.createDataFrame([(1, i) for i in range(3)], "video_id long, idx long")
    lines = spark.createDataFrame([(1, 0, 0, " same line ", 0.9), (1, 0, 1, "same line", 0.7), (1, 0, 2, "x", 0.8), (1, 0, 3, "7", 0.8), (1, 0, 4, "faint", 0.49), (1, 0, 5, "", 0.9), (1, 1, 0, "faint", 0.1)], "video_id long, idx long, pos int, text string, confidence double")
    got = {r.idx: (r.raw_text, r.clean_text, r.n_lines, round(r.average_confidence, 6)) for r in V.recognised(frames, lines).collect()}
    assert got == {0: ("same line\nsame line\nx\n7", "same line\n7", 4, 0.8), 1: ("", "", 0, 0.0), 2: ("", "", 0, 0.0)}


def test_vision_run_is_its_steps(spark, data):
    f = P.frames(spark, data)
    once = {(r.video_id, r.idx) for r in V.unique_frames(f).collect() if not r.is_duplicate}
    own = {(r.video_id, r.idx): r for r in f.collect()}
    by_video = defaultdict(list)
    for k in once:
        by_video[k[0]].append(own[k].blur_score)
    kept = set()
    for v, scores in by_video.items():
        s = sorted(scores)
        middle = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        sharp = {k for k in once if k[0] == v and own[k].blur_score >= max(30.0, middle * 0.5)}
        kept |= sharp or {k for k in once if k[0] == v}
    got = {(r.video_id, r.idx): r for r in rows(spark, data, "vision_run")}
    assert set(got) == kept
    matched = {(r.video_id, r.idx): r.transcript_similarity for r in V.match(f, P.segments(spark, data)).collect()}
    scenes = defaultdict(list)
    for k, r in got.items():
        assert r.transcript_similarity == matched[k]
        scenes[r.video_id, r.scene_number].append((-r.importance, r.idx, r.is_selected))
    assert all([s for _, _, s in sorted(x)] == [True] + [False] * (len(x) - 1) for x in scenes.values())


def test_lecture_pages(spark, data):
    pages = {r.video_id: r.markdown for r in rows(spark, data, "lecture_markdown")}
    scenes = defaultdict(list)
    for r in P.scenes(spark, data).collect():
        scenes[r.video_id].append(r)
    frames, said = defaultdict(list), defaultdict(list)
    for r in P.frames(spark, data).collect():
        frames[r.video_id, r.scene_number].append(r)
    for r in P.segments(spark, data).collect():
        said[r.video_id].append(r)
    assert set(pages) == set(scenes)
    for v, own in scenes.items():
        parts, own = re.split(r"(?:^|\n\n)(?=## Section )", pages[v]), sorted(own, key=lambda r: (r.start_ms, r.scene_number))
        parts = [p for p in parts if p]
        assert len(parts) == len(own)
        for n, (part, scene) in enumerate(zip(parts, own, strict=True)):
            begin, end = scene.start_ms / 1000, own[n + 1].start_ms / 1000 if n + 1 < len(own) else scene.end_ms / 1000 + 30
            heard = [r.text for r in sorted(said[v], key=lambda r: r.idx) if r.start_s <= end and r.end_s >= begin]
            shown = "\n".join("- " + r.clean_text.replace("\n", " ")[:100] for r in sorted(frames[v, scene.scene_number], key=lambda r: r.idx) if r.clean_text.strip())
            assert part.split("\n\n", 1)[1] == "\n\n".join([" ".join(heard)] * bool(heard) + [shown] * bool(shown))


# Prompts and search


def test_prompts_are_a_loop(spark, data):
    lines = defaultdict(list)
    clock = lambda s: f"{int(s) // 3600:02d}:{int(s) // 60 % 60:02d}:{int(s) % 60:02d}"
    for r in rows(spark, data, "chunks_fixed"):
        lines[r.video_id].append((r.chunk, f"[{r.chunk_id} | {clock(r.start_s)} - {clock(r.end_s)}] {r.text}"))
    got = {r.video_id: r for r in rows(spark, data, "prompts")}
    assert set(got) == set(lines)
    for v, own in lines.items():
        want = f"Extract the topics of lecture {v}.\n\n" + "\n".join(x for _, x in sorted(own))
        request = json.dumps({"task": "topics", "messages": [{"role": "user", "content": want}], "temperature": 0.2, "max_tokens": 4096}, ensure_ascii=False, separators=(",", ":"))
        assert (got[v].prompt, got[v].fingerprint) == (want, hashlib.sha256(request.encode()).hexdigest())


def bm25_loop(chunks, queries):
    held, out = defaultdict(dict), Counter()
    for v, c, t in chunks:
        own = Counter(w for w in re.split(r"[\W_]+", t.lower()) if w)
        if own:
            held[v][c] = own
    for q, v, term in set(queries):
        n, df = len(held[v]), sum(term in own for own in held[v].values())
        mean = sum(sum(own.values()) for own in held[v].values()) / n if n else 0
        for c, own in held[v].items():
            if term in own:
                out[q, v, c] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * own[term] * 2.2 / (own[term] + 1.2 * (0.25 + 0.75 * sum(own.values()) / mean))
    return out


def test_index_gives_the_scores_and_the_best_of_them(spark):
    rng, words = random.Random(3), [f"w{int(rank**1.7)}" for rank in range(1, 40)]
    chunks = [(v, c, " ".join(rng.choice(words[: rng.randrange(1, 40)]) for _ in range(rng.randrange(25)))) for v in range(3) for c in range(300)] + [(9, 1, ""), (9, 2, "one")]
    queries = [(q, q % 3, rng.choice(words)) for q in range(12) for _ in range(4)] + [(50, 9, "one"), (51, 77, "one"), (52, 0, "nowhere")]
    path = folders.new_folder(spark, "index")
    SI.build(spark.createDataFrame(chunks, "video_id long, chunk long, text string"), path, span=16)
    index, asked = SI.Index(spark, path), spark.createDataFrame(queries, "query_id long, video_id long, term string")
    want = bm25_loop(chunks, queries)
    got = {(r.query_id, r.video_id, r.chunk): r.score for r in index.scores(asked).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    top = defaultdict(list)
    for (q, v, c), s in want.items():
        top[q, v].append((-round(s, 9), c))
    found = defaultdict(list)
    for r in index.top(asked, 5).orderBy("rank").collect():
        found[r.query_id, r.video_id].append((-round(r.score, 9), r.chunk))
    assert dict(found) == {k: sorted(x)[:5] for k, x in top.items()}
    plan = index.scores(asked)._jdf.queryExecution().executedPlan().toString()
    assert f"{path}/postings".removeprefix("file://") in plan and "text" not in plan


def test_search_results_are_diverse_candidates_with_their_text(spark, data):
    hybrid = defaultdict(list)
    for r in rows(spark, data, "hybrid_rank"):
        hybrid[r.query_id].append((r.chunk, r.score))
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in P.read(spark, data, "embeddings").collect()}
    own = {(r.video_id, r.idx): (r.text, r.start_s) for r in P.segments(spark, data).collect()}
    unit = lambda x: [a / max(math.sqrt(sum(b * b for b in x)), 1e-300) for a in x]
    got = defaultdict(list)
    for r in rows(spark, data, "search_results"):
        assert (r.chunk_text, r.timestamp) == own[r.query_id, r.chunk]
        got[r.query_id].append((r["rank"], r.chunk))
    assert set(got) == set(hybrid)
    for q, candidates in hybrid.items():
        candidates = sorted(candidates, key=lambda x: (-x[1], x[0]))[:5]  # what is retrieved before it is ranked again
        v = {c: unit(vectors[(q * 13 + c) % len(vectors)]) for c, _ in candidates}
        chosen = [c for _, c in sorted(got[q])]
        assert len(chosen) == min(3, len(candidates))
        left, score = dict(candidates), dict(candidates)
        for n, c in enumerate(chosen):
            worth = {x: 0.7 * score[x] - 0.3 * max((sum(a * b for a, b in zip(v[x], v[y], strict=True)) for y in chosen[:n]), default=0.0) for x in left}
            assert worth[c] >= max(worth.values()) - 1e-5
            del left[c]


def test_scores_of_the_same_words_are_the_same_whatever_their_order(spark, tmp_path):
    rng, words = random.Random(3), [f"w{i}" for i in range(40)]
    said = {c: rng.sample(words, 12) for c in range(30)}
    chunks = [(1, 2 * c + k, " ".join(w if k == 0 else reversed(w))) for c, w in said.items() for k in (0, 1)]
    path = (tmp_path / "i").as_uri()
    SI.build(spark.createDataFrame(chunks, "video_id long, chunk long, text string").repartition(7), path)
    got = {r.chunk: r.score for r in SI.Index(spark, path).scores(spark.createDataFrame([(1, 1, w) for w in words], "query_id long, video_id long, term string").repartition(7)).collect()}
    assert len(got) == 60 and all(got[2 * c] == got[2 * c + 1] for c in said)


def test_rows_of_a_chunk_are_one_chunk(spark, tmp_path):
    path = (tmp_path / "i").as_uri()
    SI.build(spark.createDataFrame([(1, 1, "a b"), (1, 1, "B ... c"), (1, 2, "--"), (1, 3, None), (1, 4, "b")], "video_id long, chunk long, text string"), path)
    index = SI.Index(spark, path)
    assert sorted(map(tuple, index.postings().collect())) == [(1, 1, "a", 1, 4), (1, 1, "b", 2, 4), (1, 1, "c", 1, 4), (1, 4, "b", 1, 1)]
    assert [tuple(r) for r in index.lectures.collect()] == [(1, 2, 2.5)]
    assert {(r.term, r.df) for r in index.held.collect()} == {("a", 1), ("b", 2), ("c", 1)}
