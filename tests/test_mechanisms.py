"""Mechanisms that span several runs or rounds: absorption, streams with timers and expiring state, restarts, replaced and nested files, relational tables."""

import hashlib
import json
import random
import re
import time
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import knowledge as K
from tidemark.operators import merge as M
from tidemark.operators import telemetry as T
from tidemark.operators import vision as V
from tidemark.sources import files
from tidemark.sources import folders
from tidemark.sources import projections as P
from tidemark.streaming import jobs as J

SECOND = 1_000_000


def absorbed_loop(n, links):
    into = {}
    for i in range(n):
        if i not in into:
            into[i] = i
            for j in sorted(b for a, b in links if a == i):
                into.setdefault(j, i)
    return into


@pytest.mark.parametrize("finish", [0, 400, K.FINISH])
def test_absorption_in_rounds_is_the_loop(spark, finish):
    rng = random.Random(7)
    crowd = {tuple(sorted(rng.sample(range(2000), 2))) for _ in range(5000)} | {(0, j) for j in range(1, 600)}  # a third of them are like the first
    chain = {(i, i + 1) for i in range(9)}
    topics = spark.createDataFrame([(1, i) for i in range(2000)] + [(2, i) for i in range(10)] + [(3, 5)], "video_id long, topic_id long")
    pairs = spark.createDataFrame([(1, *x) for x in crowd] + [(2, *x) for x in chain] + [(2, 0, 1)], "video_id long, i long, j long")
    got = {(r.video_id, r.topic_id): r.into for r in K.absorb(topics, pairs, finish).collect()}
    want = {(1, j): i for j, i in absorbed_loop(2000, crowd).items()} | {(2, j): i for j, i in absorbed_loop(10, chain).items()} | {(3, 5): 5}
    assert got == want
    assert K.absorb(topics, pairs.limit(0), finish).where("into <> topic_id").count() == 0


def test_merged_topics_by_hand(spark):
    cite = lambda *x: [{"timestamp": t, "text": s} for t, s in x]
    rows = [(1, 0, ["a", "b"], cite(("00:01", "x")), "9:00"), (1, 1, ["b", "c"], cite(("00:01", "y"), ("00:02", "z")), "10:00"), (1, 2, [], [], "08:00"), (1, 3, None, None, None)]
    topics = spark.createDataFrame(rows, "video_id long, topic_id long, takeaways array<string>, citations array<struct<timestamp: string, text: string>>, end_time string")
    into = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 2), (1, 3, 3)], "video_id long, topic_id long, into long")
    got = {r.topic_id: r for r in K.merge_topics(topics, into).collect()}
    assert (got[0].takeaways, [(c.timestamp, c.text) for c in got[0].citations], got[0].end_time, got[0].merged) == (["a", "b", "c"], [("00:01", "x"), ("00:02", "z")], "9:00", 2)
    assert (got[2].takeaways, got[2].citations, got[3].takeaways, got[3].merged) == ([], [], [], 1)


# Streams


def run_stream(spark, build, batches, schema, mode, base):
    """Rows that a stream puts out when files of rows arrive one after the other, by batch."""
    before = spark.conf.get(J.STORE[0], None)
    spark.conf.set(*J.STORE)
    out = []
    try:
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
            stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
            keep = lambda df, _, n=n: out.extend((n, r.asDict()) for r in df.collect())
            stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(J.STORE[0]) if before is None else spark.conf.set(J.STORE[0], before)
    return out


REQUESTS = "provider string, at long, request_id long, success boolean, rate_limited boolean"


def test_health_is_the_batch_whatever_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(3)}", (1000 + 20 * i) * SECOND, i, rng.random() < 0.3, rng.random() < 0.3) for i in range(120)]
    rows = [(p, at, i, ok, limited and not ok) for p, at, i, ok, limited in rows]
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(300) * SECOND)  # by five minutes at most, of which ten are waited for
    out = run_stream(spark, J.breaker, [late[:40], late[40:80], late[80:]], REQUESTS, "update", tmp_path.as_uri())
    last = {}
    for n, r in out:
        last[r["provider"]] = r
    log = spark.createDataFrame(rows, REQUESTS).withColumn("ts", F.timestamp_micros("at"))
    want = {r.provider: r for r in T.cooldowns(log).collect()}
    assert set(last) == set(want)
    for p, r in want.items():
        assert (last[p]["failures"], last[p]["cooldown_until_us"]) == (r.failures, r.cooldown_until_us)


def test_health_opens_rests_and_may_be_tried_without_a_next_row(spark, tmp_path):
    bad = [("p", s * SECOND, s, False, False) for s in (1, 2, 3)]
    quiet = [("other", 2000 * SECOND, 9, True, False)]
    out = run_stream(spark, J.breaker, [bad, quiet, [("p", 2001 * SECOND, 10, False, False)], [("p", 2002 * SECOND, 11, True, False)]], REQUESTS, "update", tmp_path.as_uri())
    told = [(n, r["state"], r["failures"], r["can_execute"]) for n, r in out if r["provider"] == "p"]
    assert told == [(0, "OPEN", 3, False), (1, "HALF_OPEN", 3, True), (2, "OPEN", 4, False), (3, "CLOSED", 0, True)]


def test_health_rests_after_a_rate_limit(spark, tmp_path):
    limited = [("p", 5 * SECOND, 1, False, True)]
    out = run_stream(spark, J.breaker, [limited, [("q", 3000 * SECOND, 2, True, False)]], REQUESTS, "update", tmp_path.as_uri())
    assert [(r["state"], r["failures"], r["cooldown_until_us"], r["can_execute"]) for _, r in out if r["provider"] == "p"] == [("CLOSED", 0, 65 * SECOND, False), ("CLOSED", 0, 65 * SECOND, True)]


def test_limiter_forgets_users_whose_window_is_over(spark, tmp_path):
    base = tmp_path.as_uri()
    schema = "user_id long, action string, at long"
    first = [(u, "click", s * SECOND) for u in range(20) for s in (10, 20, 30)]
    held = lambda: spark.read.format("statestore").option("stateVarName", "accepted").option("flattenCollectionTypes", True).load(f"{base}/state")
    out = run_stream(spark, lambda s: J.limiter(s, 2, 3600, "1 minute"), [first], schema, "append", base)
    assert sorted(r["rejected"] for _, r in out) == [False] * 40 + [True] * 20
    assert held().count() == 40
    # much later, another user: nothing of the first is left, and one who comes back starts anew
    out = run_stream(spark, lambda s: J.limiter(s, 2, 3600, "1 minute"), [[(99, "click", 50_000 * SECOND)], [(3, "click", 50_001 * SECOND)]], schema, "append", base)
    assert [r["rejected"] for _, r in out] == [False, False]
    assert {r.key.user_id for r in held().collect()} == {99, 3}


def test_log_stream_that_is_killed_between_batches_has_each_record_once(spark, tmp_path):
    base = tmp_path.as_uri()
    log = spark.range(400).select(F.col("id").alias("request_id"), F.lit("t").alias("task"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(1.239).alias("latency_ms"), F.col("id").alias("input_tokens"), F.lit(2).cast("long").alias("output_tokens"), (F.col("id") % 3 > 0).alias("success"), F.col("id").alias("video_id"), F.timestamp_seconds("id").alias("ts"))
    log.repartition(8).write.parquet(f"{base}/in")
    arriving = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    slow = arriving().withColumn("task", F.udf(lambda x: (time.sleep(0.02), x)[1])("task"))
    query = files.stream_log(slow, f"{base}/log", f"{base}/state")
    while query.isActive and (query.lastProgress or {}).get("batchId", -1) < 2:
        time.sleep(0.05)
    query.stop()
    part = files.read_log(spark, f"{base}/log").count()
    files.stream_log(arriving(), f"{base}/log", f"{base}/state").awaitTermination()
    got = files.read_log(spark, f"{base}/log").collect()
    assert 0 < part < 400 and sorted(r.request_id for r in got) == list(range(400))
    assert all(r.total_tokens == r.request_id + 2 and r.latency_ms == 1.24 and r.error_type == (None if r.success else "ERROR") for r in got)


def test_quantiles_of_hours_are_within_the_sketchs_rank_error(spark, data):
    got = {r.provider: r for r in entry.queries()["stream_quantiles"](spark, data).collect()}
    log = P.llm_requests(spark, data).where("success").select("provider", "latency_ms").toPandas()
    assert set(got) == set(log["provider"])
    for p, own in log.groupby("provider")["latency_ms"]:
        assert got[p].successes == len(own)
        assert abs((own <= got[p].p95_ms).mean() - 0.95) < 0.02 + 1 / len(own)
    none = spark.createDataFrame([("p", "2024-01-01", False, 1.0)], "provider string, ts string, success boolean, latency_ms double")
    hours = none.groupBy("provider").agg(F.count("*").alias("requests"), F.count_if("success").alias("successes"), F.kll_sketch_agg_double(F.when(F.col("success"), F.col("latency_ms"))).alias("sketch"))
    assert J.merged_quantile(hours, "provider").first().quantile is None


def test_summary_by_hour_is_the_table(spark, data):
    got = {(r.provider, r.hour): r for r in entry.queries()["stream_summary"](spark, data).collect()}
    log = P.llm_requests(spark, data).select("provider", "ts", "success", "latency_ms").toPandas()
    for key, own in log.groupby(["provider", log["ts"].dt.floor("h")]):
        r, good = got[key[0], key[1].to_pydatetime()], own[own["success"]]["latency_ms"].sort_values().to_list()
        assert (r.requests, r.successes) == (len(own), len(good))
        assert r.p95_ms is None if not good else r.p95_ms in good[max(0, int(len(good) * 0.95) - 1) : int(len(good) * 0.95) + 1]


# Files


def test_replaced_frames(spark):
    path = folders.new_folder(spark, "frames")
    frame = "video_id long, idx long, scene_number long, timestamp_ms long, blur_score double, phash string, duration_ms long, clean_text string, average_confidence double, transcript_similarity double, importance double, is_selected boolean"
    rows = lambda lectures, text: V.tables(spark.createDataFrame([(v, i, 1, 1000 * i, 1.0, "f" * 16, 5, text, 0.9, 0.1, 0.5, i == 0) for v in lectures for i in range(3)], frame))
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "video_id long")
    held = lambda: sorted((r.video_id, r.clean_text) for r in files.read_frames(spark, path, "ocr_results").collect())
    files.replace_frames(ids(*range(40)), rows(range(40), "old"), path, 7)
    for _ in range(2):
        files.replace_frames(ids(1, 2, 77), rows([1, 77], "new"), path, 7)
        assert held() == sorted([(v, "old") for v in range(40) if v not in (1, 2) for _ in range(3)] + [(v, "new") for v in (1, 77) for _ in range(3)])
    files.replace_frames(ids(*range(100)), rows([], "none"), path, 7)
    assert not folders.exists(spark, f"{path}/ocr_results/bucket=0")
    files.replace_frames(ids(5), rows([5], "again"), path, 7)
    assert held() == [(5, "again")] * 3
    names = ("video_frames", "frame_metadata", "ocr_results", "frame_scores")
    keys = [{r.frame_id for r in files.read_frames(spark, path, n).collect()} for n in names]
    assert len(keys[0]) == 3 and all(k == keys[0] for k in keys)


def test_replaced_tables_are_computed_once_however_many_lectures_are_sent(spark, monkeypatch):
    for sent in (files.SENT, 0):
        monkeypatch.setattr(files, "SENT", sent)
        path, seen = folders.new_folder(spark, "frames"), spark.sparkContext.accumulator(0)

        def looked(v, seen=seen):
            seen.add(1)
            return True

        rows = lambda lectures, text: spark.createDataFrame([(v, text) for v in lectures], "video_id long, text string").where(F.udf(looked, "boolean")("video_id"))  # noqa: E731, B023
        ids = lambda *x: spark.createDataFrame([(v,) for v in x], "video_id long")
        rows(range(30), "old").join(ids(*range(30)), "video_id", "left_semi").write.format("noop").mode("append").save()
        once = seen.value
        files.replace_frames(ids(*range(30)), {"t": rows(range(30), "old")}, path, 5)
        assert 30 <= once == seen.value - once
        files.replace_frames(ids(*range(0, 50, 2)), {"t": rows(range(0, 60, 4), "new")}, path, 5)  # 52 and 56 aren't to be replaced
        files.replace_frames(rows([1, 3], ""), {"t": rows([1, 3], "own")}, path, 5, own=True)
        got = {(r.video_id, r.text) for r in files.read_frames(spark, path, "t").collect()}
        assert got == {(v, "old") for v in range(5, 30, 2)} | {(v, "new") for v in range(0, 50, 4)} | {(1, "own"), (3, "own")}


def test_saved_lectures_move_by_lecture_only(spark, data):
    s, scenes = P.segments(spark, data), P.scenes(spark, data)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = M.saved_lectures(M.sections(s, scenes), s, M.scene_windows(scenes), P.frames(spark, data).withColumn("importance", F.col("average_confidence")))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert moved and not [x for x in moved if "scene_number" in x]


def test_lectures_with_missing_keys_get_defaults(spark, tmp_path):
    frame = {"frame_path": "f.jpg", "timestamp_sec": 1.5, "scene_number": 2}
    whole = {
        "video_id": "a", "metadata": {"title": "T"}, "statistics": {"n": 1.0},
        "sections": [{"section_id": "s", "start_time": 0.0, "end_time": 2.0, "scene_numbers": [2], "transcript_segments": [{"text": "x", "start": 0.0, "end": 1.0}], "frames": [frame | {"ocr_text": "o", "importance_score": 0.5, "transcript_similarity": 0.25}]}],
    }
    bare = {"video_id": "b", "sections": [{"section_id": "s", "start_time": 0, "end_time": 2}, {"section_id": "t", "start_time": 2, "end_time": 3, "frames": [frame]}]}
    lines = [json.dumps(whole), json.dumps(bare), '{"video_id": "c"}', '{"sections": []}', '{"video_id": "d", "sections": [{"start_time": 1, "end_time": 2}]}', '{"video_id": "e", "sections": [{"section_id": "s", "start_time": 0, "end_time": 2, "frames": [{"frame_path": "x"}]}]}', "no json"]
    (tmp_path / "lectures.json").write_text("\n".join(lines))
    got = {r.video_id: r.asDict(True) for r in files.read_lectures(spark, str(tmp_path)).collect()}
    assert [got[v]["fault"] for v in "abc"] == [None] * 3 and [got[v]["fault"] for v in "de"] == ["MISSING_KEY"] * 2
    assert sorted(str(r.fault) for r in files.read_lectures(spark, str(tmp_path)).where("video_id is null").collect()) == ["MISSING_KEY", "UNREADABLE"]
    assert {k: v for k, v in got["a"].items() if k != "fault"} == whole
    first, second = got["b"]["sections"]
    assert (first["frames"], first["scene_numbers"], first["transcript_segments"]) == ([], [], [])
    assert second["frames"] == [frame | {"ocr_text": None, "importance_score": 0.0, "transcript_similarity": 0.0}]
    assert (got["b"]["metadata"], got["b"]["statistics"], got["c"]["sections"]) == ({}, {}, [])
    again = folders.new_folder(spark, "lectures")
    files.write_lectures(files.read_lectures(spark, str(tmp_path)).where("fault is null").drop("fault"), again)
    assert {r.video_id: r.asDict(True) for r in files.read_lectures(spark, again).collect()} == {v: got[v] for v in "abc"}


def test_relational_tables_are_read_in_ranges_with_filters_pushed_down(spark):
    options = {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.range(1000).select(F.col("id").cast("int").alias("ID"), (F.col("id") % 7).cast("int").alias("USER_ID"), F.concat(F.lit("t"), "id").alias("TITLE"))
    files.write_table(df.repartition(3), "VIDEOS", "errorifexists", **options)
    got = files.read_table(spark, "VIDEOS", "ID", 5, **options)
    assert got.rdd.getNumPartitions() == 5
    assert min(len(p) for p in got.rdd.glom().collect()) == 200
    asked = got.where("USER_ID = 3 and ID > 100").select("TITLE")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(USER_ID,3)" in plan and "GreaterThan(ID,100)" in plan and "ReadSchema: struct<TITLE:string>" in plan
    assert sorted(r.TITLE for r in asked.collect()) == sorted(f"t{i}" for i in range(101, 1000) if i % 7 == 3)
    files.write_table(df.limit(0), "NOTHING", "errorifexists", **options)
    assert files.read_table(spark, "NOTHING", "ID", 5, **options).count() == 0


def test_candidate_scores_by_hand(spark):
    models = spark.createDataFrame([("a", "x", 1, 1.0), ("b", "y", 2, None), ("c", "z", 2, 0.5)], "provider string, model string, tier int, quality double")
    stats = spark.createDataFrame([("a", "x", 0.9, 2000.0, 10), ("b", "y", 0.5, 20_000.0, 4)], "provider string, model string, success_rate double, mean_latency_ms double, samples long")
    cooled = spark.createDataFrame([("a", 0, None), ("b", 4, 5_000)], "provider string, failures long, cooldown_until_us long")
    used = spark.createDataFrame([("a", 5, 100), ("b", 50, 10)], "provider string, requests long, tokens long")
    policies = spark.createDataFrame([("a", None, 10, 1000), ("b", None, 40, None)], "provider string, model string, rpd long, tpd long")
    parts = {r.provider: r for r in T.candidate_parts(models, stats, cooled, used, policies, F.lit(1_000)).collect()}
    known = lambda r: tuple(round(getattr(r, p), 6) for p in T.PARTS)
    assert known(parts["a"]) == (1.0, 1.0, 0.8, 0.5, 0.9, 0.0, 0.0)
    assert known(parts["b"]) == (0.0, 0.0, 0.0, 0.0, 0.5, 1.0, 1.0)  # it rests
    assert known(parts["c"]) == (0.5, 1.0, 0.5, 1.0, 0.5, 0.0, 0.0)  # nothing is known of it
    rested = {r.provider: r for r in T.candidate_parts(models, stats, cooled, used, policies, F.lit(5_000)).collect()}["b"]
    assert (rested.health, rested.cooldown) == (0.5, 0.0)
    weights = spark.createDataFrame([("t", 2.0, 1.0, None, 1.0, 1.0, 1.0, 3.0), ("even", *[0.0] * 7)], "task string, " + ", ".join(f"{p} double" for p in T.PARTS))
    got = {(r.task, r.provider): (r.score, r["rank"]) for r in T.candidate_scores(T.candidate_parts(models, stats, cooled, used, policies, F.lit(1_000)), weights).collect()}
    assert {k: v for k, v in got.items() if k[0] == "t"} == {("t", "a"): (4.4, 1), ("t", "c"): (3.5, 2), ("t", "b"): (-3.5, 3)}
    assert [got["even", p][1] for p in "abc"] == [1, 2, 3]  # ties by tier, provider, model


def test_export_files_are_the_bodies(spark):
    """Byte for byte, with line ends inside a text, other scripts and a text without a line end; written again, they replace only their own."""
    path = folders.new_folder(spark, "test")
    bodies = [(1, "txt", "one\r\ntwo\n"), (1, "json", '{"a":"é ß"}'), (2, "txt", "\n\n日本\n"), (2, "srt", "1\n0 --> 1\nx\n\n"), (3, "txt", "")]
    schema = "video_id long, format string, body string"
    held = lambda: {(r.video_id, r.format): (bytes(r.content), r.bytes, r.sha256) for r in files.export_files(spark, path).collect()}
    as_file = lambda b: (b if b.endswith("\n") else b + "\n").encode()
    state = lambda b: (as_file(b), len(as_file(b)), hashlib.sha256(as_file(b)).hexdigest())
    files.write_exports(spark.createDataFrame(bodies, schema), path)
    assert held() == {(i, f): state(b) for i, f, b in bodies}
    for _ in range(2):
        files.write_exports(spark.createDataFrame([(2, "txt", "new")], schema), path)
        assert held() == {(i, f): state("new" if (i, f) == (2, "txt") else b) for i, f, b in bodies}
    packed = folders.new_folder(spark, "test")
    for _ in range(2):
        files.keep_exports(spark.createDataFrame(bodies, schema), packed, 2)
        assert {(r.video_id, r.format): (bytes(r.content), r.bytes, r.sha256) for r in files.kept_exports(spark, packed).collect()} == {(i, f): state(b) for i, f, b in bodies}
    files.keep_exports(spark.createDataFrame([(2, "vtt", "new")], schema), packed, 2)
    assert {(r.video_id, r.format) for r in files.kept_exports(spark, packed).collect()} == {(1, "txt"), (1, "json"), (2, "vtt"), (3, "txt")}
    wanted = spark.createDataFrame([(2, "txt"), (2, "txt"), (9, "txt")], "video_id long, format string")
    assert sorted((r.video_id, r.status) for r in files.export_states(wanted, files.export_files(spark, path)).collect()) == [(2, "READY"), (9, "MISSING")]


def test_transcripts_of_a_library_are_packed(spark, data, tmp_path, monkeypatch):
    from tidemark.plans import file_queries as Q

    monkeypatch.setattr(Q, "_folder", lambda _: f"{tmp_path.as_uri()}/library")
    rows = entry.queries()["transcript_files"](spark, data)
    assert rows.count() == P.segments(spark, data).count()
    assert len(list(tmp_path.rglob("part-*"))) < 50 < rows.select("video_id").distinct().count()
    either = [("1", '[{"text": "x", "start": 1, "duration": 2}]'), ("2", '{"metadata": {"id": "2"}, "segments": [{"start": 1, "end": 4}, {"text": "z"}]}')]
    files.keep_transcripts(spark.createDataFrame(either, "file string, value string"), f"{tmp_path.as_uri()}/either")
    got = sorted(tuple(r) for r in files.kept_transcripts(spark, f"{tmp_path.as_uri()}/either").collect())
    assert got == [("1", 1, 1.0, 3.0, "x"), ("2", 1, 1.0, 4.0, ""), ("2", 2, 0.0, None, "z")]


class Held:
    """State of one key that counts the calls."""

    def __init__(self):
        self.rows, self.calls, self.told = [], [], None

    def get(self):
        return iter(self.rows) if self.told is None else self.told

    def put(self, rows):
        self.rows = list(rows)
        self.calls.append("put")

    def clear(self):
        self.rows = []

    def exists(self):
        return self.told is not None

    def update(self, value):
        self.told = value

    def registerTimer(self, at):
        self.calls.append("timer")

    deleteTimer = registerTimer
    getCurrentWatermarkInMs = lambda self: 0


def test_health_holds_back_rows_from_the_last_success_on_only():
    b, held, settled = J.Breaker(3, 120, 60), Held(), Held()
    b.handle, b.settled, b.held = Held(), settled, held
    frame = lambda rows: pd.DataFrame(rows, columns=["at", "request_id", "success", "rate_limited"])
    first = [(i * SECOND, i, i % 7 == 0, False) for i in range(1, 1000)]  # the last success is 994
    out = pd.concat(b.handleInputRows(("p",), iter([frame(first[500:]), frame(first[:500])]), Held()))
    assert (out["failures"].tolist(), len(held.rows)) == ([5], 6)
    out = pd.concat(b.handleInputRows(("p",), iter([frame([(996 * SECOND, 2000, True, False), (3, 2001, False, False)])]), Held()))
    assert (out["failures"].tolist(), [r[1] for r in held.rows]) == ([3], [2000, 997, 998, 999])


def test_limiter_stores_nothing_for_rejected_attempts():
    from pyspark.sql import Row

    limiter, handle = J.Limiter(2, 3600), Held()
    limiter.handle, limiter.accepted = handle, Held()
    attempts = lambda *s: [r.rejected for r in limiter.handleInputRows((1, "x"), iter([Row(at=t * SECOND) for t in s]), None)]
    assert attempts(20, 10, 30) == [False, False, True] and (limiter.accepted.calls, handle.calls) == (["put"], ["timer"])
    assert attempts(40, 50) == [True, True] and (limiter.accepted.calls, handle.calls) == (["put"], ["timer"])
    assert attempts(3611) == [False] and limiter.accepted.rows == [(20 * SECOND,), (3611 * SECOND,)]
