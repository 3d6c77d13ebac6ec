"""Conversation repair, WARC archives and ranked search against brute force, with nulls, empties, ties, repeats and clashing columns."""

import base64
import gzip
import hashlib
import heapq
import math
import random
import re
import uuid
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, lexical, queries, warc
from tidemark.llm.storage import new_folder, remove, scratch

CLASHES = ["kind", "piece", "conv", "code", "same", "salt", "row", "id", "first_row", "digest", "n", "norm", "terms", "term", "query", "number", "rank", "score", "open", "value", "status"]


def with_clashes(df):
    for i, c in enumerate(CLASHES):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(i))
    return df


# op11


def cheapest(rows):
    """(cost, audit, repaired) of classified rows (role, text, must_go, truncated) by Dijkstra over (rows read, state), least audit first."""
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if role[0] in states[state]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*out, f"{role}:")))
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if not must_go:
                if role[:1] in states[state]:
                    heapq.heappush(heap, (cost + 5 * truncated, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if to[0] in states[state]:
                        heapq.heappush(heap, (cost + 1 + 5 * truncated, audit + "R", i + 1, to[0], (*out, f"{to}:{text}")))


def repaired_brute(rows):
    """{conv_id: the report's values} of rows (conv_id, turn, role, text)."""
    out = {}
    for c in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for k, t, r, x in rows if k == c]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, classed, counts = set(), [], Counter()
        for _, role, text in own:
            said = text.rstrip("\x20\t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            classed.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, kept = cheapest(classed)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged_rows():
    rng = random.Random(11)
    rows = []
    for c in [*range(40), None]:
        for t in range(rng.randrange(1, 30)):
            turn = None if rng.random() < 0.1 else t + rng.choice([0, 0, 0, 1])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["Hi.", "cut off", "", " \t\n", None, f"word {rng.randrange(9)}!", f"é {rng.randrange(50)}?", "end. \n"])
            rows.append((c, turn, role, text))
    rows += [(100, t, "user", f"only users {t}.") for t in range(101)] + [(101, t, "user", "the same.") for t in range(60)] + [(102, 0, "assistant", "x" * 300_000)]
    rows += [(103, t, "user" if t % 2 == 0 else "assistant", f"right {t}.") for t in range(90)] + [(104, None, None, None)] * 5
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece_rows", [conversations.PIECE_ROWS, 7, 2])
def test_op11_against_brute_force(spark, piece_rows):
    rows = damaged_rows()
    df = with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    with scratch(spark) as stored:
        pieces = stored(conversations.cut(df, piece_rows))
        if piece_rows < 10:
            assert pieces.where("open").groupBy("conv_id").count().agg(F.max("count")).first()[0] > 10
        got = {r.conv_id: tuple(r[k] for k in REPORT) for r in conversations.report(conversations.repair(pieces)).collect()}
    assert got == repaired_brute(rows)


def test_op11_pieces_by_bytes_and_empty_tables(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "long text " * 50 + ".") for t in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with scratch(spark) as stored:
        pieces = stored(conversations.cut(df, 4096, 2000))
        assert pieces.count() > 5
        assert [r.cost for r in conversations.report(conversations.repair(pieces)).collect()] == [repaired_brute(rows)[1][5]]
        none = stored(conversations.cut(df.limit(0)))
        assert conversations.report(conversations.repair(none)).count() == 0


def test_op11_shapes_are_exact():
    rng = random.Random(3)
    for _ in range(200):
        classes = bytes(rng.randrange(9) for _ in range(rng.randrange(0, 40)))
        guess, shape = conversations.shapes_of(classes, conversations.END), rng.randrange(len(conversations.SHAPES))
        assert conversations.fixed_up(classes, bytes(guess), shape) == conversations.shapes_of(classes, shape)[0]


def test_op11_damage(spark):
    rows = [(c, t, r, f"Text {c}. {t}!") for c in range(20) for t in range(8) for r in ("assistant",)] + [(None, None, None, None)]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in conversations.damaged(with_clashes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect())
    want, some = Counter(), set()
    for c, t, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20
        some.add(min(k, 5))
        role, text = say(role), say(text)
        role, text = "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        want[c, t, role, text] += 0 if k == 0 else 2 if k == 3 else 1
    assert some == set(range(6)) and got == +want


# op12


def sha1_of(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payloads():
    rng = random.Random(12)
    out = [b"", None, b"a", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40, b"\r\n\r\n" * 30, b"0\r\n\r\n", b"\xff\xfe\x00 no text", "größer – ✓".encode() * 30, bytes(rng.randrange(256) for _ in range(70_000)), b"WARC/" * 30_000]
    return out + [bytes(rng.randrange(256) for _ in range(rng.randrange(400))) for _ in range(60)] + [b"copy " * 20] * 5 + [b""]


@pytest.mark.parametrize(("segment_bytes", "least"), [(warc.SEGMENT_BYTES, 0), (64, 0), (257, 50)])
def test_op12_round_trip(spark, segment_bytes, least):
    rows = [(i, f"http://x/{i}?q=ä b\n", p) for i, p in enumerate(payloads())] + [(3, None, b"copy " * 20), (3, "u", b"copy " * 20), (None, None, b"copy " * 20), (None, None, b"own")]
    df = with_clashes(spark.createDataFrame(rows, "id long, uri string, payload binary").repartition(3))
    path = new_folder(spark)
    warc.write_archives(df, path, segment_bytes, least)
    records = warc.read_archives(spark, path).collect()
    assert Counter(r.id for r in records) == Counter(None if i is None else str(i) for i, _, _ in rows)
    assert {r.status for r in records} == {"ok"}
    full, want = Counter(), Counter()
    for i, _, p in rows:
        want[None if i is None else str(i), sha1_of(p or b"")] += 1
    for r in records:
        full[r.id, r.digest] += 1
        if r.kind == "response":
            assert (sha1_of(bytes(r.payload)), len(r.payload)) == (r.digest, r.payload_bytes)
    assert full == want
    firsts = {}
    for i, _, p in rows:
        if len(p or b"") >= least:
            firsts[p or b""] = min(firsts.get(p or b"", (True, 0)), (i is None, i or 0))
    found = warc.resolved(warc.read_archives(spark, path, keep_payloads=False)).collect()
    by_digest = {sha1_of(p): str(i) for p, (none, i) in firsts.items() if not none}
    for r in found:
        if r.kind == "revisit":
            assert r.of_id == by_digest[r.digest] and r.payload_bytes is not None and r.status == "ok"
    assert Counter(r.kind for r in found)["response"] == len(firsts) + sum(len(p or b"") < least for _, _, p in rows)
    remove(spark, path)


def made(**fields):
    block = fields.pop("block")
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_op12_foreign_and_faulty_archives(spark, tmp_path):
    plain = b"HTTP/1.0 200 OK\r\nContent-Length: 5\r\n\r\nhellojunk"
    chunks = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\nTrailer: y\r\n\r\n"
    cut, name = [chunks[:40], chunks[40:70], chunks[70:]], lambda n: f"<urn:uuid:{n}>"
    part = lambda of, i, piece, **more: made(WARC_Type="response" if i == 1 else "continuation", WARC_Record_ID=name(of if i == 1 else f"{of}-{i}"), WARC_Segment_Number=i, **({} if i == 1 else {"WARC_Segment_Origin_ID": name(of)}), **more, block=piece)
    total = {"WARC_Segment_Total_Length": len(chunks)}
    records = [
        made(WARC_Type="warcinfo", WARC_Record_ID=name("info"), block=b"x: y\r\n"),
        made(WARC_Type="response", WARC_Record_ID=name("plain"), block=plain),
        made(WARC_Type="response", WARC_Record_ID=name("chunks"), block=chunks),
        part("whole", 3, cut[2], **total), part("whole", 1, cut[0]), part("whole", 2, cut[1]), part("whole", 2, cut[1]),
        part("hole", 1, cut[0]), part("hole", 3, cut[2], **total),
        part("endless", 1, cut[0]), part("endless", 2, cut[1]),
        part("headless", 2, cut[1]), part("headless", 3, cut[2], **total),
        part("wrong", 1, cut[0]), part("wrong", 2, cut[1] + cut[2], WARC_Segment_Total_Length=7),
        part("twice", 1, cut[0]), part("twice", 2, cut[1]), part("twice", 2, cut[2]), part("twice", 3, cut[2], **total),
        made(WARC_Type="response", WARC_Record_ID=name("framing"), block=chunks.replace(b"A\r\n01", b"B\r\n01")),
        made(WARC_Type="response", WARC_Record_ID=name("digest"), WARC_Payload_Digest="sha1:AAAA", block=plain),
        made(WARC_Type="revisit", WARC_Record_ID=name("lost"), WARC_Refers_To=name("nowhere"), WARC_Payload_Digest="sha1:AAAA", block=b""),
        made(WARC_Type="revisit", WARC_Record_ID=name("again"), WARC_Refers_To=name("plain"), WARC_Payload_Digest="sha1:" + sha1_of(b"hello"), block=b""),
        made(WARC_Type="response", WARC_Record_ID=name("short"), block=plain)[:-9],
    ]
    base = tmp_path / uuid.uuid4().hex
    base.mkdir()
    (base / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    got = {r.id: r for r in warc.read_archives(spark, f"file://{base}").collect()}
    want = {"plain": "ok", "chunks": "ok", "whole": "ok", "hole": "segments missing", "endless": "segments missing", "headless": "segments missing", "wrong": "total length", "twice": "segments conflict", "framing": "framing", "digest": "digest", "short": "cut short", "lost": "ok", "again": "ok"}
    assert {k: r.status for k, r in got.items()} == {name(k): v for k, v in want.items()}
    assert {k: bytes(r.payload) for k, r in got.items() if r.payload is not None} == {name("plain"): b"hello", name("chunks"): b"abc0123456789", name("whole"): b"abc0123456789"}
    found = {r.id: r for r in warc.resolved(warc.read_archives(spark, f"file://{base}")).collect()}
    assert (found[name("lost")].status, found[name("lost")].payload_bytes) == ("unresolved", None)
    assert (found[name("again")].status, found[name("again")].payload_bytes, found[name("again")].of_id) == ("ok", 5, name("plain"))


def test_op12_empty_table(spark):
    path = new_folder(spark)
    warc.write_archives(spark.createDataFrame([], "id long, uri string, payload binary"), path)
    assert warc.resolved(warc.read_archives(spark, path)).count() == 0


# op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_brute(docs, items, k=50):
    terms = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, c, n in counted:
            m = 100 - 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("block", "k", "head"), [(lexical.BLOCK, 50, lexical.HEAD), (40, 7, 0.5)])
def test_op13_against_brute_force(spark, monkeypatch, block, k, head):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "BUCKET", 16)
    monkeypatch.setattr(lexical, "HEAD", head)
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "ÉTÉ", "x'y", "42", " ", "naïve"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary[: rng.randrange(2, 66)]) for _ in range(n))
    docs = [(i, say(rng.randrange(1, 80))) for i in range(400)] + [(i, "same text w1 w2 w3") for i in range(400, 520)]
    docs += [(None, "same text w1 w2 w3"), (7, "w1 w5"), (7, "w1 w5"), (600, None), (601, ""), (602, " .,!\x00"), (603, "rare " * 30_000), (None, say(20))]
    items = [(i, say(rng.randrange(1, 30))) for i in range(25)] + [(25, None), (26, ""), (27, "unknownword"), (28, "w1"), (28, "w2"), (None, "W3 rare"), (30, "w1 w2 w3 same text")]
    got = lexical.top_documents(with_clashes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)), with_clashes(spark.createDataFrame(items, "item_id long, text string")), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == ranked_brute(docs, items, k)


def test_op13_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.top_documents(docs.limit(0), items).count() == 0
    assert lexical.top_documents(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_warc", "op13_lexical_search"])
def test_queries_give_the_rows_of_their_sql(spark, data, name):
    c = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    got, want = queries.QUERIES[name](spark, data), c.sql(queries.ORACLE[name])
    assert sorted(want.columns) == sorted(got.columns)
    rows = want.fetchall()
    assert rows and sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, rows))


def test_counts_of_more_than_32_bits_come_through():
    import numpy as np

    from tidemark.llm import suffix_tree_lm

    for x in ([], [0], [255, 256], [5_000_000_000, 1, 2**40 + 3], [2**62]):
        planes = suffix_tree_lm._planes(np.array(x, np.int64))
        assert planes.dtype == np.uint8 and suffix_tree_lm._from_planes(planes).tolist() == x
