"""Each training-data operator against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bloom, bpe, bwt, components, decontamination, embedding_dedup, exchange, filtering, hashing, jaccard_join, line_dedup, quality, rarest, substring_dedup, suffix_dedup, suffix_tree_lm, token_counts
from tidemark.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["batch", "body", "shard", "row", "hash", "seeds", "id", "component", "lines", "line", "gone", "n", "level", "kept"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts():
    rng = random.Random(5)
    vocabulary = ["alpha", "Béta", "gamma", "delta,", "naïve", "x", "Omega's", "42", "ß", "–"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    a, b = say(60), say(45)
    out = [a, a, f"{b}\n{say(20)}", None, "", "   \n\t", "one two", "one two", "the end.", f"{say(10)} {b} {say(9)}", a.replace("gamma", "Gamma"), say(400), f"{a} tail", "aaaa " * 80, "aaaa " * 81]
    return out + [say(rng.randrange(1, 90)) for _ in range(40)] + [b, "a\x00b \x1c c" * 9, "line one\nline one\nLINE ONE \nanother line here\n"]


def documents(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(i))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_word_spans_are_the_contract():
    t = ["a b", None, "", " x\ty\x0bz\x1cq ", "é  ü"]
    buf, offsets = hashing.flat(pa.array(t, pa.string()))
    start, end, row = hashing.word_spans(buf, offsets)
    got = [(int(r), buf[a:b].tobytes().decode()) for a, b, r in zip(start, end, row, strict=True)]
    assert got == [(i, w) for i, x in enumerate(t) for w in WORD.findall(x or "")]


def test_op4_against_brute_force(spark, docs, empty):
    own = list(enumerate(texts()))
    words, first = {i: WORD.findall(t or "") for i, t in own}, {}
    for i, w in words.items():
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    got = by_id(substring_dedup.remove_repeats(docs))
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(gone), kept)
        assert sum(s.last - s.first + 1 for s in got[i].spans) == sum(gone)
    assert substring_dedup.remove_repeats(empty).count() == 0
    same = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"
    rows = substring_dedup.remove_repeats(documents(spark, [(7, same), (7, same), (None, same)])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in rows) == [(False, 0), (False, 0), (True, 13)]


def test_op5_against_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    own = list(enumerate(texts())) + [(900, "<|endoftext|> it's they'LL x<|startoftext|>y é ́a"), (901, "long " * 3000)]
    got = by_id(bpe.encode_decode(documents(spark, own), tokenizer("word_bpe_49k.json"), mean_words=4))
    for i, x in own:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_decode(empty, tokenizer("word_bpe_49k.json")).count() == 0


def test_op5_where_white_space_does_not_split(spark, tmp_path):
    """A tokenizer whose pre-tokens span white space encodes whole texts."""
    import json

    with open(tokenizer("word_bpe_49k.json")) as f:
        own = json.load(f)
    assert bpe.splits_at_space(own)
    vocab = {c: i for i, c in enumerate(["a", "b", " ", "x", " b", "a b", " x", "b x"])}
    model = {"type": "BPE", "vocab": vocab, "merges": [[" ", "b"], ["a", " b"], [" ", "x"], ["b", " x"]], "unk_token": None, "fuse_unk": False}
    own = {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "truncation": None, "padding": None, "model": model}
    assert not bpe.splits_at_space(own)
    path = tmp_path / "toy.json"
    path.write_text(json.dumps(own))
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(str(path)), random.Random(2)
    rows = [(i, " ".join(rng.choice("abx") for _ in range(60))) for i in range(20)]
    got = by_id(bpe.encode_decode(documents(spark, rows), str(path), mean_words=4))
    for i, x in rows:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == t.encode(x).ids


def test_op5_repairs_a_join():
    class Toy:
        """Merges 'a b' across white space, so chunks don't encode alone as they do together."""

        def whole(self, xs):
            return [b"".join(bytes([c, 0, 0, 0]) for c in x.replace(b"a b", b"\x01").replace(b" ", b"")) for x in xs]

    raw = b"x a b y"
    words = (np.array([0, 2, 4, 6]), np.array([1, 3, 5, 7]), np.array([0, 2]), np.array([1, 3]))
    begin, stop = np.array([0, 4]), np.array([3, 7])
    parts = Toy().whole([raw[0:3], raw[4:7]])
    assert bpe._bad_joins(Toy(), raw, np.array([0, 0]), parts, words) == {0}
    assert b"".join(bpe._repair(Toy(), raw, begin, stop, parts, words, 0)) == Toy().whole([raw])[0]


def test_bwt_and_common_prefixes():
    rng = random.Random(1)
    for _ in range(60):
        own = [bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
        symbols = (np.frombuffer(b"".join(own), np.uint8) - 96).astype(np.uint8)
        transform, common = bwt.build(symbols, np.array([len(t) for t in own]))
        suffixes = sorted((t[o:], i, o) for i, t in enumerate(own) for o in range(len(t) + 1))
        assert transform.tolist() == [0 if o == 0 else own[i][o - 1] - 96 for _, i, o in suffixes]
        shared = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert common.tolist() == [0] + [shared(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]


def test_op6_against_brute_force(spark, docs, empty):
    own = [(i, (t or "").encode()) for i, t in enumerate(texts())]
    first = {}
    for i, x in own:
        for p in range(len(x) - 49):
            first.setdefault(x[p : p + 50], i)
    got = by_id(suffix_dedup.remove_repeats(docs))
    for i, x in own:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 49):
            if first[x[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(x) else 0
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(x), int(gone.sum()), spans, kept)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    rows = suffix_dedup.remove_repeats(documents(spark, [(7, "z" * 60), (7, "z" * 60), (None, "z" * 60)])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in rows) == [(False, 0), (False, 0), (True, 60)]


@pytest.mark.parametrize("depth", [3, 1])
def test_op7_against_counts(spark, docs, empty, depth):
    own = list(enumerate(texts()))
    least = 3
    tokens = {i: WORD.findall(lower(t)) + ["\0"] for i, t in own}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(tuple(tokens[i][p : p + k]) for i in train for k in range(1, depth + 2) for p in range(len(tokens[i]) - k + 1))
    words = {x for x, in (g for g in count if len(g) == 1)}
    n, v, t = sum(count[x,] for x in words), len(words), {}
    root = lambda x: (count[x,] + 0.5) / (n + 0.5 * (v + 1))

    def p(context, x):
        """By the longest retained suffix of the context."""
        if not context:
            return root(x)
        below = p(context[1:], x)
        return (count[(*context, x)] + t[context] * below) / (count[context] + t[context]) if context in t else below

    for k in range(1, depth + 1):
        gain, kinds = defaultdict(float), Counter()
        for g, c in count.items():
            if len(g) == k + 1 and count[g[:-1]] >= least:
                gain[g[:-1]] += c * math.log(c / count[g[:-1]] / p(g[1:-1], g[-1]))
                kinds[g[:-1]] += 1
        t |= {s: kinds[s] for s in kinds if gain[s] > 0.5 * kinds[s] * math.log(count[s])}
    assert {len(s) for s in t} == set(range(1, depth + 1))
    got = by_id(suffix_tree_lm.score(docs, min_count=least, depth=depth))
    for i, w in tokens.items():
        score = sum(math.log10(p(tuple(w[max(0, j - depth) : j]), x)) for j, x in enumerate(w))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(w), sum(count[x,] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10(root(x)) for x in w)) and r.score == pytest.approx(score)
    assert suffix_tree_lm.score(empty).count() == 0
    assert len(suffix_tree_lm.score(documents(spark, [(3, "a"), (3, "a"), (None, None)]), min_count=1).collect()) == 3


def test_op7_reads_the_batches_that_it_repacked(spark):
    """Streams of words are bodies of arrays, not of rows, and every round reads them as such; null keys and empty texts come back."""
    got = suffix_tree_lm.score(documents(spark, [(2, "a b a b"), (3, ""), (None, None), (-4, "c")]), min_count=1).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == [(False, -4, 2), (False, 2, 5), (False, 3, 1), (True, 0, 1)]
    assert all(r.score < 0 and r.base_score < 0 for r in got)


def test_op7_keeps_contexts_of_a_large_corpus(spark):
    """A context of min_count occurrences counts however many tokens there are besides."""
    rng = random.Random(12)
    train = [i for i in range(1000) if not suffix_tree_lm.held_out(i)]
    own = {i: " ".join(rng.choices("abcdefgh", k=1000)) for i in train[2:702]}
    own |= {i: "seldom seen" for i in train[:2]}
    got = by_id(suffix_tree_lm.score(documents(spark, list(own.items())), min_count=2))
    r = got[train[0]]
    n, kinds = r.train_tokens, 8 + 2 + 1
    assert n > 700_000
    root = lambda c: (c + 0.5) / (n + 0.5 * (kinds + 1))
    seen, end = (2 + root(2)) / 3, (2 + root(702)) / 3
    assert r.score == pytest.approx(math.log10(root(2)) + math.log10(seen) + math.log10((2 + end) / 3))


def test_op8_against_the_library(spark, docs, empty):
    ranks = tokenizer("byte_bpe_50k.tiktoken")
    n = [len(token_counts._encoding(ranks).encode_ordinary(t or "")) for t in texts()]
    rows = token_counts.token_counts(docs, ranks).orderBy("n_tokens").collect()
    assert [(r.n_tokens, r.n_docs) for r in rows] == sorted(Counter(n).items())
    for r in rows:
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n) and r.docs_beyond == sum(x > r.n_tokens for x in n)
        assert r.tokens_within + r.tokens_beyond == sum(n) and r.quantile == pytest.approx(sum(x <= r.n_tokens for x in n) / len(n))
    assert token_counts.token_counts(empty, ranks).count() == 0


def jaccard_brute(own):
    sets = {}
    for i, t in own:
        w = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("hot", [16, 2])
def test_op9_against_brute_force(spark, empty, monkeypatch, hot):
    """Also with parts held to be hot from three members on, so that the ways for large groups are taken, and with links joined in rounds alone."""
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    if hot == 2:
        monkeypatch.setattr(components, "LAST", 0)
    rng = random.Random(3)
    own, base = list(enumerate(texts())), [[f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 30, 120, 300]))] for _ in range(6)]
    boiler = [f"b{i}" for i in range(60)]
    for k in range(60):  # near copies about the threshold, some around a common passage
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(w) // 25)):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        own.append((1000 + k, " ".join(boiler + w if k % 3 == 0 else w)))
    want = jaccard_brute(own)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(documents(spark, own)).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)
    kept = {r.doc_id for r in jaccard_join.one_of_each(documents(spark, own)).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}
    if hot == 16:
        assert jaccard_join.similar_documents(empty).count() == 0
        rows = jaccard_join.similar_documents(documents(spark, [(5, "a b c d e f"), (5, "x y z u v w"), (2, "X y z u v w"), (None, "a b c d e f")])).collect()
        assert sorted((r.doc_id or -1, r.component_id or -1) for r in rows) == [(-1, -1), (2, 2), (5, 2), (5, 2)]


def test_op2_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((120, 16)).astype(np.float32)
    v[40:70] = v[3] + 0.12 * rng.standard_normal((30, 16))
    v[70:80] = v[5] * np.linspace(0.5, 3, 10)[:, None]
    v[80:95] = v[6]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [float("inf")] + [1.0] * 15), (505, [None] + [1.0] * 15), (506, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("raw", F.lit("x"))
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, 0)
    root = components.forest(120, *np.nonzero(s >= 0.9))
    for block in (512, 4):  # small blocks deal one bucket out to many tasks
        got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, block=block).collect()}
        assert [got[i].n_links for i in range(120)] == (s >= 0.9).sum(axis=1).tolist()
        assert [got[i].component_id for i in range(120)] == root.tolist()
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(500, 507))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_op2_shards_grow_in_number_and_not_in_size(spark, monkeypatch):
    """However few the shuffle partitions are; vectors in 4 bytes a number, in 8, and both in one group."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((700, 16))
    v[100:220] = v[3] + 0.02 * rng.standard_normal((120, 16))  # a bucket in each table
    v[::2] = v[::2].astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_dedup, "SHARD", 64, raising=False)
    grouped, group = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *by: (grouped.append(self) if by == ("shard",) else None) or group(self, *by))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, block=16).collect()}
    whole = next(x for x in grouped if "raw" in x.columns)
    sizes = [r["count"] for x in grouped for r in group(x, "shard").count().collect()]
    assert sum(sizes) > 30_000 and max(sizes) < 512  # 16 shards otherwise
    assert len({len(r.raw) for r in whole.select("raw").collect()}) == 2
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, 0)
    root = components.forest(700, *np.nonzero(s >= 0.9))
    assert got == {i: (int((s[i] >= 0.9).sum()), int(root[i])) for i in range(700)}


def test_op2_bounds_of_sketches_hold_and_tell_far_from_near():
    rng = np.random.default_rng(8)
    for dims in (1, 3, 64):
        v = np.r_[rng.standard_normal((40, dims)), rng.standard_normal((40, dims)) * np.logspace(0, -6, dims), np.eye(dims)[:1], -np.eye(dims)[:1]]
        v = np.r_[v, v + 0.2 * rng.standard_normal(v.shape) * np.abs(v).max(axis=1, keepdims=True)]
        unit = embedding_dedup._unit([x.tobytes() + b"\0" for x in v])
        raw = embedding_dedup._sketches(unit)
        assert raw.shape == (len(v), dims + 8)
        of = np.ascontiguousarray(raw[:, :8]).view(np.float32).astype(np.float64)
        about = raw[:, 8:].view(np.int8) * of[:, :1]
        bound, exact = about @ about.T + of[:, 1] + of[:, 1, None], unit @ unit.T
        assert (bound >= exact - 1e-7).all() and (bound - exact).max() < 0.1
        at = np.arange(len(v))
        shard = pa.table({"bucket": at // 41, "tab": np.zeros(len(v), np.int32), "low": np.zeros(len(v), np.int32), "high": np.zeros(len(v), np.int32), "own": np.zeros(len(v), np.int32), "no": at, "sketch": pa.array([x.tobytes() for x in raw], pa.binary())})
        near = (exact >= 0.9) & (at[:, None] // 41 == at // 41) & (at[:, None] != at)
        far = ((exact < 0.8) | (at[:, None] // 41 != at // 41) | (at[:, None] == at)).all(axis=1)
        got = np.isin(at, embedding_dedup.promising(shard, 0.9).column("no").to_numpy())
        assert got[near.any(axis=1)].all() and not got[far].any()


def test_op2_a_shard_of_near_copies_needs_little_memory():
    rng, k, tables = np.random.default_rng(6), 8, 32
    v = (np.ones(64) + 0.05 * rng.standard_normal((1024, 64))).astype(np.float32)
    at = np.tile(np.arange(1024), tables)
    tab = np.repeat(np.arange(tables), 1024)
    shard = pa.table({"shard": np.zeros(len(at), np.int32), "bucket": tab.astype(np.int64), "tab": tab.astype(np.int32), "low": np.zeros(len(at), np.int32), "high": np.ones(len(at), np.int32), "own": (at % 2).astype(np.int32), "rep": at, "copies": np.ones(len(at), np.int64), "raw": pa.array([v[i].tobytes() for i in at], pa.binary())})
    tracemalloc.start()
    try:
        out = embedding_dedup.checked(shard, k, tables, 0.9, 7)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6  # all pairs of the shard are 134 MB
    keys = embedding_dedup._keys(embedding_dedup._unit([x.tobytes() for x in v]), k, tables, 7)
    assert all((embedding_dedup._keys(embedding_dedup._unit([v[i].tobytes()]), k, tables, 7) == keys[i]).all() for i in range(0, 1024, 50))
    new = np.ones((512, 512), bool)
    want = np.zeros(1024, np.int64)
    for t in range(tables):  # a pair counts where it doesn't share an earlier key
        if t:
            new &= keys[::2, t - 1, None] != keys[None, 1::2, t - 1]
        want[::2] += new.sum(axis=1)
        want[1::2] += new.sum(axis=0)
    assert out.column("n").to_pylist() == want.tolist() and set(out.column("root").to_pylist()) == {0}


def test_op3_tiles_and_pairs(spark, docs, empty):
    words = lambda t: np.array([zlib.crc32(w.encode()) for w in t.split()], np.uint64)
    item = "a b c d e f g h i j"
    assert sorted(n for _, _, n in decontamination.tiles(words("x f g h i j y a b c d e z"), words(item), 5)) == [5, 5]
    assert decontamination.tiles(words("a b c d x e f g h"), words(item), 5) == []
    assert [n for _, _, n in decontamination.tiles(words("a b c d e f g h i j " * 2), words(item), 5)] == [10]
    rng = random.Random(8)
    items = [(k, " ".join(f"t{rng.randrange(500)}" for _ in range(20))) for k in range(4)] + [(9, None), (10, ""), (11, "too short")]
    first, second = items[0][1].split()[:10], items[0][1].split()[10:]
    own = [(0, f"pad {items[1][1].upper()}, pad"), (1, " ".join([*second, "between", *first])), (2, " ".join(items[2][1].split()[:9])), (3, "clean text of no account at all"), (4, None), (5, ""), (5, items[3][1]), (5, items[3][1]), (None, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("seed", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(documents(spark, own), bench).collect()}
    assert set(got) == {(0, 1), (1, 0), (5, 3), (None, 2)}
    assert got[1, 0].n_tiles == 2 and got[1, 0].coverage == 1.0
    kept = decontamination.clean(documents(spark, own), bench)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == [(False, 2), (False, 3), (False, 4), (True, 0)]
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def lines_brute(own):
    """(text, n_lines, n_removed) of each row by comparing every line with every other one."""
    trim = lambda x: x.strip(" \t\n\x0b\x0c\r")
    shingles = lambda x: {x[i : i + 8] for i in range(max(1, len(x) - 7))}
    places = [(i, k, trim(lower(x)).encode()) for i, t in own if i is not None and t is not None for k, x in enumerate(t.split("\n"))]
    lines = sorted({x for _, _, x in places if x})
    sets = [shingles(x) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = components.forest(len(lines), np.array([i for i, _ in links], int), np.array([j for _, j in links], int)).tolist()
    of, first = dict(zip(lines, root, strict=True)), {}
    for i, k, x in sorted(places):
        if x:
            first.setdefault(of[x], (i, k))
    out = []
    for i, t in own:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        parts = t.split("\n")
        stay = [x for k, x in enumerate(parts) if i is None or not trim(x) or first[of[trim(lower(x)).encode()]] == (i, k)]
        out.append((i, "\n".join(stay), len(parts), len(parts) - len(stay)))
    return out


@pytest.mark.parametrize("group", [8, 2])
def test_op10_against_brute_force(spark, empty, monkeypatch, group):
    """Also with buckets of three lines held to be large; texts, counts and hashes of every document."""
    monkeypatch.setattr(line_dedup, "GROUP", group)
    rng = random.Random(4)
    base = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(99)}" for _ in range(40)) for _ in range(12)]
    lines = []
    for k in range(160):  # families about the threshold, and a passage that many have in common
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(40)] = f"q{k}{rng.randrange(99)}"
        lines.append((" ".join(base[0].split()[:25]) + " " if k % 4 == 0 else "") + " ".join(w))
    long = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark forest tonight"
    own = [(i, "\n".join(rng.sample(lines, 3) + rng.choice([["short"], ["", " \t"], []]))) for i in range(90)]
    own += [(100, f"{long}\nunique zero here"), (101, f"  {long.upper()}  \nunique one there\n\n"), (102, long.replace("tonight", "again")), (103, f"Short\n{long}\nshort"), (104, None), (105, ""), (106, " \n\t" + " " * 40), (107, "Short"), (107, "Short\nother things entirely"), (None, long), (108, "x" * 300_000), (109, "x" * 300_000 + "y\n" + "z " * 50_000)]
    own += [(200 + i, t) for i, t in enumerate(texts())]
    df = documents(spark, own)
    for c in ("n_lines", "n_removed", "kept_sha256", "dropped_lines", "dropped_from", "check", "number", "part"):
        df = df.withColumn(c, F.lit("clash"))
    rows = line_dedup.remove_lines(df).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in rows), key=key) == sorted(lines_brute(own), key=key)
    assert all(r.kept_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and r.part == "clash" for r in rows)
    assert all(r[c] == i for r in rows for i, c in enumerate(CLASHES))
    assert line_dedup.remove_lines(empty).count() == 0


def test_op10_recall_of_the_shipped_bands():
    """Pairs just above 0.8, short and long: all but a few in ten thousand share a bucket, whatever its size."""
    rng = np.random.default_rng(7)
    for size, tail in ((30, 2), (50, 4), (107, 11), (307, 33)):
        n = 5000
        lines = rng.integers(33, 127, (2 * n, size)).astype(np.uint8)
        lines[n:, : size - tail] = lines[:n, : size - tail]
        start = np.arange(2 * n) * size
        keys = line_dedup.signatures(lines.ravel(), start, start + size)
        assert ((keys[:, :n] == keys[:, n:]).sum(axis=0) >= 1).mean() > 0.998


def test_op10_shingles_are_held_piece_by_piece(monkeypatch):
    """A batch of lines, or of pairs as long as a batch, is verified and hashed half a megabyte of lines at a time, with the same results."""
    rng = np.random.default_rng(9)
    raw = rng.integers(97, 122, (6000, 400)).astype(np.uint8)
    lines = [bytes(x[: 5 + i % 400]) for i, x in enumerate(raw)] + [b"y" * 700_000]
    table = pa.table({"id": pa.array(range(len(lines)), pa.int64()), "line": pa.array(lines, pa.binary())})
    held, shingles = [], line_dedup._shingles
    monkeypatch.setattr(line_dedup, "_shingles", lambda *a: (held.append(len(a[0])), shingles(*a))[1])
    got, n = line_dedup._hashes(table)
    assert n.tolist() == [len({x[i : i + 8] for i in range(max(1, len(x) - 7))}) for x in lines[:-1]] + [1] and len(got) == n.sum()
    assert len(held) > 2 and sorted(held)[-2] <= 512 << 10 and max(held) == 700_000
    held.clear()
    same = pa.RecordBatch.from_arrays([table["id"].combine_chunks(), table["id"].combine_chunks(), *[table["line"].combine_chunks()] * 2], ["a", "b", "a_line", "b_line"])
    assert sum(b.num_rows for b in line_dedup.verified(iter([same]), 80)) == len(lines)
    assert sorted(held)[-2] <= 512 << 10 and max(held) == 1_400_000


def test_op10_hashes_of_a_line_depend_on_its_bytes_alone():
    """Alone, among others and in blocks of its own: the same two hashes and band keys, by one call; a byte more or less gives others."""
    rng = random.Random(8)
    lines = [bytes(rng.choices(b"abcdefgh ", k=n)) + b"." for n in [*range(25), 100, 40_000, 300_000, *rng.choices(range(200), k=400)]]
    lines += [x + b"z" for x in lines] + lines
    ends = np.cumsum([len(x) + 3 for x in lines])
    buf, start, end = np.frombuffer(b"".join(x + b"\n\0 " for x in lines), np.uint8), ends - 3 - [len(x) for x in lines], ends - 3
    (ids, check), keys = line_dedup.line_ids(buf, start, end), line_dedup.signatures(buf, start, end)
    n = len(set(lines))
    assert len(set(ids.tolist())) == len(set(check.tolist())) == len(set(ids.tolist()) | set(check.tolist())) / 2 == n
    first = {}
    for i, x in enumerate(lines):
        assert first.setdefault(x, (ids[i], check[i], keys[:, i].tolist())) == (ids[i], check[i], keys[:, i].tolist())
    for x in lines[:40]:
        alone = np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)])
        a, b = line_dedup.line_ids(*alone)
        assert first[x] == (a[0], b[0], line_dedup.signatures(*alone)[:, 0].tolist())
    assert all(len(x) == 0 for x in line_dedup.line_ids(buf, start[:0], end[:0])) and line_dedup.signatures(buf, start[:0], end[:0]).shape == (16, 0)
    assert hashing.lowered(np.arange(256, dtype=np.uint8)).tobytes() == bytes(range(256)).lower()


def test_op1_model_sums_to_one(spark, docs):
    model = quality.fit(quality.count_grams(docs)).toPandas()
    rows = [model[c].to_numpy() for c in ("kind", "order", "key", "value")]
    own = quality.Lookup(*rows)
    for context in (b"\0\0\0\0", b"alph", b"zzzz", b"ta a"):
        head = int.from_bytes(context, "big") << 8
        p = np.exp(quality.log_probabilities(own, own, np.arange(256, dtype=np.uint64) + np.uint64(head)))
        assert p.sum() == pytest.approx(1, abs=1e-9)


def test_op1_separates_and_keeps(spark, empty):
    rng = random.Random(6)
    words = ["stone", "river", "light", "window", "garden", "morning", "letter", "winter"]
    good = [(i, " ".join(rng.choice(words) for _ in range(60)), "en") for i in range(160)]
    bad = [(200 + i, "".join(rng.choice("#$%&@!?*xQZ") for _ in range(300)), "en") for i in range(10)]
    own = [*good, *bad, (300, None, "en"), (301, "", None), (302, good[3][1], None), (302, good[3][1], None)]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string").withColumn("batch", F.lit(1)).withColumn("quality", F.lit(5))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(160)] + [(200, 0, 0), (201, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = defaultdict(list)
    for r in quality.classify(docs, labels, quantile=1.0).collect():
        got[r.doc_id].append(r)
    assert all(got[i][0].kept for i, _, _ in good if got[i][0].perplexity <= got[i][0].threshold) and sum(got[i][0].kept for i, _, _ in good) >= 155
    assert not any(got[i][0].kept for i, _, _ in bad)
    assert got[300][0].perplexity is None and not got[300][0].kept and not got[301][0].kept
    assert len(got[302]) == 2 and all(r.kept for r in got[302])
    kept = {r.doc_id for r in quality.accepted(docs, labels, quantile=1.0).collect()}
    assert kept.isdisjoint(range(200, 210)) and 302 in kept
    assert all(r.kept for r in quality.classify(docs.where("doc_id < 160"), labels.limit(0)).collect())
    assert quality.classify(empty.withColumn("lang", F.lit("en")), labels).count() == 0


def test_op1_defaults_on_toxic_junk_and_clean_rows(spark):
    """A few insults in normal prose are rejected, as is junk, and clean rows stay."""
    rng = random.Random(9)
    parts = ["ther", "on", "ing", "ed", "re", "st", "ha", "in", "ou", "tion"]
    say = lambda: ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(250)]
    own = [(i, " ".join(say())) for i in range(400)]
    for i in range(400, 420):
        w = say()
        for insult in ("moron", "pathetic"):
            w[rng.randrange(250)] = insult
        own.append((i, " ".join(w)))
    own += [(i, " ".join(f"{w}{rng.choice('$%&*') * 3}" for w in say())) for i in range(420, 440)]
    own = [(i, t + (" 4111 2222 a.b@c.org" if i % 3 == 0 else "")) for i, t in own]
    docs = spark.createDataFrame(own, "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    assert kept.isdisjoint(range(400, 440))
    assert len(kept) >= 388


@pytest.mark.parametrize("last", [100_000, 12, 0])
def test_components(spark, monkeypatch, last):
    """All links in one task; rounds until few are left; rounds to the end."""
    monkeypatch.setattr(components, "LAST", last)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (100, 98), (7, 7)], "a long, b long")
    assert {r.id: r.component for r in components.components(links).collect()} == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}
    assert components.components(links.limit(0)).count() == 0


def test_helpers(spark):
    ids = spark.range(0, 50, 7).toDF("x")
    shared = bloom.build(ids.select(F.xxhash64("x")))
    have = np.array([r[0] for r in ids.select(F.xxhash64("x")).collect()])
    assert len(bloom.passing(shared, have.view(np.uint64))) == len(have)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    assert sorted(r.text for r in filtering.without(docs, spark.createDataFrame([(2,), (None,)], "g long")).collect()) == ["a", "c"]
    assert sorted(r.text for r in filtering.only(docs, spark.createDataFrame([(2,), (2,), (None,)], "g long")).collect()) == ["b"]
    packed = exchange.pack(documents(spark), batch_bytes=100).collect()
    assert len({r.batch for r in packed}) == len(packed) and sum(exchange.unpack(r.body).num_rows for r in packed) == len(texts())


@pytest.mark.parametrize("name", ["op2_embedding_dedup", "op4_substring_dedup", "op6_suffix_dedup", "op9_jaccard_join"])
def test_queries_give_the_rows_of_their_sql(spark, data, name):
    import duckdb

    from tidemark.llm import queries

    c = duckdb.connect()
    for table in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    got = queries.QUERIES[name](spark, data)
    want = c.sql(queries.ORACLE[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_pipeline(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data).toPandas()
        seen.append((name, len(docs.columns), out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert list(out.columns) == docs.columns
            docs = spark.createDataFrame(out, docs.schema)
    kept = [set(o["doc_id"]) for _, _, o in seen]
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False)) and kept[3] == kept[4]
    bench = spark.read.parquet(f"{data}/benchmark.parquet").toPandas()
    assert not any(t in x for t in bench["text"] for x in seen[3][2]["text"])
    want = jaccard_brute(list(zip(seen[1][2]["doc_id"], seen[1][2]["text"], strict=True)))
    assert kept[2] == {i for i, (_, c) in want.items() if c == i}
    assert {r.doc_id for r in corpus_pipeline.run(spark, data).select("doc_id").collect()} == kept[4]


def test_pipeline_stages_on_odd_rows(spark, data):
    """Null, empty and repeated rows, rows without an id, an empty table, and the caller's columns under the operators' own names."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    some = docs.orderBy("doc_id").limit(40)
    odd = some.unionByName(some.limit(3)).unionByName(some.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for k, text in enumerate([None, "", " \n\t", "w " * 20_000 + "x" * 300_000]):
        odd = odd.unionByName(some.limit(1).withColumn("doc_id", F.lit(10**9 + k).cast("long")).withColumn("text", F.lit(text).cast("string")))
    names = [*CLASHES, "n_lines", "n_removed", "kept_sha256", "chosen", "least", "lang_known"]
    for c in names:
        odd = odd.withColumn(c, F.lit(f"mine {c}"))
    odd = spark.createDataFrame(odd.collect(), odd.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, data)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in odd.schema]
        rows = out.collect()
        assert rows and all(r[c] == f"mine {c}" for r in rows for c in names)
        assert stage(spark, odd.limit(0), data).count() == 0


def test_sketches_are_as_long_as_their_sets_need():
    """Two bits a shingle at least, a fraction of a set's bytes; the distance of sketches of any two lengths never exceeds that of the sets."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 1 << 54, n, dtype=np.uint64)) for n in (1, 5, 40, 300, 500, 520, 9000)]
    rows += [np.unique(np.r_[x[len(x) // 9 :], rng.integers(0, 1 << 54, 7, dtype=np.uint64)]) for x in rows]
    n = np.array([len(x) for x in rows])
    got = jaccard_join.sketches(np.concatenate(rows), n)
    assert [len(x) for x in got] == [min(512, max(8, (1 << int(2 * m - 1).bit_length()) // 8)) for m in n.tolist()]
    a, b = np.triu_indices(len(rows))
    far = jaccard_join.apart([got[i] for i in a], [got[i] for i in b])
    assert all(x <= len(np.setxor1d(rows[i], rows[j])) for x, i, j in zip(far, a, b, strict=True)) and not far[a == b].any()


@pytest.mark.parametrize("bits", [32, 3])
def test_rarest_shingles_meet_without_their_sets(spark, tmp_path, monkeypatch, bits):
    """Texts are packed as they are in files, only nodes meet, and shingles that agree in the bits that are sent lose no pair."""
    monkeypatch.setattr(rarest, "KEY_BITS", bits)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: 50 + i % 3], *(f"x{i}{j}" for j in range(i % 4))])) for i in range(24)]
    spark.createDataFrame([*rows, rows[5]], "id long, text string").write.parquet(f"{tmp_path}/texts")
    nodes = spark.createDataFrame([(i, i % 5) for i in range(20)], "id long, component long")
    got = rarest.across(spark.read.parquet(f"{tmp_path}/texts"), nodes, "text", lambda t: jaccard_join._hashes(t, 5)).collect()
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    alike = {(a, b) for a in range(20) for b in range(a + 1, 20) if a % 5 != b % 5 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    found = {(r.a, r.b) for r in got}
    assert alike and alike <= found and all(a < b < 20 and a % 5 != b % 5 for a, b in found)


def test_jaccard_rows_of_one_document_in_and_beside_hot_parts(spark, monkeypatch):
    """A document with a row in hot parts, whose text is stored at once, is still compared by its other row."""
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    common, own = " ".join(f"c{i}" for i in range(80)), " ".join(f"o{i}" for i in range(80))
    rows = [*((i, f"{common} {i}") for i in range(1, 9)), (5, own), (20, f"{own} more"), (30, "nothing like these at all here")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.similar_documents(documents(spark, rows)).collect()}
    assert {k[0]: v for k, v in got.items()} == {**dict.fromkeys([*range(1, 9), 20], 1), 30: 30}


def test_tables_of_powers_are_kept_once():
    """A table for each base, whatever lengths are asked for: a worker's memory doesn't hold shorter ones beside it."""
    for base in (3, 5):
        for n in (1, 70_000, 10, 300_000, 140_000):
            assert hashing.powers(base, n).tolist()[-1] == pow(base, n - 1, 1 << 64) and len(hashing.powers(base, n)) == n
    held = [len(hashing._POWERS[base]) for base in (3, 5)]
    assert held == [1 << 19] * 2


def test_grams_of_a_batch_are_held_piece_by_piece(spark, monkeypatch):
    """Pieces of any size give the same scores, and no piece holds more than it may."""
    rows = [(i, None if i == 3 else "" if i == 4 else f"word{i} and some {i * 7919} text. " * (i % 9)) for i in range(40)]
    table = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    want = hashing.distinct(quality.grams(table)[0])
    for size in (64, 1 << 18):
        monkeypatch.setattr(quality, "HELD_BYTES", size)
        assert (quality._distinct_grams(table) == want).all()
        assert all(t.num_rows == 1 or t.column("text").combine_chunks().nbytes < 64 + 16 * t.num_rows for t in quality._pieces(table)) or size > 64


def test_bodies_are_small_and_keep_their_arrays():
    """Most requests are of a few keys: a body costs little beside them, and empty arrays and odd lengths come back."""
    arrays = [np.arange(3, dtype=np.uint8), np.zeros(0, np.int64), np.array([1.5, -2]), np.array([True, False, True]), np.arange(5, dtype=np.uint32)]
    body = exchange.dump(*arrays)
    assert len(body) < 120 and exchange.load(exchange.dump()) == []
    for got, want in zip(exchange.load(body, *(a.dtype for a in arrays)), arrays, strict=True):
        assert got.dtype == want.dtype and got.tolist() == want.tolist()
    assert len(exchange.load(body, np.uint8, np.int64)) == 2


def test_ranges_are_hashed_part_by_part(monkeypatch):
    """Hashes don't depend on the parts, and tables of powers are no longer than a part with its longest range."""
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 300_000).astype(np.uint8)
    start = np.sort(rng.integers(0, 290_000, 5000))
    end = start + rng.integers(0, 9000, 5000)
    for lane in (0, 1):
        want = hashing.hash_of(hashing.prefix_hashes(buf, lane), start, end, lane)
        monkeypatch.setattr(hashing, "_POWERS", {})
        monkeypatch.setattr(hashing, "HELD", 50_000)
        assert (hashing.range_hash(buf, start, end, lane) == want).all()
        assert max(map(len, hashing._POWERS.values())) == 1 << 16
        back = np.arange(5000)[::-1]
        assert (hashing.range_hash(buf, start[back], end[back], lane) == want[back]).all()
    assert len(hashing.range_hash(buf, start[:0], end[:0])) == 0
