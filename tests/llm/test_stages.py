"""Quality classifier, decontamination and every stage of the pipeline against plain loops that share no code with them."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import documents, jaccard_brute, lines_brute, lower, texts
from tidemark.llm import decontamination, quality
from tidemark.llm.queries import tokenizer

ORDER = 5
PAD = b"\0" * (ORDER - 1)


class KneserNey:
    """Interpolated modified Kneser-Ney over bytes, from its definition."""

    def __init__(self, train):
        self.counts = {ORDER: Counter(s[p : p + ORDER] for s in (PAD + t for t in train) for p in range(len(s) - ORDER + 1))}
        for n in range(ORDER - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.off, self.total, self.left, self.known = {}, defaultdict(int), defaultdict(float), {}
        for n, counts in self.counts.items():
            t = Counter(counts.values())
            y = t[1] / (t[1] + 2 * t[2]) if t[1] and t[2] else 0.5
            fit = lambda i: min(max(i - (i + 1) * y * t[i + 1] / t[i], 0.05), i - 0.05) if t[i] and t[i + 1] else min(0.5 * i, 0.9)  # noqa: E731, B023
            self.off[n] = [fit(1), fit(2), fit(3)]
            for g, c in counts.items():
                self.total[n, g[:-1]] += c
                self.left[n, g[:-1]] += self.off[n][min(c, 3) - 1]

    def p(self, gram):
        if not gram:
            return 1 / 256
        if gram not in self.known:
            n, c = len(gram), self.counts[len(gram)][gram]
            below, at = self.p(gram[1:]), (n, gram[:-1])
            if at in self.total:
                below = (c - self.off[n][min(c, 3) - 1] if c else 0) / self.total[at] + self.left[at] / self.total[at] * below
            self.known[gram] = below
        return self.known[gram]

    def surprisal(self, text):
        s = PAD + text
        return [-math.log(self.p(s[p : p + ORDER])) for p in range(len(text))]


def strangest(text, surprisal):
    worst = 0.0
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", text):
        letters = len(re.findall(rb"[A-Za-z\x80-\xff]", m[0]))
        if letters >= 3 and len(m[0]) - letters <= 1:
            s = surprisal[m.start() : m.end() + 1]
            worst = max(worst, sum(s) / len(s))
    return worst


def quantile(values, q):
    return sorted(values)[max(math.ceil(q * len(values)), 1) - 1] if values else None


def quality_brute(spark, own, labels, q, most):
    """(perplexity, threshold, strangest word, its threshold, kept) of each row (doc_id, text, lang)."""
    good = defaultdict(lambda: True)
    for i, quality_, toxic in labels:
        good[i] &= quality_ == 1 and toxic == 0
    ids = spark.createDataFrame([(i,) for i in good], "i long")
    hashed = {r.i: (r.half, r.place) for r in ids.select("i", F.pmod(F.xxhash64("i"), F.lit(2)).alias("half"), F.xxhash64("i", F.lit(1)).alias("place")).collect()}
    sample = set(sorted((i for i in good if good[i] and hashed[i][0] == 0), key=lambda i: (hashed[i][1], i))[:most])
    model = KneserNey([(t or "").encode() for i, t, _ in own if i in sample])
    scores, held = [], defaultdict(list)
    for i, t, lang in own:
        raw = (t or "").encode()
        s = model.surprisal(raw)
        scores.append((math.exp(sum(s) / len(s)), strangest(raw, s)) if s else (None, 0.0))
        if s and good.get(i) and hashed[i][0] == 1:
            held[lang].append(scores[-1])
    every, out = [x for h in held.values() for x in h], []
    for (_, _, lang), (perplexity, worst) in zip(own, scores, strict=True):
        a, b = (quantile([x[k] for x in held.get(lang) or every], q) for k in (0, 1))
        kept = perplexity is not None and (a is None or (perplexity <= a * (1 + 1e-6) and worst <= b * (1 + 1e-6)))
        out.append((perplexity, a, worst, b, kept))
    return out


def close(x):
    return x if x is None else pytest.approx(x, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("q,most", [(0.9, 10_000), (0.7, 9)])
def test_op1_every_figure_against_brute_force(spark, q, most):
    """Also where the sample is smaller than the trusted documents; languages with, without and of null name."""
    rng = random.Random(21)
    words = ["stone", "riverß", "light,", "window", "gar-den", "morning", "letter42", "x", "éé", "winter"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    own = [(i, say(rng.randrange(5, 40)) + rng.choice(["", " zebra", "\nqux!"]), ["en", "de", None][i % 3]) for i in range(90)]
    own += [(100, None, "en"), (101, "", "de"), (102, "x\x00y zz", "fr"), (103, " \n", "en"), (104, "w" * 30_000, "fr")]
    own += [(200 + i, t, "fr") for i, t in enumerate(texts())]
    labels = [(i, 1, 0) for i in range(75)] + [(3, 0, 0), (4, 1, 1), (100, 1, 0), (101, 1, 0)]
    want = quality_brute(spark, own, labels, q, most)
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string").repartition(3)
    for c in ("batch", "shard", "own", "own_word", "overall", "threshold", "kept", "good", "half"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = {r.doc_id: r for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), q, most).collect()}
    for (i, t, _), (perplexity, threshold, worst, word, kept) in zip(own, want, strict=True):
        r = got[i]
        assert (r.n_symbols, r.perplexity, r.threshold) == (len((t or "").encode()), close(perplexity), close(threshold))
        assert (r.strangest_word, r.word_threshold) == (close(worst), close(word))
        assert r.kept == kept
    assert 0 < sum(w[-1] for w in want) < len(want)


def tiles_brute(doc, item, k):
    """Lengths of the tiles: the longest common run of words that neither side has marked, again and again."""
    in_doc, in_item, out = [False] * len(doc), [False] * len(item), []
    while True:
        best, ends = (k - 1, 0, 0), {}
        for j in range(len(item)):
            now = {}
            for i in range(len(doc)):
                if doc[i] == item[j] and not in_doc[i] and not in_item[j]:
                    n = now[i] = ends.get(i - 1, 0) + 1
                    begin = (n, j - n + 1, i - n + 1)
                    if n > best[0] or (n == best[0] and n >= k and begin[1:] < best[1:]):
                        best = begin
            ends = now
        n, j, i = best
        if n < k:
            return out
        in_item[j : j + n] = [True] * n
        in_doc[i : i + n] = [True] * n
        out.append(n)


def contamination_brute(own, items, k=5, coverage=0.5):
    """{(doc_id, item_id): (item words, covered words, tiles)} over every pair of rows."""
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", lower(t).encode())
    runs = lambda w: {tuple(w[p : p + k]) for p in range(len(w) - k + 1)}
    found = defaultdict(list)
    items = [(i, w, runs(w)) for i, w in ((i, split(t)) for i, t in items)]
    for d, t in own:
        doc = split(t)
        have = runs(doc)
        for i, item, need in items:
            if have & need:  # no tile without
                n = tiles_brute(doc, item, k)
                if n and sum(n) / len(item) >= coverage:
                    found[d, i].append((sum(n), -len(n), len(item)))
    return {key: (w, c, -t) for key, (c, t, w) in ((key, max(rows)) for key, rows in found.items())}


@pytest.mark.parametrize("k,coverage", [(5, 0.5), (3, 0.34), (5, 1.0), (4, 0.0)])
def test_op3_every_pair_against_brute_force(spark, k, coverage):
    """With a phrase that most documents and items hold, words that repeat, reordered passages and items under one id."""
    rng = random.Random(31)
    say = lambda n, kinds: [f"v{rng.randrange(kinds)}" for _ in range(n)]
    common = say(9, 500)
    items = []
    for i in range(30):
        w = say(rng.randrange(4, 30), 3 if i % 7 == 0 else 500)
        at = rng.randrange(len(w))
        items.append((i, " ".join(w[:at] + common + w[at:] if i % 2 else w)))
    items += [(3, items[5][1] + " and more"), (None, items[8][1]), (90, None), (91, ""), (92, " ".join(common)), (93, items[2][1])]
    own = []
    for i in range(120):
        w = say(rng.randrange(30), 3 if i % 9 == 0 else 500) + (common if i % 3 else [])
        parts = rng.choice(items)[1]
        parts = (parts or "").split()
        cut = rng.randrange(1 + len(parts))
        own.append((i % 110, " ".join(w + parts[cut:] + ["Between,"] + parts[: max(cut - rng.randrange(6), 0)]).replace("v1 ", "V1; ")))
    own += [(500, None), (501, ""), (502, " ".join(common)), (None, items[1][1])]
    want = contamination_brute(own, items, k, coverage)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for c in ("seed", "item", "windows", "need", "row", "docs"):
        bench = bench.withColumn(c, F.lit("clash"))
    rows = decontamination.contaminated(documents(spark, own), bench, k, coverage).collect()
    assert {(r.doc_id, r.item_id): (r.item_words, r.covered_words, r.n_tiles) for r in rows} == want
    assert len(rows) == len(want) > 20


def test_op3_common_seeds_join_nothing(spark):
    """A phrase that every document holds makes no pair with an item that needs more than the phrase."""
    own = [(i, f"one two three four five six d{i}") for i in range(50)]
    seeds = spark.createDataFrame([(0, h, 1, 3) for h in range(20)], "item long, seed long, windows long, need long")
    asked = spark.createDataFrame([(i, h) for i in range(50) for h in (0, 1)] + [(7, h) for h in range(2, 9)], "row long, seed long")
    left = {r.seed for r in decontamination.rare(seeds, asked).collect()}
    assert left == set(range(2, 9))  # a pair that holds three windows holds another one than 0 and 1
    items = spark.createDataFrame([(0, "one two three four five six " + " ".join(f"t{i}" for i in range(12)))], "item_id long, text string")
    assert decontamination.contaminated(documents(spark, own), items).count() == 0


def test_least_windows():
    """No choice of tiles that reaches the coverage has fewer windows, and one window is always asked for."""
    for words in range(1, 40):
        for k in (1, 3, 5):
            for coverage in (0.1, 0.3, 0.5, 2 / 3, 1.0):
                counts = [c - t * (k - 1) for c in range(1, words + 1) for t in range(1, c // k + 1) if c / words >= coverage]
                assert 1 <= decontamination.least_windows(words, k, coverage) <= min(counts, default=words)


def test_pipeline_stages_against_brute_force(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages, outs = dict(corpus_pipeline.STAGES), []
    for stage in stages.values():
        out = stage(spark, docs, data)
        rows = out.collect()
        outs.append(rows)
        docs = spark.createDataFrame(rows, out.schema)
    before = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want = [(i, t) for (i, t, _), w in zip(before, quality_brute(spark, before, labels, 0.995, 10_000), strict=True) if w[-1]]
    pairs = lambda rows: sorted((r.doc_id, r.text) for r in rows)
    assert 0 < len(want) < len(before) and pairs(outs[0]) == sorted(want)
    want = [(i, t) for i, t, _, _ in lines_brute(want)]
    assert pairs(outs[1]) == sorted(want)
    classes = jaccard_brute(want)
    want = [(i, t) for i, t in want if classes[i][1] == i]
    assert pairs(outs[2]) == sorted(want)
    bench = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, _ in contamination_brute(want, bench)}
    want = [(i, t) for i, t in want if i not in leaks]
    assert pairs(outs[3]) == sorted(want)
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    got = {r.doc_id: r for r in outs[4]}
    assert sorted(got) == sorted(i for i, _ in want)
    for i, text in want:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids
