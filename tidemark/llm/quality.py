"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are the bytes of the text, so an n-gram of order 5 is a number of 40 bits and
no vocabulary is needed; four zero bytes stand before a text. The model is fitted
on a bounded, documented sample of trusted documents (``max_train_docs``, those with
the smallest hash of their key among half of the trusted ones); the thresholds are
quantiles over *all* trusted documents of the other half, by language. Every document is scored over its whole text.

A document is rejected when its perplexity or its strangest word is above the threshold. A few
insults in otherwise normal prose hardly move the mean; they stand out as words. The
strangest word is the highest mean surprisal (nats a byte, with the byte that follows) of a word of
``WORD_LETTERS`` letters or more and one other sign at most, so numbers, addresses and markup don't count.

Counts are sharded by the two bytes before the predicted one, so all orders of an
n-gram down to the trigram meet in one shard. A batch asks about its distinct
n-grams and gets their log-probabilities. The tables of the two lowest orders have a fixed
bound (256 + 65,536 entries) and go to every shard.

Defined results: a text without such a word has strangest word 0; a null or empty text has no symbols, perplexity null and is kept
False; a language (also null) without trusted documents takes the threshold
over all languages; without any trusted document nothing is rejected; rows with
equal doc_id are scored each; a document is trusted when a label says so and none
says otherwise; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as X
from tidemark.llm import hashing as H
from tidemark.llm.filtering import without
from tidemark.llm.storage import checkpoint

ORDER = 5
#: Bytes of letters that a word needs to count for the strangest word; a byte of a non-ASCII character is one.
WORD_LETTERS = 3
#: Bytes of text whose n-grams are held at a time; several arrays of 8 bytes go with each.
HELD_BYTES = 1 << 18


def grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each byte, and its document row."""
    buf, offsets = H.flat(table.column("text"))
    n = len(buf)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    depth = np.arange(n) - offsets[:-1][row] if n else np.zeros(0, np.int64)
    out = buf.astype(np.uint64)
    for j in range(1, ORDER):
        before = np.zeros(n, np.uint64)
        before[j:] = buf[:-j] if n > j else 0
        before[depth < j] = 0
        out |= before << np.uint64(8 * j)
    return out, row


def _pieces(table: pa.Table) -> Iterator[pa.Table]:
    """The rows of a batch, HELD_BYTES of text or one row at a time."""
    for b in X.slices(table.select(["doc_id", "text"]).to_batches(), HELD_BYTES):
        yield pa.Table.from_batches([b])


def _distinct_grams(table: pa.Table) -> np.ndarray:
    return H.distinct(np.concatenate([np.zeros(0, np.uint64), *(H.distinct(grams(t)[0]) for t in _pieces(table))]))


def _shard(gram: np.ndarray, n_shards: int) -> np.ndarray:
    return (H.mix((gram >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(n_shards)).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n): how often each 5-gram occurs in the texts."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                g, n = np.unique(grams(pa.Table.from_batches([whole.slice(at, 200)]))[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(g.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame) -> DataFrame:
    """The model as rows (kind, order, key, value): 'p' the probability of an n-gram's last symbol, 'back' the weight that a context leaves to lower orders."""
    orders = {ORDER: checkpoint(counts)}
    for n in range(ORDER - 1, 0, -1):  # lower orders count the different symbols that stand before
        mask = (1 << (8 * n)) - 1
        orders[n] = checkpoint(orders[n + 1].groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count("*").alias("n")))
    model, lower = [], None
    for n in range(1, ORDER + 1):
        grams_n = orders[n]
        t = grams_n.agg(*[F.count_if(F.col("n") == i).alias(f"t{i}") for i in range(1, 5)]).first()
        y = t.t1 / (t.t1 + 2 * t.t2) if t.t1 and t.t2 else 0.5
        d = [0.0, *(min(max(i - (i + 1) * y * t[i] / t[i - 1], 0.05), i - 0.05) if t[i - 1] and t[i] else min(0.5 * i, 0.9) for i in (1, 2, 3))]
        context = F.shiftright("gram", 8)
        off = F.when(F.col("n") == 1, d[1]).when(F.col("n") == 2, d[2]).otherwise(d[3])
        sums = grams_n.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("left"))
        seen = grams_n.select("gram", context.alias("context"), "n", off.alias("off")).join(sums, "context")
        if lower is None:
            below = F.lit(1 / 256)
        else:
            seen = seen.withColumn("suffix", F.col("gram").bitwiseAND((1 << (8 * (n - 1))) - 1)).join(lower, "suffix")
            below = F.col("below")
        lower = checkpoint(seen.select(F.col("gram").alias("suffix"), ((F.col("n") - F.col("off")) / F.col("total") + F.col("left") / F.col("total") * below).alias("below")))
        model.append(lower.select(F.lit("p").alias("kind"), F.lit(n).alias("order"), F.col("suffix").alias("key"), F.col("below").alias("value")))
        model.append(sums.select(F.lit("back").alias("kind"), F.lit(n).alias("order"), F.col("context").alias("key"), (F.col("left") / F.col("total")).alias("value")))
    out = model[0]
    for m in model[1:]:
        out = out.unionByName(m)
    return checkpoint(out)


class Lookup:
    """Sorted model rows, looked up by n-gram."""

    def __init__(self, kind, order, key, value):
        self.tables = {}
        for k in ("p", "back"):
            for n in range(1, ORDER + 1):
                at = np.flatnonzero((kind == k) & (order == n))
                at = at[np.argsort(key[at])]
                self.tables[k, n] = key[at].astype(np.uint64), value[at]

    def get(self, kind: str, n: int, keys: np.ndarray, missing: float) -> np.ndarray:
        known, value = self.tables[kind, n]
        if not len(known):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, value[at], missing)


def log_probabilities(low: Lookup, own: Lookup, gram: np.ndarray) -> np.ndarray:
    p = np.full(len(gram), 1 / 256)
    for n in range(1, ORDER + 1):
        model = low if n <= 2 else own
        key = gram & np.uint64((1 << (8 * n)) - 1)
        back = model.get("back", n, key >> np.uint64(8), 1.0)
        known = model.get("p", n, key, -1.0)
        p = np.where(known >= 0, known, back * p)
    return np.log(p)


def strangest_words(table: pa.Table, surprisal: np.ndarray) -> np.ndarray:
    """For each document the highest mean surprisal of its words; surprisal is that of each byte."""
    buf, offsets = H.flat(table.column("text"))
    start, end, row = H.word_spans(buf, offsets)
    out = np.zeros(table.num_rows)
    letters = np.r_[0, np.cumsum((((buf | 32) >= 97) & ((buf | 32) <= 122)) | (buf >= 128))]
    n = letters[end] - letters[start]
    at = (n >= WORD_LETTERS) & (end - start - n <= 1)
    if not at.any():
        return out
    start, end, row = start[at], end[at], row[at]
    end = np.minimum(end + 1, offsets[1:][row])
    total = np.add.reduceat(np.r_[surprisal, 0.0], np.stack([start, end], axis=1).ravel())[::2]
    np.maximum.at(out, row, np.round(total / (end - start), 6))
    return out


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, strangest_word) of every document."""
    n_shards = X.shards(docs)
    packed = X.pack(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")))
    small = model.where("order <= 2").toPandas()  # 256 + 65,536 grams and 257 contexts at most
    low_rows = [small[c].to_numpy() for c in ("kind", "order", "key", "value")]

    def dealt(batches):
        for b in batches:
            key = b.column(2).to_numpy().astype(np.uint64)
            # a context is shifted as if a symbol followed
            gram = np.where(np.array(b.column(0).to_pylist()) == "back", key << np.uint64(8), key)
            yield pa.RecordBatch.from_arrays([pa.array(_shard(gram, n_shards).astype(np.int32)), *b.columns], ["shard", "kind", "order", "key", "value"])

    sharded = model.where("order > 2").mapInArrow(dealt, "shard int, kind string, order int, key long, value double")

    def ask(table: pa.Table):
        g = _distinct_grams(table)
        order, bounds = X.by_shard(_shard(g, n_shards), n_shards)
        for s in np.flatnonzero(np.diff(bounds)):
            yield int(s), X.dump(np.diff(g[order[bounds[s] : bounds[s + 1]]], prepend=np.uint64(0)))

    def answer(requests: pa.Table, rows: pa.Table) -> pa.Table:
        own = Lookup(np.array(rows.column("kind").to_pylist(), dtype=object), *(rows.column(c).to_numpy() for c in ("order", "key", "value")))
        low = Lookup(*low_rows)
        asked = [np.cumsum(X.load(b, np.uint64)[0], dtype=np.uint64) for b in requests.column("body").to_pylist()]
        got = []
        if asked:
            every, inverse = np.unique(np.concatenate(asked), return_inverse=True)
            logs = log_probabilities(low, own, every).astype(np.float32)[inverse]
            got = [X.dump(x) for x in np.split(logs, np.cumsum([len(a) for a in asked])[:-1])]
        return pa.Table.from_arrays([requests.column("batch"), requests.column("shard"), pa.array(got, pa.binary())], ["batch", "shard", "body"])

    replies = X.ask(packed, ask).groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(answer, X.REPLY)

    def settle(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        every = _distinct_grams(table)
        order, bounds = X.by_shard(_shard(every, n_shards), n_shards)
        logs = np.zeros(len(every))
        for s, body in replies.items():
            logs[order[bounds[s] : bounds[s + 1]]] = X.load(body, np.float32)[0]
        n, perplexity, strangest = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for t in _pieces(table):
            g, row = grams(t)
            own, inverse = np.unique(g, return_inverse=True)
            log = logs[np.searchsorted(every, own)][inverse]
            n.append(np.bincount(row, minlength=t.num_rows))
            perplexity.append(np.exp(-np.bincount(row, log, t.num_rows) / np.maximum(n[-1], 1)))
            strangest.append(strangest_words(t, -log))
        n = np.concatenate(n)
        return pa.Table.from_arrays([table.column("doc_id"), table.column("lang"), pa.array(n), pa.array(np.concatenate(perplexity), mask=n == 0), pa.array(np.concatenate(strangest))], ["doc_id", "lang", "n_symbols", "perplexity", "strangest_word"])

    return X.settle(packed, replies, settle, "doc_id long, lang string, n_symbols long, perplexity double, strangest_word double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, max_train_docs: int = 10_000) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, strangest_word, word_threshold, kept) of every document."""
    label = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    trusted = label.where("good").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"))
    sample = trusted.where("half = 0").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_train_docs).select("doc_id")
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id", "left_semi")  # max_train_docs keys
    scored = checkpoint(score(docs, fit(count_grams(train))))
    held_out = scored.join(trusted.where("half = 1").select("doc_id"), "doc_id", "left_semi").where("perplexity is not null")
    at = lambda c, name: F.percentile_approx(c, F.lit(quantile), F.lit(100_000)).alias(name)
    by_lang = held_out.groupBy("lang").agg(at("perplexity", "own"), at("strangest_word", "own_word"))
    overall = held_out.agg(at("perplexity", "overall"), at("strangest_word", "overall_word"))
    out = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["lang"]), "left").drop(by_lang["lang"]).join(F.broadcast(overall), F.lit(True), "left")  # one row
    threshold, word = F.coalesce("own", "overall"), F.coalesce("own_word", "overall_word")
    kept = F.col("perplexity").isNotNull() & (threshold.isNull() | ((F.col("perplexity") <= threshold) & (F.col("strangest_word") <= word)))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", threshold.alias("threshold"), "strangest_word", word.alias("word_threshold"), kept.alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, max_train_docs: int = 10_000) -> DataFrame:
    """docs without those that the classifier rejects; an empty text is rejected, a row with a null doc_id stays."""
    return without(docs, classify(docs, labels, quantile, max_train_docs).where("not kept").select("doc_id"))
