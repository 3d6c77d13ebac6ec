"""Benchmark decontamination by greedy string tiling.

1. Seeds: every window of ``min_match`` words of the test items. A Bloom filter of
   fixed size (1 MB), built by a distributed aggregation, lets a scan of the
   documents drop windows that no item has. As the benchmark grows the filter only
   passes more; the join decides.
2. Windows that pass are joined with the seeds: pairs of a document and an item
   that share tokens. Tiles that cover c words of an item hold at least c / min_match of
   its windows, so the seeds that most documents hold are left out as long as
   fewer windows of the item than that go with them: every pair that can count still has a
   rarer seed in common, and a phrase that a third of the corpus holds joins nothing.
3. For each pair, greedy string tiling: all longest common runs are found from
   running Karp-Rabin hashes of the windows; the longest is marked first, then the
   longest that is left unmarked on both sides, down to ``min_match`` words. Marked
   runs never overlap, and their order doesn't matter, so reordered passages count.
4. A pair counts when the marked share of the item's words reaches ``coverage``.

Words are runs of ASCII letters, digits and any byte of a non-ASCII character,
with A-Z lower-cased. Defined results: null or empty texts and items with fewer
words than ``min_match`` give no pair; rows with equal doc_id are tested each and
their pairs reported once, the best one; items with equal item_id likewise; a null doc_id
or item_id is kept as null; an empty table gives no pair; texts of any length are read whole,
a pair within one task; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm import hashing as H
from tidemark.llm.filtering import without
from tidemark.llm.storage import checkpoint

IS_GAP = np.ones(256, dtype=bool)
IS_GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def _windows(texts, k: int):
    """Per window: row and hash; and the hashes of the words with their rows."""
    buf, offsets = H.flat(texts, lower=True)
    start, end, row = H.word_spans(buf, offsets, IS_GAP)
    words = H.range_hash(buf, start, end)
    at, h = H.windows(words, row, k)
    return row[at] if len(at) else at, h, words, row


def tiles(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (document position, item position, length) of each tile."""
    zero = np.zeros(len(doc), np.int64)
    _, hd = H.windows(doc, zero, k)
    _, hi = H.windows(item, np.zeros(len(item), np.int64), k)
    order = np.argsort(hi, kind="stable")
    low, high = np.searchsorted(hi[order], hd, "left"), np.searchsorted(hi[order], hd, "right")
    hit = np.flatnonzero(high > low)
    p = np.repeat(hit, (high - low)[hit])
    t = np.concatenate([order[low[i] : high[i]] for i in hit]) if len(hit) else np.zeros(0, np.int64)
    # windows that follow each other on a diagonal are one longest common run
    by = np.lexsort((p, p - t))
    p, t = p[by], t[by]
    begins = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(t) != 1)]) if len(p) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[begins, len(p)]) + k - 1
    heap = [(-int(n), int(t[b]), int(p[b])) for b, n in zip(begins, lengths, strict=True)]
    heapq.heapify(heap)
    in_doc, in_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while heap:
        n, ti, pi = heapq.heappop(heap)
        n = -n
        free = ~(in_doc[pi : pi + n] | in_item[ti : ti + n])
        if free.all():
            in_doc[pi : pi + n] = True
            in_item[ti : ti + n] = True
            out.append((pi, ti, n))
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8))).reshape(-1, 2)
        for a, b in edge.tolist():
            if b - a >= k:
                heapq.heappush(heap, (a - b, ti + a, pi + a))
    return out


def least_windows(words: int, k: int, coverage: float) -> int:
    """Tiles that cover that share of an item's words hold at least so many of its windows of k words: c words in tiles of k or more are c / k windows or more."""
    covered = next(c for c in range(max(math.floor(coverage * words) - 1, 0), math.ceil(coverage * words) + 2) if words == 0 or c / words >= coverage)
    return max(1, -(-covered // k))


def rare(seeds: DataFrame, asked: DataFrame) -> DataFrame:
    """(item, seed): the seeds of each item without those that most documents hold, as long as the windows that go with them are fewer than needed."""
    frequency = asked.groupBy("seed").agg(F.count("*").alias("docs"))
    commonest = Window.partitionBy("item").orderBy(F.desc("docs"), "seed").rowsBetween(Window.unboundedPreceding, 0)
    return seeds.join(frequency, "seed").withColumn("so_far", F.sum("windows").over(commonest)).where("so_far >= need").select("item", "seed")


def contaminated(docs: DataFrame, items: DataFrame, min_match: int = 5, coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, n_tiles, coverage) of each pair that reaches the coverage."""
    k = min_match
    items = checkpoint(items.select("item_id", F.col("text").cast("string").alias("item_text"), F.monotonically_increasing_id().alias("item")))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, h, _, of = _windows(b.column(1), k)
            words = np.bincount(of, minlength=b.num_rows)
            need = np.array([least_windows(int(n), k, coverage) for n in words], np.int64)
            by = np.lexsort((h, row))
            row, h = row[by], h[by]
            first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
            columns = [b.column(0).take(pa.array(row[first])), pa.array(h[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(h)])), pa.array(need[row[first]])]
            yield pa.RecordBatch.from_arrays(columns, ["item", "seed", "windows", "need"])

    item_type = items.schema["item_id"].dataType.simpleString()
    seeds = checkpoint(items.select("item", "item_text").mapInArrow(seed, "item long, seed long, windows long, need long"))

    shared = bloom.build(seeds.select("seed").distinct())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                b = whole.slice(begin, 500)
                row, h, _, _ = _windows(b.column(1), k)
                at = bloom.passing(shared, h)
                if len(at):
                    rows = np.unique(row[at])
                    per = [np.unique(h[at][row[at] == r]).view(np.int64) for r in rows]
                    kept = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(per, pa.list_(pa.int64()))], ["doc_id", "text", "seeds"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    hits = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {doc_type}, text string, seeds array<long>")
    hits = checkpoint(hits.withColumn("row", F.monotonically_increasing_id()))
    asked = hits.select("row", F.explode("seeds").alias("seed"))
    pairs = asked.join(rare(seeds, asked), "seed").select("row", "item").distinct()
    pairs = pairs.join(hits.select("row", "doc_id", "text"), "row").join(items, "item").select("doc_id", "item_id", "text", "item_text")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, (text, item) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                _, _, words, row = _windows(pa.array([text.as_py(), item.as_py()], pa.large_string()), k)
                found = tiles(words[row == 0], words[row == 1], k)
                at.append(i)
                out.append((int((row == 1).sum()), sum(n for _, _, n in found), len(found)))
            columns = [pa.array([o[j] for o in out], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "item_id", "item_words", "covered_words", "n_tiles"])

    found = pairs.mapInArrow(tile, f"doc_id {doc_type}, item_id {item_type}, item_words long, covered_words long, n_tiles long")
    found = found.withColumn("coverage", F.col("covered_words") / F.col("item_words")).where(F.col("coverage") >= coverage)
    best = F.max_by(F.struct("item_words", "covered_words", "n_tiles", "coverage"), F.struct("covered_words", -F.col("n_tiles")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, items: DataFrame, min_match: int = 5, coverage: float = 0.5) -> DataFrame:
    """docs without those that hold a test item; a document with a null doc_id stays."""
    return without(docs, contaminated(docs, items, min_match, coverage).select("doc_id"))
