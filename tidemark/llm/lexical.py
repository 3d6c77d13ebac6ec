"""Ranked lexical search: the best documents of each query by term impacts, LEMP style.

A document is a sparse vector with an impact for each term, a query one with a weight for each
term; the score is their inner product in 64-bit integers. All queries are known beforehand,
so only terms that some query asks for become coordinates.

1. One pass over the documents tokenises whole texts and writes, per document, its number of terms
   and the counts of asked terms; their sums give the statistics N, L and df.
2. Vectors are ordered by length (Euclidean norm) over the whole corpus by a range partitioning and
   stored in that order, so that a task reads *buckets* of vectors of like length, longest first.
3. The longest sixteenth is searched first. The score of each query's last place is a threshold
   for the rest: vectors so short that the Cauchy-Schwarz inequality rules them out for every query
   aren't read at all (a filter on the stored length), those of the others are dropped bucket by
   bucket and query by query. Thresholds also rise within a task, bucket after bucket.
4. Inside a bucket, a query's ``FOCUS`` heaviest coordinates bound the score of each vector: their part exactly,
   the rest by Cauchy-Schwarz over what is left of both lengths.
5. What survives is scored exactly in integers. Bounds are doubles with a slack of 1e-9, far
   above their rounding errors, so no document that belongs to the result is lost.

Queries are dealt out to blocks with about ``BLOCK`` pairs of query and term, which is what is sent to
every task; a block costs a pass over the documents. No table is joined with another, nothing is
sent through the driver but a block's queries, the counts of its terms and its thresholds.

Terms are known by 64-bit hashes. Defined results: null and empty texts have no terms; rows with equal doc_id are
documents of their own, all of them ranked; a null doc_id comes after all others among equal scores; texts of rows
with equal item_id (null included) count as one query, a term once; items without terms, and an empty
table on either side, give no row; a text is read whole, however long; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import hashing as H
from tidemark.llm.decontamination import IS_GAP
from tidemark.llm.exchange import slices
from tidemark.llm.storage import checkpoint, scratch

#: Pairs of a query and a term in a block; vectors in a bucket; a query's coordinates that bound a vector.
BLOCK, BUCKET, FOCUS = 1 << 20, 4096, 6
#: Part of the vectors, longest first, whose scores give the first thresholds.
HEAD = 1 / 16
SLACK = 1e-9
LAST = np.iinfo(np.int64).max  # stands for a null doc_id


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each query, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, row = _terms(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item_id {kind}, term long").distinct()


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = H.flat(texts, lower=True)
    start, end, row = H.word_spans(buf, offsets, IS_GAP)
    return H.range_hash(buf, start, end), row


def count_asked(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with terms: how many it has, and how often each asked one occurs, by its place in asked."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for b in slices(batches):
            h, row = _terms(b.column(1))
            n = np.bincount(row, minlength=b.num_rows)
            at = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
            hit = asked[at] == h
            key, tf = np.unique(row[hit] * len(asked) + at[hit], return_counts=True)
            bounds = np.searchsorted(key, np.arange(b.num_rows + 1) * len(asked))
            whole = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), _lists(bounds, key % len(asked), pa.int32()), _lists(bounds, tf, pa.int64())], ["doc_id", "n", "terms", "tfs"])
            yield whole.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def _lists(bounds: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _ragged(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column of lists."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return bounds - bounds[0], column.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of each count in a document of n terms; the length's share in whole numbers of any size."""
    sizes, back = np.unique(n, return_inverse=True)
    m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in sizes], np.int64)[back]
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def impact_vectors(counts: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, norm, terms, impacts): vectors with a length, in order of it, longest first."""
    shared = counts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, terms = _ragged(b.column(2))
            _, tf = _ragged(b.column(3))
            row = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            p = impacts(tf, b.column(1).to_numpy()[row], n_docs, n_terms)
            norm = np.sqrt(np.bincount(row, weights=shared.value[terms] * p.astype(np.float64) ** 2, minlength=b.num_rows))
            whole = pa.RecordBatch.from_arrays([b.column(0), pa.array(norm), b.column(2), _lists(bounds, p, pa.int32())], ["doc_id", "norm", "terms", "impacts"])
            yield whole.filter(pa.array(norm > 0))

    vectors = counts.mapInArrow(run, "doc_id long, norm double, terms array<int>, impacts array<int>")
    return vectors.repartitionByRange(F.desc("norm"), "doc_id").sortWithinPartitions(F.desc("norm"), "doc_id")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of whole numbers in each range of bounds."""
    upto = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=upto[1:])
    return upto[bounds[1:]] - upto[bounds[:-1]]


class Queries:
    """A block's queries: terms by descending weight, their coordinates (roots of the weights) and lengths."""

    def __init__(self, ids: list, terms: list[np.ndarray], weights: np.ndarray, k: int):
        self.ids, self.weights, self.k = ids, weights, k
        self.terms = [t[np.argsort(-weights[t], kind="stable")] for t in terms]
        self.coordinates = [np.sqrt(weights[t]) for t in self.terms]
        self.norms = np.array([math.sqrt(float(weights[t].sum())) for t in terms])


class Bucket:
    """Vectors of like length, longest first, by row and by coordinate."""

    def __init__(self, b: pa.RecordBatch, weights: np.ndarray):
        ids = b.column(0)
        self.ids = ids.fill_null(LAST).to_numpy()
        self.norms = b.column(1).to_numpy()
        self.bounds, self.terms = _ragged(b.column(2))
        self.impacts = _ragged(b.column(3))[1].astype(np.int64)
        row = np.repeat(np.arange(len(self.norms)), np.diff(self.bounds))
        order = np.argsort(self.terms, kind="stable")
        self.row, self.by_term = row[order], self.terms[order]
        self.values = (np.sqrt(weights[self.terms]) * self.impacts)[order]

    def candidates(self, terms: np.ndarray, coordinates: np.ndarray, norm: float, threshold: float) -> np.ndarray:
        """Rows whose score may reach threshold: long enough, and by the bounds of the focus coordinates."""
        least = threshold * (1 - SLACK)
        k = int(np.searchsorted(-self.norms, -least / norm, side="right"))  # shorter ones are out by Cauchy-Schwarz
        if k == 0:
            return np.zeros(0, np.int64)
        known, squares = np.zeros(k), np.zeros(k)
        for t, q in zip(terms[:FOCUS], coordinates[:FOCUS], strict=True):
            a, z = np.searchsorted(self.by_term, [t, t + 1])
            z = a + int(np.searchsorted(self.row[a:z], k))
            known[self.row[a:z]] += q * self.values[a:z]
            squares[self.row[a:z]] += self.values[a:z] ** 2
        rest = math.sqrt(max(0.0, norm**2 - float((coordinates[:FOCUS] ** 2).sum())))
        # what rounding may leave out of a difference of squares is added back
        left = np.sqrt(np.maximum(self.norms[:k] ** 2 * (1 + SLACK) - squares, 0.0))
        return np.flatnonzero(known + (rest + SLACK * norm) * left >= least)

    def scores(self, rows: np.ndarray, weighed: np.ndarray) -> np.ndarray:
        """Exact scores of rows; weighed holds the query's weight of each term, 0 for terms that it hasn't."""
        size = self.bounds[rows + 1] - self.bounds[rows]
        bounds = np.r_[0, np.cumsum(size)]
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[rows] - bounds[:-1], size)
        return _sums(weighed[self.terms[at]] * self.impacts[at], bounds)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(vectors: DataFrame, shared, thresholds: dict[int, int]) -> DataFrame:
    """(query, doc_id, score): the k best of each query in each task that reach its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        none = np.zeros(0, np.int64)
        found = [(none, none) for _ in queries.ids]
        least = np.array([thresholds.get(i, 1) for i in range(len(queries.ids))], np.int64)
        weighed = np.zeros(len(queries.weights), np.int64)
        for whole in batches:
            for begin in range(0, whole.num_rows, BUCKET):
                bucket = Bucket(whole.slice(begin, BUCKET), queries.weights)
                reached = np.flatnonzero(queries.norms * bucket.norms[0] >= least * (1 - SLACK))  # by Cauchy-Schwarz
                for i in reached.tolist():
                    terms = queries.terms[i]
                    rows = bucket.candidates(terms, queries.coordinates[i], queries.norms[i], float(least[i]))
                    if not len(rows):
                        continue
                    weighed[terms] = queries.weights[terms]
                    scores = bucket.scores(rows, weighed)
                    weighed[terms] = 0
                    good = scores >= least[i]
                    ids, scores = _best(np.r_[found[i][0], bucket.ids[rows[good]]], np.r_[found[i][1], scores[good]], queries.k)
                    found[i] = ids, scores
                    if len(ids) == queries.k:
                        least[i] = max(least[i], scores[-1])
        at = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
        ids = np.concatenate([x for x, _ in found]) if found else none
        scores = np.concatenate([s for _, s in found]) if found else none
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(ids, pa.int64(), mask=ids == LAST), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    return vectors.mapInArrow(run, "query int, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: first in parts of it, then of what these leave."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    parts = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(16))).orderBy(*order))).where(F.col("rank") <= k)
    return parts.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, pairs: pa.Table, k: int) -> DataFrame:
    """(query, rank, doc_id, score), query being the place among the block's ids, which come with it."""
    spark = docs.sparkSession
    asked, term = np.unique(pairs.column("term").to_numpy().view(np.uint64), return_inverse=True)
    number = pairs.column("number").to_numpy()
    order = np.argsort(number, kind="stable")
    ids, begins = np.unique(number[order], return_index=True)
    terms = np.split(term[order], begins[1:])
    with scratch(spark) as stored:
        counts = stored(count_asked(docs, asked))
        totals = counts.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        n_docs, n_terms = totals["n"], totals["l"] or 0
        weights = np.zeros(len(asked), np.int64)
        for t, df in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a block's terms
            weights[t] = weight(n_docs, df)
        vectors = stored(impact_vectors(counts, weights, n_docs, max(n_terms, 1)))
        queries = Queries(ids.tolist(), terms, weights, k)
        shared = spark.sparkContext.broadcast(queries)
        cut = vectors.agg(F.percentile_approx("norm", 1 - HEAD, 1000)).first()[0]
        if cut is None:
            return checkpoint(spark.createDataFrame([], "number long, rank int, doc_id long, score long"))
        head = checkpoint(_ranked(search(vectors.where(F.col("norm") >= cut), shared, {}), k))
        thresholds = {r["query"]: r["least"] for r in head.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).collect()}
        shortest = [thresholds.get(i, 0) / n for i, n in enumerate(queries.norms.tolist()) if n > 0]
        reach = min(shortest, default=math.inf) * (1 - SLACK)  # Cauchy-Schwarz for all queries at once, pushed down to the stored vectors
        rest = search(vectors.where((F.col("norm") < cut) & (F.col("norm") >= reach)), shared, thresholds)
        number_of = spark.createDataFrame([(i, int(x)) for i, x in enumerate(queries.ids)], "query int, number long")
        best = _ranked(head.drop("rank").unionByName(rest), k)
        return checkpoint(best.join(F.broadcast(number_of), "query").select("number", "rank", "doc_id", "score"))


def top_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of the highest score above 0 for each item (item_id, text)."""
    pairs = checkpoint(query_terms(items))
    ids = checkpoint(pairs.select("item_id").distinct().withColumn("number", F.monotonically_increasing_id()))
    blocks = -(-pairs.count() // BLOCK)
    dealt = pairs.join(ids, pairs["item_id"].eqNullSafe(ids["item_id"])).select("number", "term", F.pmod(F.xxhash64("number"), F.lit(max(blocks, 1))).alias("block"))
    out = docs.sparkSession.createDataFrame([], "number long, rank int, doc_id long, score long")
    for block in range(blocks):
        own = dealt.where(F.col("block") == block).select("number", "term").toArrow()
        if own.num_rows:
            out = out.unionByName(_search_block(docs, own, k))
    return out.join(ids, "number").select("item_id", "rank", "doc_id", "score")
