"""Hybrid search over chunks: dense scores, their mix with lexical ones (search_index.py), diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def words_of(text: str) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


#: Vectors in a part and queries in a block, which a task holds; and queries in one matrix product.
PART, BLOCK, STEP = 20_000, 8192, 256
#: More than a cosine can be off by rounding.
SLACK = 1e-9


def dense(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest vectors of each query by cosine, over all vectors.

    Blocks of queries meet parts of vectors once each, as a matrix product, and leave only
    their k best; ranks are made over those. The numbers of blocks and parts follow the numbers of rows.
    """
    n_blocks, n_parts = (max(1, -(-x.count() // size)) for x, size in ((queries, BLOCK), (vectors, PART)))
    dealt_to = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")  # noqa: E731  # keys of both sides need the same type, or equal ones are sent to different tasks
    blocks = queries.select("query_id", F.col("vector").alias("q"), dealt_to("query_id", n_blocks).alias("block"))
    dealt = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    sides = vectors.select("vec_id", "vector", dealt_to("vec_id", n_parts).alias("part"))
    sides = sides.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))) if n_blocks > 1 else sides.withColumn("block", F.lit(0))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ids, asked = right["vec_id"].to_numpy(), left["query_id"].to_numpy()
        v, q, out = _rows(right["vector"]), _rows(left["q"]), []
        v_norm, q_norm = np.sqrt(_dot(v, v)), np.sqrt(_dot(q, q))
        v_unit, q_unit = v / np.maximum(v_norm, 1e-300)[:, None], q / np.maximum(q_norm, 1e-300)[:, None]
        for a in range(0, len(asked), STEP):
            s = q_unit[a : a + STEP] @ v_unit.T
            s[asked[a : a + STEP, None] == ids[None, :]] = -np.inf
            least = np.partition(s, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
            # the product's rounding depends on a vector's place, so all that may be among the k best are computed again in one order
            i, j = np.nonzero((s >= least[:, None] - SLACK) & np.isfinite(s))
            norm = q_norm[a + i] * v_norm[j]
            exact = np.where(norm > 0, _dot(q, v, a + i, j) / np.where(norm > 0, norm, 1.0), 0.0)
            order = np.lexsort((ids[j], -exact, i))  # ties go to the smaller id
            i, j, exact = i[order], j[order], exact[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pd.DataFrame({"query_id": asked[a + i[first]], "vec_id": ids[j[first]], "similarity": exact[first]}))
        return pd.concat(out)

    near = dealt.groupBy("part", "block").cogroup(sides.groupBy("part", "block")).applyInPandas(run, "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def _rows(rows) -> np.ndarray:
    return np.array([np.asarray(r, np.float64) for r in rows])


def _dot(a: np.ndarray, b: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
    """Products of row i of a with row j of b, their terms added one after the other."""
    total = np.zeros(len(a[i, 0]))
    for c in range(a.shape[1]):
        total += a[i, c] * b[j, c]
    return total


def _unit(rows) -> np.ndarray:
    v = _rows(rows)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def norm(a: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(_product(a, a))


def _product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """In double precision; 0 when a vector has no length. Lengths that are known needn't be computed for each pair."""
    norms = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(norms > 0, _product(a, b) / norms).otherwise(0.0)


def hybrid(lexical: DataFrame, semantic: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Both scores scaled to 0..1 within a query and mixed; a missing one counts as 0."""
    w = Window.partitionBy("query_id")
    low = lambda c: F.min(c).over(w)
    scale = lambda c: F.when(F.max(c).over(w) > low(c), (F.col(c) - low(c)) / (F.max(c).over(w) - low(c))).otherwise(F.when(F.col(c).isNotNull(), 1.0))
    both = lexical.select("query_id", "chunk", F.col("score").alias("l")).join(semantic.select("query_id", "chunk", F.col("score").alias("s")), ["query_id", "chunk"], "full_outer")
    mixed = alpha * F.coalesce(scale("l"), F.lit(0.0)) + (1 - alpha) * F.coalesce(scale("s"), F.lit(0.0))
    return both.select("query_id", "chunk", F.round(mixed, 6).alias("score"))


def best(scores: DataFrame, retrieved: int = 5) -> DataFrame:
    """The best candidates (query_id, chunk, score) of each query, equal ones by chunk."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= retrieved).drop("place")


def diverse(candidates: DataFrame, k: int = 3, weight: float = 0.7, retrieved: int = 5) -> DataFrame:
    """Maximal marginal relevance: of the retrieved best candidates of a query, k results, each weighed by its score against its likeness to those before.

    The best are found by Spark, so what is compared with each other is as many as are asked for, however many candidates there are; queries are ranked many a call.
    """
    held = best(candidates, retrieved).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "chunk", "vector"))).alias("held"))
    rows = held.select("query_id", F.transform("held", lambda x: -x["less"]).alias("score"), F.transform("held", lambda x: x["chunk"]).alias("chunk"), F.transform("held", lambda x: x["vector"]).alias("vector"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            sizes = pdf["chunk"].map(len).to_numpy()
            for size in np.unique(sizes):  # queries with as many candidates, side by side
                some = pdf[sizes == size]
                chunk, score = np.stack(some["chunk"].to_list()), np.stack(some["score"].to_list()).astype(np.float64)
                v = _unit([x for listed in some["vector"] for x in listed]).reshape(len(some), size, -1)
                each, worst, left, picked = np.arange(len(some)), np.zeros((len(some), size)), np.ones((len(some), size), bool), []
                for place in range(min(k, size)):
                    worth = np.where(left, weight * score - (1 - weight) * worst, -np.inf)
                    chosen = worth.argmax(axis=1)
                    picked.append(chunk[each, chosen])
                    left[each, chosen] = False
                    alike = np.einsum("qcd,qd->qc", v, v[each, chosen])
                    worst = alike if place == 0 else np.maximum(worst, alike)
                picked = np.stack(picked, axis=1)
                yield pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), picked.shape[1]), "chunk": picked.ravel(), "rank": np.tile(np.arange(1, picked.shape[1] + 1), len(some))})

    return rows.mapInPandas(run, "query_id long, chunk long, rank int")
