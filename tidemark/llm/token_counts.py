"""Token counts: the exact histogram of encoded lengths, and what it says for every context limit.

Documents are reduced to (length, documents) where they are read; only that
histogram is shuffled. Prefix and suffix sums over it answer totals, quantiles
and truncated totals. The sums run in two levels, over ranges of 256 lengths and
within a range, so no task holds the whole histogram.

Defined results: a null or empty text has length 0; rows with equal keys count
each; an empty table gives no rows; a text of any length is encoded whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import checkpoint

#: How the byte-level vocabularies split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): documents of each encoded length, summed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = _encoding(ranks).encode_ordinary, {}
        for b in batches:
            for x in b.column(0):
                n = len(encode(x.as_py() or ""))
                seen[n] = seen.get(n, 0) + 1
        n = np.array(sorted(seen), dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(n), "n_docs": pa.array([seen[i] for i in n.tolist()], pa.int64())})

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def by_limit(histogram: DataFrame, width: int = 256) -> DataFrame:
    """For every length as the limit: documents and tokens up to it, those beyond it, the tokens left when longer documents are cut there, and the share of documents up to it."""
    h = histogram.select(F.floor(F.col("n_tokens") / width).alias("range"), "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    ranges = h.groupBy("range").agg(F.sum("n_docs").alias("range_docs"), F.sum("tokens").alias("range_tokens"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for every 256 lengths
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("range_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("range_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("range_docs").over(everything).alias("all_docs"),
        F.sum("range_tokens").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("range").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(ranges, "range").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(within)).alias("docs_within"),
        (F.col("tokens_before") + F.sum("tokens").over(within)).alias("tokens_within"),
        "all_docs",
        "all_tokens",
    )
    beyond = F.col("all_docs") - F.col("docs_within")
    return out.select(
        "n_tokens", "n_docs", "docs_within", "tokens_within", beyond.alias("docs_beyond"), (F.col("all_tokens") - F.col("tokens_within")).alias("tokens_beyond"),
        (F.col("tokens_within") + beyond * F.col("n_tokens")).alias("truncated_tokens"), (F.col("docs_within") / F.col("all_docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    return by_limit(checkpoint(lengths(docs, ranks, text)))  # read twice, encoded once
