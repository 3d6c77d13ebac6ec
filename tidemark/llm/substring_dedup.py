"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted over the corpus.

A word is removed when a window that covers it has a word sequence that also
starts in a document with a smaller key. Each batch sends its distinct window
hashes with the smallest document that has them; a shard finds the smallest
document of all and replies one bit a hash. Windows that are repeated merge into
maximal removal intervals. A 64-bit hash identifies a window within a shard, and
the shard comes from a second hash, so chance agreement grows with the number of
windows in a shard, not with the square of the corpus.

Defined results: a null or empty text has no words; a text shorter than a window
keeps all; rows with equal keys don't remove each other's words; a null key
counts as larger than any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as X
from tidemark.llm import hashing as H

SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<first:int,last:int>>, kept_sha256 string, kept string"


def _keys(table: pa.Table) -> np.ndarray:
    """Document keys; null is the largest."""
    return table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64)


def _distinct_windows(table: pa.Table, k: int, n_shards: int):
    buf, offsets = H.flat(table.column("text"))
    start, end, doc = H.word_spans(buf, offsets)
    words = H.range_hash(buf, start, end)
    at, h = H.windows(words, doc, k)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    shard = (H.windows(words, doc, k, lane=1)[1][first] % np.uint64(n_shards)).astype(np.int64)
    return doc, at, h, first, inverse, shard


def remove_repeats(docs: DataFrame, k: int = 13, keep_text: bool = True) -> DataFrame:
    """Per document: words, removed words, removed word intervals, kept words joined by one space and their SHA-256."""
    n_shards = X.shards(docs)
    packed = X.pack(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))

    def ask(table: pa.Table):
        doc, at, h, first, _, shard = _distinct_windows(table, k, n_shards)
        keys = _keys(table)
        first_in_order = np.argsort(first)
        first, shard = first[first_in_order], shard[first_in_order]
        order, bounds = X.by_shard(shard, n_shards)
        for s in np.flatnonzero(np.diff(bounds)):
            own = first[order[bounds[s] : bounds[s + 1]]]
            docs_here, which = np.unique(doc[at[own]], return_inverse=True)
            yield int(s), X.dump(h[own], np.diff(keys[docs_here], prepend=0), np.diff(which, prepend=0).astype(np.uint16))

    def answer(bodies: list[bytes]) -> list[bytes | None]:
        hashes, least = [], []
        for b in bodies:
            h, delta, which = X.load(b, np.uint64, np.int64, np.uint16)
            hashes.append(h)
            least.append(np.cumsum(delta)[np.cumsum(which.astype(np.int64))])
        h, key = np.concatenate(hashes), np.concatenate(least)
        order = np.lexsort((key, h))
        begins = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        smaller = np.empty(len(h), dtype=bool)
        smaller[order] = key[order] > np.repeat(key[order][begins], np.diff(np.r_[begins, len(h)]))
        out = []
        for bits in np.split(smaller, np.cumsum([len(x) for x in hashes])[:-1]):
            out.append(X.dump(np.packbits(bits)) if bits.any() else None)
        return out

    def settle(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        doc, at, h, first, inverse, shard = _distinct_windows(table, k, n_shards)
        keys = _keys(table)
        in_order = np.argsort(first)
        order, bounds = X.by_shard(shard[in_order], n_shards)
        elsewhere = np.zeros(len(first), dtype=bool)
        for s, body in replies.items():
            own = in_order[order[bounds[s] : bounds[s + 1]]]
            elsewhere[own] = np.unpackbits(X.load(body, np.uint8)[0])[: len(own)]
        if len(at):
            repeated = elsewhere[inverse] | (keys[doc[at]] > keys[doc[at[first]]][inverse])
            gone = H.covered(len(doc), at[repeated], k)
        else:
            gone = np.zeros(len(doc), dtype=bool)
        bounds = np.searchsorted(doc, np.arange(table.num_rows + 1))
        rows = []
        for i, (key, text) in enumerate(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)):
            words, out = (text or "").encode().split(), gone[bounds[i] : bounds[i + 1]]
            n_gone = int(out.sum())
            spans = []
            if n_gone:
                words = list(compress(words, ~out))
                edge = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8)))
                spans = [{"first": int(a), "last": int(b) - 1} for a, b in edge.reshape(-1, 2)]
            kept = b" ".join(words)
            rows.append((key, len(out), n_gone, spans, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
        names = ["doc_id", "n_words", "n_removed", "spans", "kept_sha256", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.string(), pa.string()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    replies = X.answer(X.ask(packed, ask), answer)
    return X.settle(packed, replies, settle, SCHEMA)
