"""Suffix-array dedup by column-wise multi-document construction of the Burrows-Wheeler transform.

Equal strings of ``depth`` bytes have to meet in one collection. Every such string
has an anchor, the 20 bytes in it with the smallest hash, and strings that are
next to each other and have the same anchor form a segment of at most 80 bytes. Shards say
which anchors occur in more than one document; segments of those go to the anchor's shard,
equal ones of a batch once, with the smallest document that has them. A shard builds
the transform and the common prefixes of its segments as a collection, column by
column, in blocks that hold all segments of an anchor. Neighbours with a common prefix of
``depth`` are the same string; the smallest document of each goes back to the batches,
which remove what a smaller document has.

Defined results: a null or empty text has no bytes; a text shorter than ``depth`` keeps all;
rows with equal keys don't remove each other's bytes; a null key counts as larger
than any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bwt
from tidemark.llm import exchange as X
from tidemark.llm import hashing as H

ANCHOR = 20
#: Bytes of segments in a block, unless one anchor has more.
BLOCK = 1 << 18
#: Bytes of documents that are searched for segments at a time.
CHUNK = 1 << 18
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_PLACE = np.uint64((1 << 32) - 1)


def segments(table: pa.Table, depth: int):
    """Bytes, document offsets, and per segment: first window, number of windows, document row, anchor hash.

    Some documents at a time, so that the working arrays stay in the processor's cache.
    """
    buf, offsets = H.flat(table.column("text"))
    cuts = np.unique(np.r_[0, np.searchsorted(offsets, np.arange(CHUNK, len(buf), CHUNK)), len(offsets) - 1])
    parts = [_segments(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], depth) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    parts = [(first + offsets[a], n, row + a, anchor) for a, (first, n, row, anchor) in zip(cuts[:-1], parts, strict=True)] or [_segments(buf, offsets, depth)]
    return buf, offsets, *(np.concatenate(x) for x in zip(*parts, strict=True))


def _segments(buf: np.ndarray, offsets: np.ndarray, depth: int):
    n = len(buf) - depth + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    hashes = H.fixed_hash(buf, ANCHOR)
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)  # the leftmost of equals
    span, width = 1, depth - ANCHOR + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    anchor = (low & _PLACE).astype(np.int64)
    whole = np.zeros(n + 1, np.int8)  # windows that end inside their document
    long = np.flatnonzero(np.diff(offsets) >= depth)
    np.add.at(whole, offsets[long], 1)
    np.add.at(whole, offsets[long + 1] - depth + 1, -1)
    whole = np.cumsum(whole[:-1], dtype=np.int8) > 0
    change = np.ones(n + 1, bool)
    change[1:-1] = anchor[1:] != anchor[:-1]
    change[offsets[long]] = True
    change[offsets[long + 1] - depth + 1] = True
    first = np.flatnonzero(whole & change[:-1])
    last = np.flatnonzero(whole & change[1:])
    return first, last - first + 1, np.searchsorted(offsets, first, side="right") - 1, hashes[anchor[first]]


def _shard(anchor: np.ndarray, n_shards: int) -> np.ndarray:
    return (H.mix(anchor ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(n_shards)).astype(np.int64)


def least_documents(texts: list[bytes], anchors: np.ndarray, docs: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each segment, the smallest document of each of its strings of depth bytes."""
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(t, len(known)) for t in texts])
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs)
    anchor = np.zeros(len(known), np.uint64)
    anchor[which] = anchors
    distinct = list(known)
    order = np.argsort(anchor, kind="stable")
    size = np.array([len(distinct[i]) for i in order])
    same = np.r_[False, anchor[order][1:] == anchor[order][:-1]]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(known)
    begin, total = 0, np.cumsum(size)
    while begin < len(order):
        end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + BLOCK)) + 1
        while end < len(order) and same[end]:
            end += 1
        block = order[begin:end]
        lengths = size[begin:end]
        data = np.frombuffer(b"".join([distinct[i] for i in block]), np.uint8)
        used = np.zeros(256, bool)
        used[data] = True
        code = np.cumsum(used).astype(np.uint8 if used.sum() < 256 else np.uint16)
        text, offset, number = bwt.suffix_classes(code[data], lengths, depth)
        smallest = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, number, least[block][text])
        windows = lengths - depth + 1
        ends = np.cumsum(windows)
        flat = np.empty(ends[-1], np.int64)
        flat[(ends - windows)[text] + offset] = smallest[number]
        for i, part in zip(block.tolist(), np.split(flat, ends[:-1]), strict=True):
            out[i] = part
        begin = end
    return [out[i] for i in which.tolist()]


def remove_repeats(docs: DataFrame, depth: int = 50, keep: bool = True) -> DataFrame:
    n_shards = X.shards(docs)
    packed = X.pack(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))

    def keys(table: pa.Table) -> np.ndarray:
        return table.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64)

    def anchors(row: np.ndarray, anchor: np.ndarray, key: np.ndarray):
        """Distinct anchors by shard, and whether two documents of the batch have them."""
        known, which = np.unique(anchor, return_inverse=True)
        low = np.full(len(known), np.iinfo(np.int64).max)
        high = np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(low, which, key[row])
        np.maximum.at(high, which, key[row])
        return known, which, low < high, *X.by_shard(_shard(known, n_shards), n_shards)

    def ask(table: pa.Table):
        _, _, _, _, row, anchor = segments(table, depth)
        known, _, several, order, bounds = anchors(row, anchor, keys(table))
        for s in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[s] : bounds[s + 1]]
            yield int(s), X.dump(known[own], np.packbits(several[own]))

    def shared(bodies: list[bytes]) -> list[bytes | None]:
        got = [X.load(b, np.uint64, np.uint8) for b in bodies]
        key = np.concatenate([g[0] for g in got])
        several = np.concatenate([np.unpackbits(g[1])[: len(g[0])] for g in got])
        known, which = np.unique(key, return_inverse=True)
        many = (np.bincount(which, 1 + several, len(known)) > 1)[which]
        return [X.dump(np.packbits(x)) if x.any() else None for x in np.split(many, np.cumsum([len(g[0]) for g in got])[:-1])]

    def chosen(table: pa.Table, replies: dict[int, bytes]):
        """Segments whose anchor other documents have: their numbers, and the distinct ones of them."""
        buf, offsets, first, windows, row, anchor = segments(table, depth)
        known, which, _, order, bounds = anchors(row, anchor, keys(table))
        good = np.zeros(len(known), bool)
        for s, body in replies.items():
            own = order[bounds[s] : bounds[s + 1]]
            good[own] = np.unpackbits(X.load(body, np.uint8)[0])[: len(own)] > 0
        some = np.flatnonzero(good[which])
        code = H.range_hash(buf, first[some], first[some] + windows[some] + depth - 1)
        _, at, inverse = np.unique(code, return_index=True, return_inverse=True)
        return buf, offsets, first, windows, row, anchor, some, at, inverse

    def send(table: pa.Table, replies: dict[int, bytes]):
        buf, _, first, windows, row, anchor, some, at, inverse = chosen(table, replies)
        key = keys(table)
        least = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, key[row[some]])
        yield X.KEPT, X.dump(np.packbits(np.isin(np.arange(len(first)), some)))
        raw = buf.tobytes()
        pick = some[at]
        in_place = np.argsort(at, kind="stable")  # neighbours compress better
        order, bounds = X.by_shard(_shard(anchor[pick[in_place]], n_shards), n_shards)
        for s in np.flatnonzero(np.diff(bounds)):
            own = in_place[order[bounds[s] : bounds[s + 1]]]
            texts = [raw[a : a + n] for a, n in zip(first[pick[own]].tolist(), (windows[pick[own]] + depth - 1).tolist(), strict=True)]
            yield int(s), X.dump(own.astype(np.uint32), np.array([len(t) for t in texts], np.uint32), anchor[pick[own]], np.diff(least[own], prepend=0), np.frombuffer(b"".join(texts), np.uint8))

    def build(bodies: list[bytes]) -> list[bytes | None]:
        own, texts, anchor, least = [], [], [], []
        for b in bodies:
            i, lengths, a, delta, data = X.load(b, np.uint32, np.uint32, np.uint64, np.int64, np.uint8)
            raw, ends = data.tobytes(), np.cumsum(lengths)
            own.append(i)
            texts += [raw[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            anchor.append(a)
            least.append(np.cumsum(delta))
        found = least_documents(texts, np.concatenate(anchor), np.concatenate(least), depth)
        out, begin = [], 0
        for i in own:
            out.append(X.dump(i, np.diff(np.concatenate(found[begin : begin + len(i)]), prepend=0)))
            begin += len(i)
        return out

    def settle(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        buf, offsets, first, windows, row, anchor = segments(table, depth)
        key = keys(table)
        some = np.flatnonzero(np.unpackbits(X.load(replies[X.KEPT], np.uint8)[0])[: len(first)])
        code = H.range_hash(buf, first[some], first[some] + windows[some] + depth - 1)
        _, at, inverse = np.unique(code, return_index=True, return_inverse=True)
        n = windows[some][at]
        begin = np.cumsum(n) - n
        least = np.full(int(n.sum()), np.iinfo(np.int64).max)
        for s, body in replies.items():
            if s != X.KEPT:
                own, delta = X.load(body, np.uint32, np.int64)
                own = own.astype(np.int64)
                m = n[own]
                least[np.repeat(begin[own] - (np.cumsum(m) - m), m) + np.arange(m.sum())] = np.cumsum(delta)
        m = windows[some]
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        repeated = least[np.repeat(begin[inverse], m) + inner] < np.repeat(key[row[some]], m)
        gone = H.covered(len(buf), (np.repeat(first[some], m) + inner)[repeated], depth)
        removed = np.r_[0, np.cumsum(gone)]
        starts = gone & ~np.r_[False, gone[:-1]]
        starts[offsets[:-1][offsets[:-1] < len(buf)]] |= gone[offsets[:-1][offsets[:-1] < len(buf)]]
        spans = np.r_[0, np.cumsum(starts)]
        kept = buf[~gone].tobytes()
        rows, used = [], 0
        for i, doc in enumerate(table.column("doc_id").to_pylist()):
            a, b = offsets[i], offsets[i + 1]
            out = int(removed[b] - removed[a])
            text = kept[used : used + int(b - a) - out]
            used += len(text)
            rows.append((doc, int(b - a), out, int(spans[b] - spans[a]), hashlib.sha256(text).hexdigest(), text if keep else None))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    known = X.answer(X.ask(packed, ask), shared)
    found = X.answer(X.ask_again(packed, known, send), build)
    return X.settle(packed, found, settle, SCHEMA)
