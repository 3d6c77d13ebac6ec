"""Line dedup: fuzzy lines by MinHash, one line kept for each component.

A line is compared by its bytes without white space at its ends and with A-Z
lower-cased. Its set is its distinct 8-byte shingles, which fit a 64-bit number
exactly; a shorter line is one shingle. Equal lines are one from the start, known by a
hash of 128 bits. A signature has one MinHash value for each of 64 slots: every shingle is hashed
once and falls in one slot, and an empty slot borrows the value of another one, chosen by a
fixed sequence. Of 16 bands of 4 values a pair at similarity 0.8 shares one with probability 0.9998.
All pairs of a small bucket are candidates. Lines of a larger bucket are first compared with its smallest
one; those that are in different components after that meet by their rarest shingles, which no
pair at 0.8 escapes. Candidates are verified by their exact Jaccard similarity,
and verified links are joined by distributed union-find. Of each component the first line stays, by
(doc_id, line number), and all other occurrences go.

Defined results: a null text has no lines and stays null; an empty text has one
empty line; lines that are empty or white space are never removed; the kept lines of a
document are joined by newlines, unchanged; texts and lines may be of any length; rows with equal doc_id count as the
same document (an equal line at the same place stays in each); rows with a null
doc_id stay as they are and remove nothing; an empty table stays empty; other columns are kept, but for
n_lines, n_removed and kept_sha256, which a report sets anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom, rarest
from tidemark.llm import exchange as X
from tidemark.llm import hashing as H
from tidemark.llm.components import link_groups, with_sides
from tidemark.llm.storage import written

SHINGLE = 8
BANDS, ROWS = 16, 4
SLOTS = BANDS * ROWS
#: An empty slot.
NONE = np.uint64((1 << 64) - 1)
#: Masks of the first 0 to 8 bytes of a number.
PART = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Odd factors of the values of a band, and what is added for each band.
MIXERS = np.random.default_rng(5).integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = np.random.default_rng(6).integers(0, 1 << 63, BANDS, dtype=np.uint64)
#: Lines in a bucket of which all pairs are candidates.
GROUP = 8
#: Bytes of lines, if not one line or pair, whose shingles are held at a time; these are 8 times as long, in several arrays.
VERIFIED = 512 << 10
#: For each attempt, the slot that each empty slot looks at.
BORROW = np.stack([np.random.default_rng(11 + i).permutation(SLOTS) for i in range(256)])


def line_spans(texts: pa.Array):
    """Lower-cased bytes; trimmed begin and end, document row and number (from 0) of each line."""
    buf, offsets = H.flat(texts, lower=True)
    docs = np.arange(len(offsets) - 1)
    breaks = np.flatnonzero(buf == 10)
    row = np.r_[docs, np.searchsorted(offsets, breaks, side="right") - 1]
    start = np.r_[offsets[:-1], breaks + 1]
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    same = np.r_[row[1:] == row[:-1], False]
    end = offsets[1:][row]
    end[same] = start[np.flatnonzero(same) + 1] - 1
    number = np.arange(len(row)) - np.searchsorted(row, row)
    for side, step in ((start, 1), (end, -1)):  # most lines end after a step or two; the others need one look at all bytes
        for _ in range(8):
            at = np.flatnonzero(start < end)
            at = at[H.IS_SPACE[buf[side[at] - (step < 0)]]]
            side[at] += step
            if not len(at):
                break
        else:
            solid = np.flatnonzero(~H.IS_SPACE[buf])
            at = at[start[at] < end[at]]
            a, b = np.searchsorted(solid, start[at]), np.searchsorted(solid, end[at]) - 1
            some = at[b >= a]
            start[some], end[some] = solid[a[b >= a]], solid[b[b >= a]] + 1
            end[at[b < a]] = start[at[b < a]]
    return buf, start, end, row, number


def line_ids(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each line, polynomials of its bytes taken eight at a time from its start on."""
    value, size = H.eights(buf), end - start
    n = np.maximum(-(-size // 8), 1)
    sums = np.empty((2, len(start)), np.uint64)
    for a, b in _blocks(n):
        bounds = np.r_[0, np.cumsum(n[a:b])]
        at = np.arange(bounds[-1])
        word = value[8 * at + np.repeat(start[a:b] - 8 * bounds[:-1], n[a:b])]
        word[bounds[1:] - 1] &= PART[size[a:b] - 8 * (n[a:b] - 1)]
        at -= np.repeat(bounds[:-1], n[a:b])
        for lane, base in enumerate(H.BASES):
            x = H.mix(word + np.uint64(H.BASES[1 - lane]))
            x *= H.powers(base, int(n[a:b].max()))[at]
            sums[lane, a:b] = np.add.reduceat(x, bounds[:-1])
    return tuple(H.mix(sums + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64))


def _blocks(n: np.ndarray):
    """Bounds of runs of lines with so many numbers n together that these stay in the cache."""
    cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) >> 15)) + 1, len(n)]
    return zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if len(n) else ()


def _shingles(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of the lines, one line after the other, and the bounds of the lines."""
    n = np.maximum(end - start - SHINGLE + 1, 1)
    bounds = np.r_[0, np.cumsum(n)]
    out = H.eights(buf)[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], n)]
    short = np.flatnonzero(end - start < SHINGLE)
    out[bounds[short]] &= PART[(end - start)[short]]
    return out, bounds


def _least(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least hash of the shingles of each line in each slot, NONE in an empty one; value has the bytes at every position, and lines are filled, apart and in order."""
    n = np.maximum(end - start - SHINGLE + 1, 1)
    least = np.full((len(start) + 1) * SLOTS, NONE)  # the last row is of the positions between
    for a, b in _blocks(n):
        low = start[a]
        x = value[low : start[b - 1] + n[b - 1]].copy()
        short = np.flatnonzero(end[a:b] - start[a:b] < SHINGLE) + a
        x[start[short] - low] &= PART[(end - start)[short]]
        x = H.mix(x)
        times = np.empty(2 * (b - a) - 1, np.int64)
        times[::2], times[1::2] = n[a:b], start[a + 1 : b] - start[a : b - 1] - n[a : b - 1]
        rows = np.full(len(times), len(start) * SLOTS)
        rows[::2] = np.arange(a, b) * SLOTS
        at = np.repeat(rows, times)
        at += (x >> np.uint64(58)).view(np.int64)
        np.minimum.at(least, at, x)
    return least[:-SLOTS]


def signatures(buf, start, end) -> np.ndarray:
    """The band keys of each line."""
    keys = np.zeros((BANDS, len(start)), np.uint64)
    value = H.eights(buf)
    for a in range(0, len(start), 4096):
        b = min(a + 4096, len(start))
        least = _least(value, start[a:b], end[a:b])
        filled = least.copy()
        empty = np.flatnonzero(least == NONE)
        for borrow in BORROW:
            if not len(empty):
                break
            filled[empty] = least[empty - empty % SLOTS + borrow[empty % SLOTS]]
            empty = empty[filled[empty] == NONE]
        if len(empty):
            filled[empty] = least.reshape(-1, SLOTS).min(axis=1)[empty // SLOTS]
        bands = filled.reshape(-1, BANDS, ROWS)
        joint = bands[:, :, 0] * MIXERS[0] + SALTS
        for i in range(1, ROWS):
            joint += bands[:, :, i] * MIXERS[i]
        keys[:, a:b] = H.mix(joint).T
    return keys


def _repeated(x: np.ndarray) -> np.ndarray:
    """Positions of the numbers that occur more than once."""
    order = np.argsort(x)
    same = x[order[1:]] == x[order[:-1]]
    return order[np.r_[False, same] | np.r_[same, False]] if len(x) else order


def _by_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order by a, then b, where equal a's mostly have equal b's."""
    order = np.argsort(a)
    if ((a[order[1:]] == a[order[:-1]]) & (b[order[1:]] != b[order[:-1]])).any():
        order = np.lexsort((b, a))
    return order


def _first_of_each(ids: np.ndarray, check: np.ndarray, doc: np.ndarray, number: np.ndarray):
    """Positions of the first occurrence of each line, by (doc, number), in order of the lines, and their number of occurrences."""
    order = np.lexsort((number, doc, check, ids))
    new = np.flatnonzero(np.r_[True, (ids[order[1:]] != ids[order[:-1]]) | (check[order[1:]] != check[order[:-1]])]) if len(ids) else np.zeros(0, np.int64)
    return order[new], np.diff(np.r_[new, len(ids)])


def _occurrences(b: pa.RecordBatch):
    """Of the filled lines of (doc_id, text) rows: bytes, start, end, line, check, doc_id, number."""
    buf, start, end, row, number = line_spans(b.column(1))
    at = np.flatnonzero(end > start)
    start, end = start[at], end[at]
    return buf, start, end, *line_ids(buf, start, end), b.column(0).to_numpy()[row[at]], number[at]


def _candidates(docs: DataFrame) -> DataFrame:
    """(kind, a, b, doc_id, number): kind 0 pairs of lines that share a band; 1 members b of a large bucket a; 2 lines (line a, check b) that occur more than once, with the first occurrence."""
    n_shards = X.shards(docs)
    low = np.uint64((1 << 40) - 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in X.slices(batches, 4 << 20):
            buf, start, end, ids, check, doc, number = _occurrences(b)
            at, times = _first_of_each(ids, check, doc, number)
            own_shard = (ids[at] % n_shards).astype(np.int64)
            text_order = np.argsort(at)
            key = signatures(buf, start[at[text_order]], end[at[text_order]]).ravel()
            band_ids = np.tile(ids[at[text_order]], BANDS)
            by_key = np.argsort(key // np.uint64(n_shards) & low)
            key, band_ids = key[by_key], band_ids[by_key]
            order, bounds = X.by_shard((key % np.uint64(n_shards)).astype(np.int64), n_shards)
            order2, bounds2 = X.by_shard(own_shard, n_shards)
            key, band_ids = key[order] // np.uint64(n_shards) & low, band_ids[order]
            many, at = times[order2] > 1, at[order2]
            ids, check, doc, number = ids[at], check[at], doc[at], number[at].astype(np.uint32)
            for s in np.flatnonzero(np.diff(bounds) + np.diff(bounds2)):
                own, same = slice(bounds[s], bounds[s + 1]), slice(bounds2[s], bounds2[s + 1])
                body = X.dump(X.dump_sorted(key[own]), band_ids[own], X.dump_sorted(ids[same].view(np.uint64)), check[same], doc[same], number[same], many[same])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "body": pa.array([body], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        got = [X.load(x, np.uint8, np.int64, np.uint8, np.int64, np.int64, np.uint32, np.bool_) for x in table.column("body").to_pylist()]
        key, ids = np.concatenate([X.load_sorted(g[0]) for g in got]), np.concatenate([g[1] for g in got])
        order = _repeated(key)
        key, ids = key[order], ids[order]
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])][: len(key)]
        key, ids = key[new], ids[new]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        size = np.diff(np.r_[begins, len(key)])
        a, b = [], []
        for g in range(2, GROUP + 1):
            members = begins[size == g][:, None] + np.arange(g)
            i, j = np.triu_indices(g, 1)
            a.append(ids[members[:, i].ravel()])
            b.append(ids[members[:, j].ravel()])
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        pairs = np.stack([a[new], b[new]], axis=1)
        large = np.flatnonzero(np.repeat(size, size) > GROUP)
        bucket = H.mix(key[large] * np.uint64(n_shards) + np.uint64(table.column("shard")[0].as_py())).view(np.int64)
        line, check, doc, number, many = np.concatenate([X.load_sorted(g[2]) for g in got]).view(np.int64), *(np.concatenate([g[i] for g in got]) for i in (3, 4, 5, 6))
        some = np.union1d(_repeated(line), np.flatnonzero(many))  # those that occur in several slices, or twice in one
        line, check, doc, number, many = (x[some] for x in (line, check, doc, number, many))
        at, times = _first_of_each(line, check, doc, number)
        again = np.zeros(len(line), bool)
        again[at] = times > 1
        order = np.lexsort((number, doc, check, line))
        starts = np.repeat(np.cumsum(times) - times, times)
        again[order[starts[many[order]]]] = True
        again = np.flatnonzero(again)
        zero = np.zeros(len(pairs) + len(large), np.int64)
        columns = [
            np.r_[np.zeros(len(pairs), np.int64), np.ones(len(large), np.int64), np.full(len(again), 2)], np.r_[pairs[:, 0], bucket, line[again]],
            np.r_[pairs[:, 1], ids[large], check[again]], np.r_[zero, doc[again]], np.r_[zero, number[again].astype(np.int64)],
        ]
        return pa.Table.from_arrays([pa.array(c) for c in columns], ["kind", "a", "b", "doc_id", "number"])

    return docs.mapInArrow(ask, "shard int, body binary").groupBy("shard").applyInArrow(meet, "kind long, a long, b long, doc_id long, number long")


def _lines(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, check, doc_id, number, line) of the wanted lines: their first occurrence and bytes. Of different lines with one id the one with the smallest check counts."""
    wanted = bloom.build(ids)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in X.slices(batches):
            buf, start, end, own, check, doc, number = _occurrences(b)
            some = bloom.passing(wanted, own.view(np.uint64))
            at = some[_first_of_each(own[some], check[some], doc[some], number[some])[0]]
            raw = buf.tobytes()
            lines = pa.array([raw[x:y] for x, y in zip(start[at].tolist(), end[at].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(check[at]), pa.array(doc[at]), pa.array(number[at].astype(np.int64)), lines], ["id", "check", "doc_id", "number", "line"])

    lines = docs.mapInArrow(emit, "id long, check long, doc_id long, number long, line binary").join(ids, "id", "left_semi")
    return written(lines.groupBy("id").agg(F.min(F.struct("check", "doc_id", "number", "line")).alias("least")).select("id", "least.*"))


def similar(lines_a: pa.Array, lines_b: pa.Array, percent: int = 80) -> np.ndarray:
    """Whether each pair of lines has 100 * common >= percent * union shingles; at most 65,536 pairs."""
    m = len(lines_a)
    texts = pa.concat_arrays([lines_a, lines_b])
    flat, offsets = np.frombuffer(b"".join(texts.to_pylist()), np.uint8), np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy())]
    value, bounds = _shingles(flat, offsets[:-1], offsets[1:])
    key = np.repeat(np.tile(np.arange(m, dtype=np.uint64) << np.uint64(48), 2), np.diff(bounds)) | (H.mix(value) >> np.uint64(16))
    left, right = H.distinct(key[: bounds[m]]), H.distinct(key[bounds[m] :])
    both = np.concatenate([left, right])
    both.sort()
    count = lambda x: np.bincount((x >> np.uint64(48)).astype(np.int64), minlength=m)
    common = count(both[1:][both[1:] == both[:-1]])
    over = 100 * common - percent * (count(both) - common)
    linked = over >= 0
    near = np.abs(over) <= 4 * percent  # here the shingles themselves decide, not their hashes
    at = np.flatnonzero(np.tile(near, 2))
    n = np.diff(bounds)[at]
    value = value[np.repeat(bounds[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    pair, side = np.repeat(at % m, n), np.repeat(at >= m, n)
    order = np.lexsort((side, value, pair))
    pair, value, side = pair[order], value[order], side[order]
    same = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
    new = np.r_[True, ~same][: len(pair)]
    common = np.bincount(pair[1:][same & (side[1:] != side[:-1])], minlength=m)
    linked[near] = (100 * common >= percent * np.bincount(pair[new], minlength=m))[near]
    return linked


def verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Those of the pairs (a, b, a_line, b_line) that are similar, as (a, b)."""
    for whole in batches:
        ends = np.cumsum(pc.add(pc.binary_length(whole.column(2)), pc.binary_length(whole.column(3))).to_numpy().astype(np.int64))
        begin = 0
        while begin < whole.num_rows:
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + VERIFIED, side="right")))
            b = whole.slice(begin, min(stop, begin + 65_536) - begin)
            begin += b.num_rows
            yield b.select(["a", "b"]).filter(pa.array(similar(b.column(2), b.column(3), percent)))


def _linked(lines: DataFrame, pairs: DataFrame, percent: int = 80) -> DataFrame:
    """Those of the pairs (a, b, block) of line ids that are similar, as (a, b)."""
    both = with_sides(pairs, lines, ["line"]).select("a", "b", "a_line", "b_line")
    return both.mapInArrow(lambda batches: verified(batches, percent), "a long, b long")


def _hashes(lines: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct shingles of (id, line) rows, one line after the other, and how many each has."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for piece in X.slices(lines.select(["id", "line"]).to_batches(), VERIFIED):
        raw = piece.column("line").to_pylist()
        ends = np.cumsum([len(x) for x in raw])
        value, bounds = _shingles(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]], ends)
        both = H.distinct(np.repeat(np.arange(len(raw), dtype=np.uint64) << np.uint64(48), np.diff(bounds)) | (H.mix(value) >> np.uint64(16)))
        hashes.append(both & np.uint64((1 << 48) - 1))
        counts.append(np.bincount((both >> np.uint64(48)).astype(np.int64), minlength=len(raw)))
    return np.concatenate(hashes), np.concatenate(counts)


def kept_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(line, check, doc_id, number): of each line that is repeated or similar to another one, the occurrence that stays for its component."""
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(_candidates(keyed))
    pairs = found.where("kind = 0").select("a", "b").distinct()
    members = found.where("kind = 1").select(F.col("a").alias("part"), F.col("b").alias("id"))
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.select("id")).distinct())
    lines = _lines(keyed, ids)
    joined = link_groups(pairs.limit(0), pairs, members, lambda p: _linked(lines, p, percent), lambda rest: rarest.across(lines.select("id", "line"), rest, "line", _hashes, percent))
    similar_lines = written(lines.drop("line").join(joined, "id"))
    first = similar_lines.groupBy("component").agg(F.min(F.struct("doc_id", "number")).alias("first"))
    fuzzy = similar_lines.drop("doc_id", "number").join(first, "component").select(F.col("id").alias("line"), "check", "first.doc_id", "first.number")
    again = found.where("kind = 2").select(F.col("a").alias("line"), F.col("b").alias("check"), "doc_id", "number")
    return written(again.join(similar_lines.select(F.col("id").alias("line"), "check"), ["line", "check"], "left_anti").unionByName(fuzzy))


def remove_lines(docs: DataFrame, percent: int = 80, report: bool = True) -> DataFrame:
    """docs with the kept lines as text, and n_lines, n_removed and kept_sha256 besides; without a report the caller's columns of these names stay."""
    docs = (docs.drop("n_lines", "n_removed", "kept_sha256") if report else docs).withColumn("text", F.col("text").cast("string"))
    n_shards = X.shards(docs)
    packed = X.pack(docs)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def filled(table: pa.Table):
        """Of the filled lines in rows with a key: row, number, doc_id; the distinct lines among them, and which one each is."""
        keys = table.column("doc_id").combine_chunks().cast(pa.int64())
        at = np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False))
        buf, start, end, row, number = line_spans(table.column("text").take(pa.array(at)))
        own = np.flatnonzero(end > start)
        start, end, row, number = start[own], end[own], row[own], number[own]
        ids, check = line_ids(buf, start, end)
        order = _by_two(ids, check)
        new = np.r_[True, (ids[order[1:]] != ids[order[:-1]]) | (check[order[1:]] != check[order[:-1]])][: len(order)]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        ids, check = ids[order[new]], check[order[new]]
        doc = keys.take(pa.array(at)).to_numpy()[row]
        return at[row], number, doc, ids, check, which, X.by_shard((ids % n_shards).astype(np.int64), n_shards)

    def ask(table: pa.Table):
        _, _, _, ids, check, _, (order, bounds) = filled(table)
        for s in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[s] : bounds[s + 1]]
            yield int(s), X.dump(X.dump_sorted(ids[own].view(np.uint64)), check[own])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((b.column(0).to_numpy() % n_shards).astype(np.int32)), *b.columns], ["shard", "line", "check", "doc_id", "number"])

    def answer(requests: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("line", "ascending"), ("check", "ascending")])
        line, check, doc, number = (rows.column(c).to_numpy() for c in ("line", "check", "doc_id", "number"))
        out = []
        for batch, shard, body in zip(*(requests.column(c).to_pylist() for c in ("batch", "shard", "body")), strict=True):
            planes, asked = X.load(body, np.uint8, np.int64)
            ids = X.load_sorted(planes).view(np.int64)
            begin, end = np.searchsorted(line, ids), np.searchsorted(line, ids, side="right")
            at = np.full(len(ids), -1)
            for step in range(int((end - begin).max(initial=0))):  # more than one only where the ids of different lines are equal
                there = np.flatnonzero(begin + step < end)
                hit = there[check[begin[there] + step] == asked[there]]
                at[hit] = begin[hit] + step
            some = np.flatnonzero(at >= 0)
            if len(some):
                out.append((batch, shard, X.dump(some.astype(np.uint32), doc[at[some]], number[at[some]])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["batch", "shard", "body"])

    sharded = kept_lines(docs, percent).mapInArrow(dealt, "shard int, line long, check long, doc_id long, number long")
    replies = X.ask(packed, ask).groupBy("shard").cogroup(sharded.groupBy("shard")).applyInArrow(answer, X.REPLY)

    def settle(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        row, number, doc, ids, _, which, (order, bounds) = filled(table)
        known, kept_doc, kept_number = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for s, body in replies.items():
            some, d, n = X.load(body, np.uint32, np.int64, np.int64)
            at = order[bounds[s] + some]
            known[at], kept_doc[at], kept_number[at] = True, d, n
        gone = np.flatnonzero(known[which] & ((kept_doc[which] != doc) | (kept_number[which] != number)))
        texts = table.column("text").to_pylist()
        n_lines = [0 if t is None else t.count("\n") + 1 for t in texts]
        n_removed = np.bincount(row[gone], minlength=len(texts))
        for r, some in zip(*_grouped(row[gone], number[gone]), strict=True):
            out = set(some.tolist())
            texts[r] = "\n".join(x for i, x in enumerate(texts[r].split("\n")) if i not in out)
        out = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        if not report:
            return out
        sha = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
        return out.append_column("n_lines", pa.array(n_lines, pa.int64())).append_column("n_removed", pa.array(n_removed)).append_column("kept_sha256", pa.array(sha, pa.string()))

    return X.settle(packed, replies, settle, f"{types}, n_lines long, n_removed long, kept_sha256 string" if report else types)


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct keys, and the values of each."""
    order = np.argsort(keys, kind="stable")
    every, begin = np.unique(keys[order], return_index=True)
    return every.tolist(), np.split(values[order], begin[1:]) if len(every) else []
