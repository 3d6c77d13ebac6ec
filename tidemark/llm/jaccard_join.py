"""N-gram Jaccard join by parity sketches.

A document's set is its distinct 5-word shingles. In a size band every shingle flips
one bit of a sketch of P parts, so the Hamming distance of two sketches is at most
the symmetric difference d of the sets. A Jaccard similarity of at least 0.8 means
d <= (|A| + |B|) / 9, which is bounded in the band: with P = D + 1 + r parts, where
D bounds d, at least r + 1 parts of the two sketches are equal (pigeonhole). Parts
are 2**20 bits wide and are held as one XOR code of the bits that are set. A set is in its
own band and, where a similar one may be in the next band, in that as well.

Documents with equal sets are one class, found first by a code of 128 bits; only its smallest
document goes on. Equal parts meet in shards. Of a part that at most ``HOT`` documents share, all pairs
are counted; a pair can only be similar when it shares r + 1 parts, less those of
its parts that are empty or hot, so chance pairs never reach the exact check. A
document of which at most r parts are empty or hot is sure to meet every partner in
a part that is not, so hot parts (a common line, a large group) need only be looked at for
the others, and of those only the ones beyond r, the rarest: there each is first checked
against the smallest document of the part; documents of such parts that are still in
different components meet by the rarest fifth of their shingles. The texts of these documents are
stored where their parts are known, and sets are made of them where they are needed.
Every candidate is verified by the exact intersection of the sets.

Defined results: with fewer than five words the whole sequence is the one shingle; a null
or empty text has no shingles and links with nothing; texts may be of any length; rows with equal doc_id count as one
document with the links of all, and each row is returned with its own n_shingles; rows with
a null doc_id link with nothing and have a null component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import rarest
from tidemark.llm import exchange as X
from tidemark.llm import hashing as H
from tidemark.llm.components import link_groups, with_sides
from tidemark.llm.filtering import only, without
from tidemark.llm.storage import let_go, scratch, written

#: Members of a part of which all pairs are counted.
HOT = 16
WIDTH_BITS = 20
#: Bits of a shingle's hash, beside the row in a slice of at most 1024.
HASH_BITS = 54
#: Bits of a part's code that are sent; others choose its shard.
CODE_BITS = 48
#: Least and most bits of the compact sketch that candidates are compared by before their sets are; between, two for each shingle.
SKETCH_BITS = (64, 4096)
#: Size bands grow by this ratio.
BAND = (5, 3)


def _bands(n: int) -> np.ndarray:
    """Lower ends of the size bands up to n and two more; similar sets are in the same band or in neighbouring ones."""
    low = [1]
    while low[-1] <= n:
        low.append(low[-1] * BAND[0] // BAND[1] + 1)
    for _ in range(2):
        low.append(low[-1] * BAND[0] // BAND[1] + 1)
    return np.array(low)


def sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as (row, hash) sorted by row, the number a row, and a 128-bit code of each row's set as two columns; 1024 texts at most."""
    buf, offsets = H.flat(texts, lower=True)
    start, end, row = H.word_spans(buf, offsets)
    words = H.range_hash(buf, start, end)
    at, h = H.windows(words, row, k)
    n_words = np.bincount(row, minlength=len(texts))
    first = np.searchsorted(row, np.arange(len(texts)))
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    h = np.r_[h, H.range_hash(words, first[short], first[short] + n_words[short])]
    row = np.r_[row[at], short]
    # one sort of numbers that hold the row and 54 bits of the hash
    both = H.distinct((row.astype(np.uint64) << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS)))
    row, h = (both >> np.uint64(HASH_BITS)).astype(np.int64), both & np.uint64((1 << HASH_BITS) - 1)
    n = np.bincount(row, minlength=len(texts))
    bounds = np.r_[0, np.cumsum(n)]
    code = np.empty((len(texts), 2), np.uint64)
    for lane, salt in enumerate((0x51ED270B, 0xA0761D6478BD642F)):
        total = np.r_[np.uint64(0), np.cumsum(H.mix(h + np.uint64(salt)), dtype=np.uint64)]
        code[:, lane] = H.mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return row, h, n, code


def parts(h: np.ndarray, n: np.ndarray):
    """The parts of rows with n hashes each, for their own bands and the next ones: (entries, entry, code).

    entries: row, whether the row is below the level's own band, how many of its emitted parts may be hot,
    and how many parts a similar pair shares of those that are sent. entry and code are those of each part.
    """
    low = _bands(int(n.max(initial=1)))
    band = np.searchsorted(low, n, side="right") - 1
    row = np.repeat(np.arange(len(n)), n)
    entries, entry_of, codes = [np.zeros((0, 4), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    count = 0
    for up in (0, 1):
        level = band + up
        most = 2 * (low[level + 1] - 1) // 9
        wanted = (n > 0) & (most > 0) & ((5 * n >= 4 * low[level]) | (up == 0))
        some = np.flatnonzero(wanted)
        if not len(some):
            continue
        n_parts = most + 1 + (most + 1) // 5 + 3
        spare = n_parts - most - 1
        shingles = row[wanted[row]]
        own = h[wanted[row]]
        x = H.mix(own ^ (level[shingles].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        part = ((x >> np.uint64(32)) * n_parts[shingles].astype(np.uint64)) >> np.uint64(32)
        bit = H.mix((x & np.uint64((1 << WIDTH_BITS) - 1)) + np.uint64(0x632BE59BD9B4E019))
        begin = np.r_[0, np.cumsum(n_parts[some])]
        place = np.repeat(np.arange(len(some)), n[some])
        slot = begin[place] + part.astype(np.int64)
        word = np.zeros(begin[-1], np.uint64)
        np.bitwise_xor.at(word, slot, bit)
        owner = np.repeat(np.arange(len(some)), n_parts[some])
        empty = np.bincount(owner[word == 0], minlength=len(some))
        said = empty <= spare[some] // 2  # then empty parts needn't be sent
        sent = (word != 0) | ~said[owner]
        key = H.mix(word + H.mix((np.arange(len(word)) - begin[owner]).astype(np.uint64) * np.uint64(1 << 16) + level[some][owner].astype(np.uint64)))
        may_miss = np.where(said, spare[some] - empty, spare[some] - spare[some] // 2)
        entries.append(np.stack([some, np.full(len(some), up), may_miss, spare[some] + 1 - spare[some] // 2], axis=1))
        entry_of.append(owner[sent] + count)
        codes.append(key[sent])
        count += len(some)
    return np.concatenate(entries), np.concatenate(entry_of), np.concatenate(codes)


class View:
    """The sets of a batch of (doc_id, text) rows."""

    def __init__(self, table: pa.Table, k: int):
        rows, self.h, n, code = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)]
        for b in X.slices(table.to_batches(), 1 << 20):
            _, h, m, c = sets(b.column(1), k)
            self.h.append(h)
            n.append(m)
            code.append(c)
        self.h, self.n, self.code = np.concatenate(self.h), np.concatenate(n), np.concatenate(code)
        self.ids = table.column("doc_id").to_numpy()
        order = np.lexsort((self.code[:, 1], self.code[:, 0]))
        a, b = self.code[order, 0], self.code[order, 1]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(order)]
        self.which = np.empty(len(order), np.int64)  # the class of each row
        self.which[order] = np.cumsum(new) - 1
        self.classes = self.code[order[new]]

    def by_shard(self, n_shards: int):
        return X.by_shard((self.classes[:, 0] % np.uint64(n_shards)).astype(np.int64), n_shards)

    def parts(self, least: np.ndarray, n_shards: int):
        """Entries and parts of the rows that are the smallest of their class, and the parts by shard and code."""
        rep = np.flatnonzero((self.n > 0) & (least[self.which] == self.ids))
        chosen = np.zeros(len(self.n), bool)
        chosen[rep] = True
        entries, entry, code = parts(self.h[np.repeat(chosen, self.n)], self.n[rep])
        entries[:, 0] = rep[entries[:, 0]]
        short = (code // np.uint64(n_shards)) & np.uint64((1 << CODE_BITS) - 1)
        by_code = np.argsort(short)
        order, bounds = X.by_shard((code[by_code] % np.uint64(n_shards)).astype(np.int64), n_shards)
        return entries, entry, short, by_code[order], bounds


def _nodes(batch: int, entry: np.ndarray, below: np.ndarray) -> np.ndarray:
    """A number for each entry of a batch, odd where it is below the level's own band."""
    return ((batch >> 32) << 40 | (batch & 0xFFFFFFFF) << 18) + 2 * entry + below


def _met(docs: DataFrame, k: int) -> DataFrame:
    """(kind, a, b, c, d), all that batches and shards find out: 0 pairs of nodes (a, b, n shared); 1 nodes (node, doc_id, hot parts, needed);
    2 documents (doc_id, n_shingles, smallest equal one or null); 3 hot parts (part, doc_id) that a document may not leave out;
    4 documents of those (doc_id, n_shingles), with sketch and text."""
    n_shards = X.shards(docs)
    packed = X.pack(docs)

    def classes(table: pa.Table):
        v = View(table, k)
        least = np.full(len(v.classes), np.iinfo(np.int64).max)
        np.minimum.at(least, v.which, v.ids)
        order, bounds = v.by_shard(n_shards)
        for s in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[s] : bounds[s + 1]]
            yield int(s), X.dump(v.classes[own].ravel(), least[own])

    def least_of(bodies: list[bytes]) -> list[bytes]:
        got = [X.load(b, np.uint64, np.int64) for b in bodies]
        code, ids = np.concatenate([g[0].reshape(-1, 2) for g in got]), np.concatenate([g[1] for g in got])
        order = np.lexsort((ids, code[:, 1], code[:, 0]))
        a, b = code[order, 0], code[order, 1]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        least = np.empty(len(ids), np.int64)
        least[order] = ids[order[new]][np.cumsum(new) - 1]
        return [X.dump(x) for x in np.split(least, np.cumsum([len(g[1]) for g in got])[:-1])]

    def send(table: pa.Table, replies: dict[int, bytes]):
        v = View(table, k)
        least = np.zeros(len(v.classes), np.int64)
        order, bounds = v.by_shard(n_shards)
        for s, body in replies.items():
            least[order[bounds[s] : bounds[s + 1]]] = X.load(body, np.int64)[0]
        yield X.KEPT, X.dump(least)
        entries, entry, short, order, bounds = v.parts(least, n_shards)
        for s in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[s] : bounds[s + 1]]
            yield int(s), X.dump(X.dump_sorted(short[own]), np.ascontiguousarray((2 * entry[own] + entries[entry[own], 1]).astype(np.uint32).view(np.uint8).reshape(-1, 4).T).ravel())

    def meet(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:
            return table.select(["batch", "shard", "body"]).set_column(1, "shard", pa.array([X.KEPT] * table.num_rows, pa.int32()))
        shard, batches, got = table.column("shard")[0].as_py(), table.column("batch").to_pylist(), [X.load(b, np.uint8, np.uint8) for b in table.column("body").to_pylist()]
        key = np.concatenate([X.load_sorted(g[0]) for g in got])
        entry = [np.ascontiguousarray(g[1].reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64) for g in got]
        node = np.concatenate([_nodes(b, e >> 1, e & 1) for b, e in zip(batches, entry, strict=True)])
        order = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        size = np.diff(np.r_[begins, len(key)])
        none_own = np.minimum.reduceat(node[order] & 1, begins) > 0  # all are below the level's band and meet in their own
        size[none_own] = 0
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in range(2, HOT + 1):  # all groups of one size together
            members = order[begins[size == g][:, None] + np.arange(g)]
            i, j = np.triu_indices(g, 1)
            x, y = node[members[:, i].ravel()], node[members[:, j].ravel()]
            ok = (x & y & 1) == 0
            a.append(np.minimum(x, y)[ok])
            b.append(np.maximum(x, y)[ok])
        a, b = np.concatenate(a), np.concatenate(b)
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
        members = np.zeros(len(key), np.uint32)
        members[order] = np.repeat(np.where(size > HOT, size, 0), np.diff(np.r_[begins, len(key)]))
        out = [X.dump(x) if x.any() else None for x in np.split(members, np.cumsum([len(e) for e in entry])[:-1])]
        rows = [(n, shard, x) for n, x in zip(batches, out, strict=True) if x is not None]
        if len(new):
            rows.append((-1 - shard, shard, X.dump(a[new], b[new], np.diff(np.r_[new, len(a)]))))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["batch", "shard", "body"])

    def told(kind: int, *columns: np.ndarray) -> pa.Table:
        arrays = [pa.array(np.full(len(columns[0]), kind)), *(c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in columns)]
        zeros = [pa.array(np.zeros(len(columns[0]), np.int64))] * (4 - len(columns))
        none = [pa.nulls(len(columns[0]), pa.binary()), pa.nulls(len(columns[0]), pa.string())]
        return pa.Table.from_arrays([*arrays, *zeros, *none], ["kind", "a", "b", "c", "d", "sketch", "text"])

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        bodies = dict(zip(right.column("shard").to_pylist(), right.column("body").to_pylist(), strict=True))
        if not left.num_rows:  # pairs from a shard
            return pa.concat_tables([told(0, *X.load(x, np.int64, np.int64, np.int64)) for x in bodies.values()])
        table = X.unpack(left.column("body")[0].as_py())
        v, batch = View(table, k), left.column("batch")[0].as_py()
        least = X.load(bodies.pop(X.KEPT), np.int64)[0]
        entries, entry, short, order, bounds = v.parts(least, n_shards)
        members, shard = np.zeros(len(entry), np.int64), np.zeros(len(entry), np.uint64)
        for s, body in bodies.items():
            own = order[bounds[s] : bounds[s + 1]]
            members[own], shard[own] = X.load(body, np.uint32)[0], s
        hot = np.flatnonzero(members)
        n_hot = np.bincount(entry[hot], minlength=len(entries))
        # Of its hot parts a document may leave out as many as it has to spare, the most common first: a partner leaves out
        # by the same order, so the rarest part that they share is left in both.
        hot = hot[(n_hot > entries[:, 2])[entry[hot]]]
        part = H.mix(short[hot] * np.uint64(n_shards) + shard[hot]).view(np.int64)
        by = np.lexsort((part, -members[hot], entry[hot]))
        hot, part = hot[by], part[by]
        rank = np.arange(len(hot)) - np.searchsorted(entry[hot], entry[hot])
        stay = rank >= entries[entry[hot], 2]
        doc = v.ids[entries[:, 0]]
        rep = least[v.which]
        some = np.unique(entries[entry[hot[stay]], 0])
        chosen = np.zeros(len(v.n), bool)
        chosen[some] = True
        texts = table.column("text").take(pa.array(some)).cast(pa.string()).combine_chunks()
        return pa.concat_tables([
            told(1, _nodes(batch, np.arange(len(entries)), entries[:, 1]), doc, n_hot, entries[:, 3]),
            told(2, v.ids, v.n, pa.array(rep, mask=v.n == 0)),
            told(3, part[stay], doc[entry[hot[stay]]]),
            told(4, v.ids[some], v.n[some]).set_column(5, "sketch", pa.array(sketches(v.h[np.repeat(chosen, v.n)], v.n[some]), pa.binary())).set_column(6, "text", texts),
        ])

    mail = X.answer(X.ask(packed, classes), least_of)
    mail = X.ask_again(packed, mail, send).groupBy("shard").applyInArrow(meet, X.REPLY)
    return packed.groupBy("batch").cogroup(mail.groupBy("batch")).applyInArrow(settle, "kind long, a long, b long, c long, d long, sketch binary, text string")


def sketches(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity sketches of rows with n hashes each: of two rows, cut to the shorter by XOR of its parts, they differ in no more bits than the sets in hashes."""
    bits = np.clip(np.int64(1) << np.ceil(np.log2(2 * np.maximum(n, 1))).astype(np.int64), *SKETCH_BITS)
    begin = np.r_[0, np.cumsum(bits)]
    at = np.repeat(begin[:-1], n) + (H.mix(h) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    flat = np.packbits((np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8)).tobytes()
    return [flat[x:y] for x, y in zip((begin[:-1] // 8).tolist(), (begin[1:] // 8).tolist(), strict=True)]


def apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many bits the sketches of each pair differ."""
    width = np.array([[len(x), len(y)] for x, y in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(left), np.int64)
    for pair in np.unique(width, axis=0):
        at = np.flatnonzero((width == pair).all(axis=1))
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join([side[i] for i in at]), np.uint64).reshape(len(at), -1, pair.min() // 8), axis=1) for side in (left, right))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, sketch, text) of the documents that have shingles."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in X.slices(batches, 1 << 20):
            _, h, n, _ = sets(b.column(1), k)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(n[some]), pa.array(sketches(h, n[some]), pa.binary()), b.column(1).take(pa.array(some)).cast(pa.string())], ["id", "n", "sketch", "text"])

    return docs.mapInArrow(emit, "id long, n long, sketch binary, text string")


def _linked(known: DataFrame, pairs: DataFrame, k: int, percent: int = 80) -> DataFrame:
    """Those of the pairs (a, b, block) that are similar, by the exact intersection of their sets; those that the sketches show to be too far apart never send their texts."""
    sketched = with_sides(pairs, known, ["n", "sketch"]).select("a", "b", "block", "a_n", "b_n", "a_sketch", "b_sketch")

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = b.column(3).to_numpy() + b.column(4).to_numpy()
            keep = (100 + percent) * apart(b.column(5).to_pylist(), b.column(6).to_pylist()) <= (100 - percent) * both  # the symmetric difference is the Jaccard distance of the union
            yield b.select(["a", "b", "block"]).filter(pa.array(keep))

    left = written(sketched.mapInArrow(may, "a long, b long, block int"))
    both = with_sides(left, known, ["text"]).select("a", "b", "a_text", "b_text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                b = whole.slice(begin, 256)
                key, size = [], np.zeros(b.num_rows, np.int64)
                for side in (2, 3):
                    row, h, n, _ = sets(b.column(side), k)
                    key.append(row.astype(np.uint64) << np.uint64(HASH_BITS) | h)
                    size += n
                key = np.sort(np.concatenate(key))
                common = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(HASH_BITS)).astype(np.int64), minlength=b.num_rows)
                yield b.select(["a", "b"]).filter(pa.array(100 * common >= percent * (size - common)))

    return both.mapInArrow(verify, "a long, b long").distinct()


def _hashes(texts: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the sets of (id, text) rows, one after the other, and how many each has."""
    got = [sets(b.column(1), k)[1:3] for b in X.slices(texts.to_batches(), 1 << 20)]
    return np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in got)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in got)])


def similar_documents(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.where("doc_id is not null")
    found = written(_met(keyed, k))
    let_go(docs.sparkSession)
    every = found.where("kind = 2").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("least"))
    nodes = lambda c: found.where("kind = 1").select(F.col("a").alias(f"{c}_node"), F.col("b").alias(c), F.col("c").alias(f"{c}_hot"), F.col("d").alias("needed"))
    with scratch(docs.sparkSession) as held:
        pairs = held(found.where("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("n")).select(F.col("a").alias("a_node"), F.col("b").alias("b_node"), "n"))
        # A similar pair shares at least r + 1 parts; those that are empty or hot are not counted in n, and of those that count at least one is left.
        likely = pairs.join(nodes("a"), "a_node").join(nodes("b").drop("needed"), "b_node")
        likely = likely.where(F.col("n") >= F.greatest(F.lit(1), F.col("needed") - F.least("a_hot", "b_hot"))).where("a <> b")
        candidates = held(likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        unsafe = found.where("kind = 3").select(F.col("a").alias("part"), F.col("b").alias("id"))
        equal = every.where("least <> doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
        sides = candidates.select(F.col("a").alias("id")).unionByName(candidates.select(F.col("b").alias("id"))).distinct()
        stored = unsafe.select("id").distinct()
        # Of a doc_id that several rows have, stored is only what is in a hot part; such a document is stored again with all its rows.
        again = every.groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
        more = sides.join(stored, "id", "left_anti").unionByName(again.join(sides.unionByName(stored), "id", "left_semi"))
        known = found.where("kind = 4").select(F.col("a").alias("id"), F.col("b").alias("n"), "sketch", "text").unionByName(held(_sketched(only(keyed, more), k)))

        def rest(nodes: DataFrame) -> DataFrame:
            return rarest.across(known.select("id", "text"), nodes, "text", lambda texts: _hashes(texts, k))

        joined = link_groups(equal, candidates, unsafe, lambda pairs: _linked(known, pairs, k), rest)
    out = every.join(joined, every["doc_id"] == joined["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in X.slices(batches):
            n = sets(b.column(1), k)[2]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), b.column(0)], ["doc_id", "n_shingles", "component_id"])

    return out.unionByName(docs.where("doc_id is null").mapInArrow(describe, "doc_id long, n_shingles long, component_id long"))


def one_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs without those that are not the smallest of their group; rows with a null doc_id stay."""
    return without(docs, similar_documents(docs, k).where("component_id <> doc_id").select("doc_id"))
