"""Candidate pairs across components by the rarest shingles of each set.

Sets that are similar share one of the n - 0.8 n + 1 rarest shingles of each, by one
order of all shingles: by their number of sets, then by value. Where a common passage
fills most of a set, these are the shingles beside it. Batches of sets ask shards how
many sets have each of their distinct shingles, and whether these sets are of several
components. Sets are made of their texts in a batch, and the components come to it by key, so no
set is shuffled; only such shingles among the rarest are sent on, so a large group of
copies that is one component already sends none of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as X
from tidemark.llm import hashing as H
from tidemark.llm.filtering import marked
from tidemark.llm.storage import written

#: Marks a shingle of several components in a reply.
ACROSS = np.uint32(1 << 31)
#: Bits of a shingle's hash that are sent; others choose its shard. Shingles that agree in all of them are counted together, by every batch, which leaves one order for all sets.
KEY_BITS = 32


def across(texts: DataFrame, nodes: DataFrame, text: str, sets: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], percent: int = 80) -> DataFrame:
    """Candidate pairs (a, b) of different components among nodes (id, component), whose texts (id, text) are in files; sets gives the distinct hashes of the texts of a table's rows, row after row, and how many each has."""
    n_shards = X.shards(texts)
    packed = X.pack(marked(texts.select("id", text), nodes.select("id"), "id").where("tidemark_may_go").drop("tidemark_may_go"), key="id", text=text)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = X.unpack(body.as_py()).column("id").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), batch))], ["id", "batch"])

    def told(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        body = X.dump(table.column("id").to_numpy(), table.column("component").to_numpy())
        return pa.Table.from_arrays([table.column("batch")[:1], pa.array([X.KEPT], pa.int32()), pa.array([body], pa.binary())], ["batch", "shard", "body"])

    inbox = packed.mapInArrow(members, "id long, batch long").distinct().join(nodes, "id").groupBy("batch").applyInArrow(told, X.REPLY)

    def chosen(table: pa.Table, replies: dict[int, bytes]) -> tuple[pa.Table, np.ndarray]:
        """The rows of a batch that are nodes, and their components."""
        if X.KEPT not in replies:
            return table.slice(0, 0), np.zeros(0, np.int64)
        ids, component = X.load(replies[X.KEPT], np.int64, np.int64)
        own = table.column("id").to_numpy()
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        some = np.flatnonzero(ids[at] == own)
        return table.take(pa.array(some)), component[at[some]]

    def distinct(table: pa.Table):
        h, n = sets(table)
        every, which = np.unique(h, return_inverse=True)
        code = H.mix(every)
        key = code // np.uint64(n_shards) & np.uint64((1 << KEY_BITS) - 1)
        by_key = np.argsort(key)
        order, bounds = X.by_shard((code[by_key] % np.uint64(n_shards)).astype(np.int64), n_shards)
        order = by_key[order]
        return n, every, which, key, [order[bounds[s] : bounds[s + 1]] for s in range(n_shards)]

    def ask(table: pa.Table, replies: dict[int, bytes]):
        table, component = chosen(table, replies)
        n, every, which, key, own = distinct(table)
        yield X.KEPT, replies.get(X.KEPT, b"")
        mine = (H.mix(component.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)[np.repeat(np.arange(len(n)), n)]
        low, high = np.full(len(every), 0xFFFFFFFF, np.uint32), np.zeros(len(every), np.uint32)
        np.minimum.at(low, which, mine)
        np.maximum.at(high, which, mine)
        times = np.bincount(which, minlength=len(every)).astype(np.uint32)
        for s, at in enumerate(own):
            if len(at):
                yield s, X.dump(X.dump_sorted(key[at]), times[at], low[at], high[at] ^ low[at])

    def answer(bodies: list[bytes]) -> list[bytes]:
        got = [X.load(b, np.uint8, np.uint32, np.uint32, np.uint32) for b in bodies]
        key = [X.load_sorted(g[0]) for g in got]
        times, low, apart = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
        known, which = np.unique(np.concatenate(key), return_inverse=True)
        total = np.minimum(np.bincount(which, times, len(known)), int(ACROSS) - 1).astype(np.uint32)
        least, most = np.full(len(known), 0xFFFFFFFF, np.uint32), np.zeros(len(known), np.uint32)
        np.minimum.at(least, which, low)
        np.maximum.at(most, which, low ^ apart)
        total[least != most] |= ACROSS
        return [X.dump(x) for x in np.split(total[which], np.cumsum([len(k) for k in key])[:-1])]

    def settle(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        if not replies.get(X.KEPT):
            replies = {}
        table, component = chosen(table, replies)
        n, every, which, _, own = distinct(table)
        sets_of = np.zeros(len(every), np.uint32)
        for s, at in enumerate(own):
            if len(at):
                sets_of[at] = X.load(replies[s], np.uint32)[0]
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((every[which], sets_of[which] & ~ACROSS, row))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
        at = np.flatnonzero((rank <= (n - (n * percent + 99) // 100 + 1)[row]) & ((sets_of[which[order]] & ACROSS) > 0))
        columns = [pa.array(every[which[order[at]]].view(np.int64)), table.column("id").take(pa.array(row[at])), pa.array(component[row[at]]), pa.array(n[row[at]]), pa.array(rank[at])]
        return pa.Table.from_arrays(columns, ["shingle", "a", "component", "n", "rank"])

    first = written(X.settle(packed, X.answer(X.ask_again(packed, inbox, ask), answer), settle, "shingle long, a long, component long, n long, rank long"))
    other = first.select("shingle", F.col("a").alias("b"), F.col("component").alias("component_b"), F.col("n").alias("n_b"), F.col("rank").alias("rank_b"))
    # With their first common shingle at these ranks, sets have one more in common than what is left of the shorter rest.
    left = 1 + F.least(F.col("n") - F.col("rank"), F.col("n_b") - F.col("rank_b"))
    fit = left * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent
    return first.join(other, "shingle").where(F.expr("a < b and component <> component_b") & fit).select("a", "b").distinct()
