"""Batch-and-shard exchange: how operators look up facts about the whole corpus.

Documents are packed into bounded, compressed batches. A batch asks shards about
its *distinct* keys (hashes of windows, chunks, n-grams ...), so a key that holds
a third of the corpus still costs a shard one entry a batch. Shards are chosen by
a second, independent hash and combine what all batches sent; their replies go
back to the batch, which still has its texts. Each shard and each batch is a
bounded task; nothing passes through the driver, and a lost task is computed anew
from its shuffle input.

The input has to be replayable in the same order (files, or a checkpoint).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a batch. Requests of a batch to a shard shrink with the number of shards; raise it with the corpus.
BATCH_BYTES = 2 << 20

#: Not a shard: notes of a batch for its next round.
KEPT = -1

PACKED = "batch long, body binary"
REQUEST = "shard int, batch long, body binary"
REPLY = "batch long, shard int, body binary"


def shards(df: DataFrame) -> int:
    """Four shards for each shuffle partition, which a cluster sizes to its data."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@functools.lru_cache(maxsize=None)
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@functools.lru_cache(maxsize=None)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeeze(data: bytes, level: int = 1) -> bytes:
    return _compressor(level).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return _decompressor().decompress(data)


def dump(*arrays: np.ndarray) -> bytes:
    """Several arrays as one compressed body: how many, the bytes of each, and each from a multiple of 8 bytes on."""
    parts = [a.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return squeeze(b"".join([head, *(p + bytes(-len(p) % 8) for p in parts)]))


def load(body: bytes, *types) -> list[np.ndarray]:
    """The first arrays of a body, of these types."""
    raw = unsqueeze(body)
    n = int.from_bytes(raw[:8], "little")
    at, out = 8 * (n + 1), []
    for size, t in zip(np.frombuffer(raw, np.int64, n, 8).tolist(), types, strict=False):
        out.append(np.frombuffer(raw, t, size // np.dtype(t).itemsize, at))
        at += size + -size % 8
    return out


def dump_sorted(keys: np.ndarray) -> np.ndarray:
    """Sorted 64-bit keys as byte planes of their steps, which compress to what the steps need."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).ravel()


def load_sorted(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(batch, body): bounded batches of the rows of docs, dealt out by batch.

    Rows of a batch are in order of the key, nulls last.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.sort_by([(key, "ascending")])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            out = pa.RecordBatch.from_pydict({"batch": pa.array([part + seq], pa.int64()), "body": pa.array([squeeze(sink.getvalue(), 3)], pa.binary())})
            held, size, seq = [], 0, seq + 1
            return out

        for b in batches:
            ends = np.cumsum(_lengths(b, text))
            begin = 0
            while begin < b.num_rows:
                before = ends[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, before + batch_bytes - size, side="right")))
                held.append(b.slice(begin, stop - begin))
                size += int(ends[stop - 1] - before)
                begin = stop
                if size >= batch_bytes or begin < b.num_rows or sum(x.num_rows for x in held) >= 50_000:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(packed, PACKED).repartition(F.col("batch"))


def _lengths(b: pa.RecordBatch, text: str) -> np.ndarray:
    return pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) rows with about size bytes of text, and at most 1024 of them, at a time."""
    for b in batches:
        ends = np.cumsum(_lengths(b, b.schema.names[1]))
        begin = 0
        while begin < b.num_rows:
            before = ends[begin - 1] if begin else 0
            stop = min(begin + 1024, max(begin + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(begin, stop - begin)
            begin = stop


def unpack(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(unsqueeze(body)).read_all()


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def ask(packed: DataFrame, fn: Callable[[pa.Table], Iterable[tuple[int, bytes]]], read: Callable[[bytes], object] = unpack) -> DataFrame:
    """fn gets a batch's rows, or what else read makes of a body, and yields (shard, body) requests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield _rows(["shard", "batch", "body"], [pa.int32(), pa.int64(), pa.binary()], [(s, batch, x) for s, x in fn(read(body.as_py()))])

    return packed.mapInArrow(run, REQUEST)


def ask_again(packed: DataFrame, replies: DataFrame, fn: Callable[[pa.Table, dict[int, bytes]], Iterable[tuple[int, bytes]]], read: Callable[[bytes], object] = unpack) -> DataFrame:
    """As ask, for a later round: fn also gets the replies that the batch has had.

    What fn yields for the shard KEPT comes back with the replies, under KEPT.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        batch = key[0].as_py()
        rows = [(s if s != KEPT else KEPT - 1 - batch % 100_003, batch, x) for s, x in fn(*_met(left, right, read))]
        return pa.Table.from_batches([_rows(["shard", "batch", "body"], [pa.int32(), pa.int64(), pa.binary()], rows)])

    return packed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(run, REQUEST)


def answer(requests: DataFrame, fn: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """fn gets all requests to a shard and gives a reply to each, or None."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:
            return table.select(["batch", "shard", "body"]).set_column(1, "shard", pa.array([KEPT] * table.num_rows, pa.int32()))
        table = table.sort_by([("batch", "ascending")])
        got = fn(table.column("body").to_pylist())
        rows = [(b, s, x) for b, s, x in zip(table.column("batch").to_pylist(), table.column("shard").to_pylist(), got, strict=True) if x is not None]
        return pa.Table.from_batches([_rows(["batch", "shard", "body"], [pa.int64(), pa.int32(), pa.binary()], rows)])

    return requests.groupBy("shard").applyInArrow(run, REPLY)


def _met(left: pa.Table, right: pa.Table, read: Callable[[bytes], object]) -> tuple:
    return read(left.column("body")[0].as_py()), dict(zip(right.column("shard").to_pylist(), right.column("body").to_pylist(), strict=True))


def settle(packed: DataFrame, replies: DataFrame, fn: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema: str, read: Callable[[bytes], object] = unpack) -> DataFrame:
    """fn gets a batch's rows with the replies by shard and makes the result's rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(*_met(left, right, read))

    return packed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(run, schema)


def by_shard(shard: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by shard, and the n + 1 bounds of the shards in it."""
    order = np.argsort(shard.astype(np.uint16 if n < 1 << 16 else np.uint32), kind="stable")
    return order, np.searchsorted(shard[order], np.arange(n + 1))
