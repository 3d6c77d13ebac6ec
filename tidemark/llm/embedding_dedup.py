"""Embedding near-dedup by Euclidean p-stable hashing with exact cosine checks.

Vectors are scaled to length 1, so a cosine of at least c is a distance of at most
sqrt(2 - 2c). A table's key is k quantised random projections floor((a.v + b) / w).
k grows with the logarithm of the number of vectors, so that a bucket holds a
bounded number of unrelated vectors; the number of tables follows from k and the
recall that is asked for at the threshold itself (nearer pairs are found more
surely). Pairs that share a bucket are checked by their exact cosine in double
precision, in blocks.

Equal vectors are one class from the start. A bucket of more than ``block`` members
is dealt out as pairs of blocks, so neither a hot bucket nor its pairs meet in one
task. A pair that shares several buckets counts in the first table only. Blocks give
counts per vector and a spanning forest, never all pairs.

A vector goes to a bucket in each table, and tables become more as vectors do. So the
numbers of shards, of their partitions and of the tasks that make keys follow the number
of these entries, not the shuffle partitions alone: a shard holds about ``SHARD`` entries,
a block is checked by itself, and keys are computed again only for vectors with a near one.
An entry carries its vector in a byte a number, with a bound of what that loses. Only
entries that can have a near one in their block by these bounds get the whole vector.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths never link; rows with
equal vec_id and vector count as separate rows in n_links; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components, forest
from tidemark.llm.storage import checkpoint

#: Width of a quantisation step, in units of the length-1 vectors.
WIDTH = 3.0
#: Entries (a vector in a bucket) in a shard, in a task that makes them, and in a batch of it; and pairs that are held at once.
SHARD, TASK, BATCH, PAIRS = 1 << 15, 1 << 18, 1 << 14, 1 << 14
#: Shards in a partition.
TOGETHER = 8


def same_step(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection of two vectors at that distance agrees."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(n: int, threshold: float, recall: float, bucket: int = 64) -> tuple[int, int]:
    """Projections a key (k) and tables for n vectors."""
    near, far = same_step(math.sqrt(2 - 2 * threshold)), same_step(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, bucket) / bucket) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


@functools.lru_cache(maxsize=4)
def _projections(dims: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dims])
    a = rng.standard_normal((dims, tables * k))
    b = rng.uniform(0, WIDTH, tables * k)
    odd = rng.integers(1, 1 << 62, size=(tables, k), dtype=np.int64) * 2 + 1
    return np.round(a * 2**16) / 2**16, b, odd.astype(np.uint64)


def _keys(unit: np.ndarray, k: int, tables: int, seed: int, first: int | None = None) -> np.ndarray:
    """64-bit keys, one column a table, of all or the first tables. Both factors have few digits, so that a sum is exact and a vector's keys don't depend on those beside it."""
    a, b, odd = _projections(unit.shape[1], k, tables, seed)
    tables = tables if first is None else first
    a, b, odd = np.ascontiguousarray(a[:, : tables * k]), b[: tables * k], odd[:tables]
    out, step = np.empty((len(unit), tables), np.int64), max(1, BATCH // tables)
    for at in range(0, len(unit), step):
        x = np.round(unit[at : at + step] * 2**20) / 2**20
        steps = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), tables, k)
        key = (steps.view(np.uint64) * odd).sum(axis=2, dtype=np.uint64)
        key ^= key >> np.uint64(29)
        out[at : at + step] = (key * np.uint64(0xBF58476D1CE4E5B9) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return out


def _raw(vector: list[float]) -> bytes:
    """In 4 bytes a number where that loses nothing, else in 8 and one more for the whole, by which the two are told apart."""
    v = np.array(vector, np.float64) + 0.0
    with np.errstate(over="ignore"):
        short = v.astype(np.float32)
    return short.tobytes() if (short == v).all() else v.tobytes() + b"\0"


def _dims(sizes: np.ndarray) -> np.ndarray:
    """Numbers in vectors of so many bytes."""
    return np.where(sizes % 2, sizes // 8, sizes // 4)


def _unit(raw: list[bytes]) -> np.ndarray:
    """Vectors of one size in bytes, scaled to length 1."""
    v = np.frombuffer(b"".join(x[:-1] for x in raw), np.float64) if len(raw[0]) % 2 else np.frombuffer(b"".join(raw), np.float32).astype(np.float64)
    v = v.reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _sketches(unit: np.ndarray) -> np.ndarray:
    """A row of bytes each: a step and a slack as 4-byte floats, then the numbers in steps.

    Two vectors' product is at most that of their sketches and both slacks: with errors e of length |e|, it is that
    product and at most |e| + |f| + 3 |e| |f|, and 2 |e| |f| <= |e|^2 + |f|^2.
    """
    step = (np.abs(unit).max(axis=1, keepdims=True) / 127).astype(np.float32)
    steps = np.rint(unit / step).clip(-127, 127)
    e = np.sqrt(((unit - steps * step) ** 2).sum(axis=1, keepdims=True))
    slack = (e + 1.5 * e * e).astype(np.float32)
    return np.hstack([step.view(np.uint8), slack.view(np.uint8), steps.astype(np.int8).view(np.uint8)])


def _blocks(shard: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of the two sides of each block of a bucket, or pair of blocks; the same array twice for a single block."""
    bucket, low, high, own = (shard.column(c).to_numpy() for c in ("bucket", "low", "high", "own"))
    order = np.lexsort((high, low, bucket))
    bucket, low, high = bucket[order], low[order], high[order]
    begins = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    ends = np.r_[begins[1:], len(order)]
    several = ends - begins > 1
    for begin, end in zip(begins[several].tolist(), ends[several].tolist(), strict=True):
        here = order[begin:end]
        if low[begin] == high[begin]:
            yield here, here
        else:
            yield here[own[here] == low[begin]], here[own[here] == high[begin]]


def promising(shard: pa.Table, threshold: float) -> pa.Table:
    """The entries of a shard that can have a near vector in their block."""
    no, first, row = np.unique(shard.column("no").to_numpy(), return_index=True, return_inverse=True)
    sketch = shard.column("sketch").take(pa.array(first)).to_pylist()
    sizes = np.array([len(x) for x in sketch])
    vectors, slack = np.zeros((len(no), sizes.max() - 8), np.float32), np.zeros(len(no), np.float32)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join([sketch[i] for i in at]), np.uint8).reshape(len(at), size)
        of = np.ascontiguousarray(raw[:, :8]).view(np.float32)
        vectors[at, : size - 8] = raw[:, 8:].view(np.int8) * of[:, :1]
        slack[at] = of[:, 1]
    least = threshold - 1e-6 - 2e-7 * vectors.shape[1]  # for the rounding of 4-byte sums
    keep = np.zeros(len(row), bool)
    for x, y in _blocks(shard):
        a, b = row[x], row[y]
        near = vectors[a] @ vectors[b].T + slack[a][:, None] + slack[b] >= least
        if x is y:
            np.fill_diagonal(near, False)
        keep[x] |= near.any(axis=1)
        keep[y] |= near.any(axis=0)
    return shard.select(["bucket", "tab", "low", "high", "own", "no"]).filter(pa.array(keep))


def checked(shard: pa.Table, k: int, tables: int, threshold: float, seed: int) -> pa.Table:
    """(rep, n, root): how many near vectors the vectors of a shard's buckets have, and the links of a spanning forest."""
    tab, rep, copies = (shard.column(c).to_numpy() for c in ("tab", "rep", "copies"))
    ids, first, row = np.unique(rep, return_index=True, return_inverse=True)
    copies, raw = copies[first], shard.column("raw").take(pa.array(first)).to_pylist()
    sizes = np.array([len(x) for x in raw])
    dims = _dims(sizes)
    unit = np.zeros((len(ids), dims.max()))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        unit[at, : dims[at[0]]] = _unit([raw[i] for i in at])
    del raw
    n, found = np.zeros(len(ids), np.int64), []
    for of_x, of_y in _blocks(shard):
        x, y = row[of_x], row[of_y]
        close = unit[x] @ unit[y].T >= threshold - 1e-9
        i, j = np.nonzero(np.triu(close, 1) if of_x is of_y else close)
        if not len(i):
            continue
        a, b, t = x[i], y[j], tab[of_x[0]]
        good = dims[a] == dims[b]
        # by the cosine itself, and only in the first table where the pair meets
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        of_a, of_b = at[: len(a)], at[len(a) :]
        keys = np.zeros((len(nodes), t), np.int64)
        for d in np.unique(dims[nodes]) if t else []:
            some = np.flatnonzero(dims[nodes] == d)
            keys[some] = _keys(unit[nodes[some], :d], k, tables, seed, t)
        for s in range(0, len(a), PAIRS):
            part = slice(s, s + PAIRS)
            good[part] &= np.einsum("ij,ij->i", unit[a[part]], unit[b[part]]) >= threshold
            good[part] &= ~(keys[of_a[part]] == keys[of_b[part]]).any(axis=1)
        of_a, of_b = of_a[good], of_b[good]
        own_copies = copies[nodes]
        n[nodes] += (np.bincount(of_a, own_copies[of_b], len(nodes)) + np.bincount(of_b, own_copies[of_a], len(nodes))).astype(np.int64)
        root = forest(len(nodes), of_a, of_b)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        found.append((nodes[moved], nodes[root[moved]]))
    a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    root, met = forest(len(ids), a, b), np.flatnonzero(n > 0)
    return pa.table({"rep": ids[met], "n": n[met], "root": ids[root[met]]})


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.999, block: int = 512, seed: int = 7) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)

    def raw_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if x is None else _raw(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "raw": pa.array(raw, pa.binary())})

    rows = checkpoint(rows.select("vec_id", F.when(usable, F.col("embedding")).alias("embedding")).mapInArrow(raw_bytes, "vec_id long, raw binary"))
    classes = checkpoint(rows.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    n, partitions = classes.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k, tables = tables_for(n, threshold, recall)
    spread = checkpoint(classes.repartition(max(partitions, -(-n * tables // TASK))).withColumn("no", F.monotonically_increasing_id()))

    def signatures(batches: Iterator[pa.RecordBatch], buckets_only: bool = False) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH // tables)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                raw, sizes = b.column(0).to_pylist(), pc.binary_length(b.column(0)).to_numpy()
                for size in np.unique(sizes):
                    rows_here = np.flatnonzero(sizes == size)
                    unit = _unit([raw[i] for i in rows_here])
                    key = _keys(unit, k, tables, seed)
                    if buckets_only:
                        bucket, times = np.unique(key, return_counts=True)
                        yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket), "times": pa.array(times)})
                        continue
                    which = np.repeat(np.arange(len(rows_here), dtype=np.int32), tables)
                    no = b.column(3).take(pa.array(rows_here[which]))
                    sketch = pa.array([x.tobytes() for x in _sketches(unit)], pa.binary()).take(pa.array(which))
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(key.ravel()), "tab": pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows_here))), "no": no, "sketch": sketch})

    in_parts = lambda entries: max(partitions, -(-entries // (SHARD * TOGETHER)))
    # Only buckets that hold more than a block need to be known by name.
    times = spread.mapInArrow(lambda batches: signatures(batches, True), "bucket long, times long").repartition(in_parts(n * tables), "bucket")
    large = checkpoint(times.groupBy("bucket").agg(F.sum("times").alias("size")).where(F.col("size") > block).select("bucket", "size", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    named, more = large.agg(F.count("*"), F.coalesce(F.sum(F.col("size") * (F.col("blocks") - 1)), F.lit(0))).first()
    known = F.broadcast(large.drop("size")) if named <= 100_000 else large.drop("size")  # 12 bytes each
    dealt = spread.mapInArrow(signatures, "bucket long, tab int, no long, sketch binary").join(known, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("no", "tab"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def in_shards(dealt: DataFrame, entries: int) -> DataFrame:
        shards = max(4 * partitions, -(-entries // SHARD))
        return dealt.withColumn("shard", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(shards)).cast("int")).repartition(in_parts(entries), "shard").groupBy("shard")

    def can(shard: pa.Table) -> pa.Table:
        return promising(shard, threshold)

    def check(shard: pa.Table) -> pa.Table:
        return checked(shard, k, tables, threshold, seed)

    dealt = dealt.select("bucket", "tab", "low", "high", "own", "no", "sketch")
    left = checkpoint(in_shards(dealt, n * tables + more).applyInArrow(can, "bucket long, tab int, low int, high int, own int, no long"))
    whole = left.join(spread.select("no", "rep", "copies", "raw"), "no").drop("no")
    met = checkpoint(in_shards(whole, left.count()).applyInArrow(check, "rep long, n long, root long"))
    linked = met.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_class = checkpoint(classes.join(linked, "rep", "left").join(joined, classes["rep"] == joined["id"], "left").select("raw", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    out = rows.join(per_class, "raw", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
